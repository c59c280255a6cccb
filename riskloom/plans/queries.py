"""One query for each operator of the survey, over the logical tables, and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import clean, fixed
from riskloom.operators import detect, resolve, route, score, signals
from riskloom.plans.adapters import Tables, cin, oracle
from riskloom.sources import tables as src
from riskloom.sources.shared import kept
from riskloom.streaming import monitor, replay, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def _case(column: str, source: str, texts: bool = False) -> tuple[str, str]:
    """SQL of a source's ordered rules: type and severity."""
    _, rules, default = (None, *fixed.TEXT_RULES[source]) if texts else fixed.SOURCE_RULES[source]
    out = []
    for i in (1, 2):
        whens = " ".join(f"when contains(lower(coalesce({column}, '')), '{r[0]}') then '{r[i]}'" for r in rules)
        out.append(f"case {whens} else '{default[i - 1]}' end" if rules else f"'{default[i - 1]}'")
    return out[0], out[1]


# ---- sources and cleaning --------------------------------------------------------------------

_MASTER = "select cin, company_name, status, cast(date_of_last_agm as string) as date_of_last_agm, case when k % 17 = 0 then '31/31/2020' else cast(date_of_incorporation as string) end as date_of_incorporation, case when k % 19 = 0 then 'n/a' else cast(authorized_capital as string) end as authorized_capital, cast(paid_up_capital as string) as paid_up_capital from company"


@query("select cin, company_name, status, registered_state, authorized_capital::varchar as authorized_capital, cast(null as varchar) as date_of_last_agm from company")
def a1_read_company_master(t):
    """A master file as it comes: other headers in another order, commas and quotes in names, a column that nobody asks for."""
    path = f"{replay.shared(t.spark)}/master"
    raw = t.company.select(F.col("status").alias("Company Status"), F.col("company_name").alias("CompanyName"), F.lit('a "b", c').alias("Remarks"), F.col("cin").alias(" Company CIN "), F.col("registered_state").alias("STATE-CODE"), F.col("authorized_capital").alias("Authorised Capital"))
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return src.read_company_master(t.spark, path).select("cin", "company_name", "status", "registered_state", "authorized_capital", "date_of_last_agm")


@query("select case when k % 17 = 0 then 'bad date_of_incorporation' when k % 19 = 0 then 'bad authorized_capital' else 'ok' end as reason, cast(count(*) as bigint) as n from company group by 1")
def a2_validate_master(t):
    df = t.company.withColumn("date_of_incorporation", F.when(F.col("k") % 17 == 0, "31/31/2020").otherwise(F.col("date_of_incorporation").cast("string"))).withColumn("authorized_capital", F.when(F.col("k") % 19 == 0, "n/a").otherwise(F.col("authorized_capital").cast("string")))
    good, bad = src.validate_master(df)
    return good.select(F.lit("ok").alias("reason")).union(bad.select(F.element_at("reasons", 1))).groupBy("reason").agg(F.count("*").alias("n"))


@query("select cin, case when k % 5 = 0 then 'Struck Off' else status end as status from company where k % 9 <> 0 or k % 5 = 0")
def a3_upsert_master(t):
    old = t.company.filter("k % 9 <> 0").select("cin", "status")
    new = t.company.filter("k % 5 = 0").select("cin", F.lit("Struck Off").alias("status"))
    return src.upsert(old, new.union(new), ["cin"], [F.col("status")])


@query("select o_orderkey as rid, cast(o_orderdate as date) as deal_date, cast(floor(o_totalprice) as bigint) as quantity, o_orderpriority as scrip_code from orders")
def a4_bulk_deals(t):
    raw = t.base("orders").select(F.date_format("o_orderdate", "dd-MM-yyyy").alias("Deal Date"), F.format_number(F.floor("o_totalprice"), 0).alias("Quantity"), F.col("o_orderpriority").alias("Scrip Code"), F.col("o_orderkey").cast("string").alias("Client Name"))
    return src.bulk_deals(raw).select(F.col("client_name").cast("long").alias("rid"), "deal_date", "quantity", "scrip_code")


@query("select concat('O', cast(o_orderkey as string)) as case_number, o_orderpriority as stage, cast(o_orderdate as date) as filed from orders where o_orderkey % 4 <> 1 and cast(o_orderdate as date) >= date '1997-01-01' and o_orderkey % 10 <> 3")
def a5_cells_to_records(t):
    o = t.base("orders")
    cells = F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("x"))).when(F.col("o_orderkey") % 10 == 3, F.array(F.lit("Case No"), F.lit("Stage"), F.lit("Date"))).otherwise(F.array(F.concat(F.lit(" O"), F.col("o_orderkey")), F.col("o_orderpriority"), F.date_format("o_orderdate", "dd/MM/yyyy")))
    return src.cells_to_records(o.select(cells.alias("cells")), "cells", {"case_number": 0, "stage": 1, "filed": 2}, 3, "filed", F.lit("1997-01-01").cast("date"), "Case No")


@query("select event_id as id, cast(json_extract_string(props, '$.k') as string) as din, concat('D', cast(user_id as string)) as name from events")
def a6_json_records(t):
    e = t.base("events")
    rows = F.concat(F.lit('{"result": {"page": 1, "directors": [{"dinNumber": "'), F.get_json_object("props", "$.k"), F.lit('", "directorName": "D'), F.col("user_id").cast("string"), F.lit('"}]}}'))
    # every second payload nests its rows ten levels deep
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": [{"b": {"c": {"d": [{"e": '), rows, F.lit("}]}}}]}"))).otherwise(rows)
    return src.json_records(e.select(F.col("event_id").alias("id"), doc.alias("doc")), "id", "doc", {"din": ["din", "din_number"], "name": ["director_name", "name"]}).select("id", "din", "name")


@query("select event_id as id, json_extract_string(props, '$.k') as value from events")
def a7_json_deep_value(t):
    e = t.base("events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"a": {"taxpayerStatus": '), F.get_json_object("props", "$.k"), F.lit('}, "z": 1}')).alias("doc"))
    return src.json_deep_value(e, "id", "doc", ["taxpayer", "status"])


@query("select cast(detected_at as date) as event_date, cast(count(*) as bigint) as n, cast(count(distinct id) as bigint) as ids from ev group by 1")
def a9_append_events(t):
    df = src.with_event_id(t.ev.withColumn("record_id", F.col("id").cast("string")).drop("id"))
    return df.groupBy("event_date").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("select case_number, 'tribunal' as source, case when cast(substring(case_number, 2) as bigint) % 20 = 0 then 'Closed' else status end as status from legal")
def a10_upsert_legal_events(t):
    l = t.legal.withColumn("source", F.lit("tribunal")).withColumn("k", F.expr("cast(substring(case_number, 2) as bigint)"))
    new = l.filter("k % 20 = 0 or k % 3 = 0").select("case_number", "source", F.expr("case when k % 20 = 0 then 'Closed' else status end").alias("status"))
    table, _ = src.upsert_cases(l.filter("k % 3 <> 0").select("case_number", "source", "status"), new.union(new))
    return table


@query("select case_number, 'tribunal' as source, case when k % 3 = 0 then 'Admitted' when k % 3 = 1 then 'Disposed' else status end as status from (select *, cast(substring(case_number, 2) as bigint) as k from legal)")
def a10_latest_status(t):
    """Of several pulls of a case the last one counts, whatever its status is called."""
    l = t.legal.withColumn("source", F.lit("tribunal")).withColumn("k", F.expr("cast(substring(case_number, 2) as bigint)"))
    pull = lambda rows, status, at: rows.select("case_number", "source", F.lit(status).alias("status"), F.lit(at).alias("seen_at"))
    a, b = l.filter("k % 3 = 0"), l.filter("k % 3 = 1")
    new = pull(a, "Pending", 1).union(pull(a, "Admitted", 3)).union(pull(a, "Reserved", 2)).union(pull(b, "Pending", 1)).union(pull(b, "Disposed", 2)).union(pull(b, "Zero", None))
    table, _ = src.upsert_cases(l.filter("k % 3 <> 0").select("case_number", "source", "status"), new, "seen_at")
    return table


@query("select din, cin, date_of_appointment, 'Director X' as designation from edge where cast(din as int) % 2 = 0 union all select din, cin, date_of_appointment, designation from edge where cast(din as int) % 2 = 1")
def a11_upsert_governance(t):
    e = t.edge.select("din", "cin", "date_of_appointment", "designation")
    return src.upsert_governance(e, e.filter("cast(din as int) % 2 = 0").withColumn("designation", F.lit("Director X")).withColumn("din", F.concat(F.lit("DIN "), F.col("din"))))


@query("select case when id % 5 = 0 or id % 4 > 1 then 'unmapped' else 'resolution_queue' end as sink, id from ev where id % 5 = 0 or id % 4 <> 0")
def a12_sinks(t):
    r = t.ev.select("id", F.when(F.col("id") % 5 != 0, F.col("cin")).alias("cin"), F.element_at(F.array(F.lit(90.0), F.lit(60.0), F.lit(10.0), F.lit(10.0)), (F.col("id") % 4 + 1).cast("int")).alias("confidence"))
    unmapped, queue = src.unmapped_rows(resolve.route_by_confidence(r))
    return unmapped.unionByName(queue).select("sink", "id")


@query("select 'PAN' as identifier_type, pan as identifier_value, cin, case when k % 2 = 0 then cast(1.0 as double) else cast(0.8 as double) end as confidence from company where pan is not null")
def a13_store_identifier(t):
    c = t.company.filter("pan is not null").select(F.lit("PAN").alias("identifier_type"), F.col("pan").alias("identifier_value"), "cin", "k")
    return src.store_identifiers(c.filter("k % 2 = 0").select("identifier_type", "identifier_value", "cin", F.lit(1.0).alias("confidence")), c)


@query("select cin, coalesce(pan, case when k % 2 = 0 then concat('F', cin) end) as pan from company")
def a13_fill_identifier(t):
    found = t.company.filter("k % 2 = 0").select("cin", F.concat(F.lit("F"), "cin").alias("pan"))
    return src.fill_identifier(t.company.select("cin", F.coalesce("pan", F.lit(" ")).alias("pan")), found.union(found), "pan").select("cin", "pan")


@query("select source as source_id, cin as entity_key, max(id) as last_id from ev group by 1, 2")
def a14_source_state(t):
    s = t.ev.groupBy(F.col("source").alias("source_id"), F.col("cin").alias("entity_key"), F.expr("id % 2").alias("half")).agg(F.max("id").alias("last_id")).withColumn("updated_at", F.col("last_id"))
    cut = lambda h: s.filter(f"half = {h}").drop("half")
    old, new = cut(0), cut(1)
    both = new.join(old.select("source_id", "entity_key", F.col("last_id").alias("o")), ["source_id", "entity_key"], "left").withColumn("last_id", F.greatest("last_id", F.coalesce("o", "last_id"))).drop("o")
    return src.save_state(old, both).select("source_id", "entity_key", "last_id")


@query("""select cin, 'gstin' as how from company where status = 'Active' and (k % 4 = 0 or k % 7 = 0) union all select cin, 'worst' from (select cin from company order by case when k % 6 > 0 then authorized_capital end nulls last, cin limit 200)
union all select cin, 'stressed' from company where k % 6 > 0 and authorized_capital < 5000000 union all select distinct c.cin, 'watched' from company c join entry_ e using (cin)
union all select cin, 'random' from (select cin from company where k % 6 = 0 or authorized_capital < 50 order by md5(concat('7:', cin)), cin limit 200)""")
def a15_monitored_set(t):
    m = t.company.withColumn("gstin", F.when(F.col("k") % 7 == 0, "x").otherwise(" ")).withColumn("score", F.when(F.col("k") % 6 > 0, F.col("authorized_capital"))).withColumn("band", F.when(F.col("score") < 1_000_000, "RED").when(F.col("score") < 5_000_000, "AMBER"))
    ids = t.company.filter("k % 4 = 0").select("cin", F.lit("GSTIN").alias("identifier_type"))
    out = None
    for how in ("gstin", "worst", "stressed", "watched", "random"):
        one = src.monitored(m, ids, t.entry_, how).withColumn("how", F.lit(how))
        out = one if out is None else out.union(one)
    return out


@query("select c_custkey as k, lpad(cast(c_custkey as string), 8, '0') as din, 'Asha Rao' as name, 'Director' as designation, date '2020-03-01' as appointed from customer")
def a16_text_lines(t):
    text = F.concat(F.lit("List\n "), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit("  Asha Rao  Director  01/03/2020\n"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit("  Asha Rao  Other  02/03/2020\nend"))
    return src.text_lines_to_records(t.base("customer").select(F.col("c_custkey").alias("k"), text.alias("text")), "k", "text")


@query(r"select cin, regexp_full_match(cin, '[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}') as cin_ok, coalesce(regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]'), false) as pan_ok, lpad(cast(k as string), 8, '0') as din from company")
def b1_b4_identifier_checks(t):
    return t.company.select("cin", clean.cin_ok("cin").alias("cin_ok"), clean.pan_ok("pan").alias("pan_ok"), clean.director_number(F.concat(F.lit("DIN-"), F.col("k"))).alias("din"))


@query(" union all ".join(f"select distinct doc_id, '{k}' as id_type, unnest(regexp_extract_all(text, '{p}')) as value from (select doc_id, concat(coalesce(text, ''), ' GSTIN 27ABCDE', lpad(doc_id::varchar, 4, '0')[1:4], 'F1ZP for AB-', doc_id::varchar) as text from documents)" for k, p in clean.IDENTIFIERS.items()))
def b3_extract_identifiers(t):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" GSTIN 27ABCDE"), F.substring(F.lpad(F.col("doc_id").cast("string"), 4, "0"), 1, 4), F.lit("F1ZP for AB-"), F.col("doc_id").cast("string"))
    return clean.extract_identifiers(t.base("documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query("""with d as (select cin, pan, lpad(cast(s as string), 2, '0') as code, concat(lpad(cast(s as string), 2, '0'), pan, '1Z') as body from company, range(1, 40) r(s) where pan is not null),
p as (select cin, code, body, i, (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring(body, i, 1)) - 1) * (case when i % 2 = 1 then 1 else 2 end) as v from d, range(1, 15) q(i)),
c as (select cin, code, body, sum(v // 36 + v % 36) as s from p group by 1, 2, 3)
select cin, concat(body, substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((36 - s % 36) % 36 + 1 as bigint), 1)) as gstin, cast(row_number() over (partition by cin order by case when code = '27' then 0 else 1 end, code) as int) as rank from c""")
def b5_gstin_candidates(t):
    return src.gstin_candidates(t.company.filter("pan is not null").withColumn("state_code", F.lit("27")))


@query("""with n as (select p_partkey as k, concat(upper(p_name), ' Technologies (India) Pvt. Ltd.') as raw from part)
select k, concat(lower(split_part(raw, ' ', 1)), ' ', lower(split_part(raw, ' ', 2)), ' technologies') as light, concat(lower(split_part(raw, ' ', 1)), ' ', lower(split_part(raw, ' ', 2))) as strict, concat(lower(split_part(raw, ' ', 1)), ' ', lower(split_part(raw, ' ', 2))) as core, false as person from n""")
def b6_b10_names(t):
    raw = F.concat(F.lit("M/s. "), F.upper("p_name"), F.lit(" Technologies (India) Pvt. Ltd."))
    df = t.base("part").select(F.col("p_partkey").alias("k"), clean.without_messrs(raw).alias("raw"))
    return df.select("k", clean.name_light("raw").alias("light"), clean.name_strict("raw").alias("strict"), clean.name_core("raw").alias("core"), clean.likely_person("raw").alias("person"))


@query("select o_orderkey as k, cast(o_orderdate as date) as d, cast(floor(o_totalprice) as bigint) * 100000 as m, cast(floor(o_totalprice) as bigint) as n from orders")
def b11_b13_dates_and_money(t):
    o = t.base("orders")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select(F.col("o_orderkey").alias("k"), clean.any_date(day).alias("d"), clean.money(F.concat(F.lit("₹"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" Lakh"))).alias("m"), clean.whole(F.format_number(F.floor("o_totalprice") + 0.75, 2)).alias("n"))


@query("select c_custkey as k, c_name as entity, c_name as company from customer")
def b15_title_entities(t):
    c = t.base("customer")
    title = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Order in the matter of "), F.col("c_name"), F.lit("."))).otherwise(F.concat(F.lit("Penalty against "), F.col("c_name")))
    return c.select(F.col("c_custkey").alias("k"), clean.entity_in_title(title).alias("entity"), clean.company_in_title(F.concat(F.lit("Order - "), F.col("c_name"), F.lit(" [CP(IB) 1]"))).alias("company"))


@query("select c_custkey as k, concat(c_name, ' Pvt Ltd') as party, 'SC_APPEAL_DISMISSED' as event_type, 'ALERT' as severity from customer union all select c_custkey, concat('Beta ', cast(c_custkey as string), ' LLP'), 'SC_APPEAL_DISMISSED', 'ALERT' from customer")
def b16_j16_j18_parties(t):
    text = F.concat("c_name", F.lit(" Pvt Ltd vs State of X; Beta "), F.col("c_custkey"), F.lit(" LLP versus Union, dismissed"))
    return detect.party_events(t.base("customer").select(F.col("c_custkey").alias("k"), text.alias("text")), "supreme_court", "text", "k")


@query("select event_type, cast(count(*) as bigint) as n, list_sort(list(distinct r)) as roles, bool_or(rel) as relevant, bool_and(bank) as bank from (select event_type, unnest(case when value > 20 then ['finance', 'legal'] else ['hr'] end) as r, value > 100 as rel, value > 20 as bank from events) group by 1")
def b17_b19_text_tags(t):
    text = F.when(F.col("value") > 20, F.concat(F.lit("Hiring Finance and LEGAL staff "), F.when(F.col("value") > 100, "penalty").otherwise(""))).otherwise("HR only")
    e = t.base("events").withColumn("text", text)
    return e.select("event_type", F.explode(clean.role_types("text")).alias("r"), clean.relevant("text").alias("rel"), clean.bank_like("text").alias("bank")).groupBy("event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("r")).alias("roles"), F.bool_or("rel").alias("relevant"), F.bool_and("bank").alias("bank"))


@query("select case_type, status, case case_type when 'NCLT_7' then 'CRITICAL' when 'SARFAESI_13_4' then 'CRITICAL' when 'SEC_138' then 'ALERT' when 'DRT' then 'ALERT' else 'WATCH' end as severity, case when case_type = 'DRT' then 'DRT/NA/1' else concat(case_type, '/NA/1') end as label, cast(count(*) as bigint) as n from legal group by 1, 2, 3, 4")
def b24_b29_case_labels(t):
    return t.legal.select("case_type", "status", clean.case_severity("case_type").alias("severity"), clean.case_label("case_type", F.lit(" "), F.lit("1")).alias("label")).groupBy("case_type", "status", "severity", "label").agg(F.count("*").alias("n"))


@query("""select id, substring(concat('{"cin":"', cin, '","note":null,"k":', json_extract_string(data_json, '$.k'), '}'), 1, 60) as preview, json_extract_string(data_json, '$.k') is not null as has_k from ev""")
def b25_b30_payloads(t):
    e = t.ev.withColumn("k", F.get_json_object("data_json", "$.k").cast("int")).withColumn("note", F.lit(None).cast("string"))
    return e.select("id", clean.preview(clean.as_json("cin", "note", "k"), 60).alias("preview"), F.col("k").isNotNull().alias("has_k"))


@query("select cin, cast(date_diff('month', date_of_incorporation, date '2001-08-02') - case when day(date_of_incorporation) > 2 then 1 else 0 end as bigint) as months from company where date_of_incorporation <= date '2001-08-02'")
def b28_age_months(t):
    return t.company.filter("date_of_incorporation <= date'2001-08-02'").select("cin", clean.age_months("date_of_incorporation", t.order_day).alias("months"))


# ---- resolution ------------------------------------------------------------------------------


def _name_pairs(t):
    # three companies share each made-up word; without such variety the similar pairs would be the square of the table
    word = F.translate(F.substring(F.md5(F.floor(F.col("k") / 3).cast("string")), 1, 8), "0123456789", "ghijklmnop")
    trade = F.element_at(F.array(*map(F.lit, ["Steel", "Textiles", "Chemical Works", "Motors", "Foods"])), (F.floor(F.col("k") / 6) % 5 + 1).cast("int"))
    dealt = t.company.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "k")  # names are cleaned by all tasks, however few read the file
    m = dealt.withColumn("company_name", F.concat(word, F.lit(" "), trade, F.lit(" "), F.col("k").cast("string"), F.lit(" Pvt Ltd")))
    q = m.select(F.col("k").alias("qid"), F.when(F.col("k") % 2 == 0, F.upper("company_name")).otherwise(F.regexp_replace("company_name", "e", "a")).alias("raw_name"), F.col("registered_state").alias("state"), F.col("industrial_class").alias("industry"), F.when(F.col("k") % 11 == 0, F.col("cin")).alias("cin"), F.when(F.col("k") % 13 == 0, F.col("pan")).alias("pan"))
    return m, q


_NAMES = """with m as (select k, cin, registered_state as state, industrial_class as industry, pan, concat(translate(substring(md5(cast(k // 3 as varchar)), 1, 8), '0123456789', 'ghijklmnop'), ' ', ['Steel', 'Textiles', 'Chemical Works', 'Motors', 'Foods'][(k // 6) % 5 + 1], ' ', cast(k as string), ' Pvt Ltd') as company_name from company),
ml as (select *, trim(regexp_replace(regexp_replace(lower(company_name), '\\b(pvt|ltd)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as name from m),
q as (select k as qid, case when k % 2 = 0 then upper(company_name) else replace(company_name, 'e', 'a') end as raw, state, industry, case when k % 11 = 0 then cin end as qcin, case when k % 13 = 0 then pan end as qpan from m),
ql as (select *, trim(regexp_replace(regexp_replace(lower(raw), '\\b(pvt|ltd)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as name from q),
mg as (select cin, state, industry, name, list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split(name, ' ')])) as g from ml),
qg as (select qid, state, industry, name, list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split(name, ' ')])) as g from ql),
sim as (select qid, cin, qg.state = mg.state as ss, qg.state = mg.state and qg.industry = mg.industry as si, qg.name as a, mg.name as b, len(list_intersect(qg.g, mg.g)) / len(list_distinct(list_concat(qg.g, mg.g))) as s from qg, mg)"""


@query(_NAMES + " select qid, cin, s as sim from sim where s > 0.45")
def e1_e3_similarity_join(t):
    m, q = _name_pairs(t)
    return resolve.similar_names(q.select("qid", clean.name_light("raw_name").alias("name")), m.select("cin", clean.name_light("company_name").alias("name")), 0.45)


@query(_NAMES + " select qid, cin, s as sim, cast(row_number() over (partition by qid order by s desc, cin) as int) as rank from sim where s > 0.5 and ss qualify rank <= 5")
def e3_candidates_in_state(t):
    m, q = _name_pairs(t)
    return resolve.candidates(q.select("qid", "state", clean.name_light("raw_name").alias("name")), m.select("cin", F.col("registered_state").alias("state"), clean.name_light("company_name").alias("name")), 0.5, 5, ("state",))


@query(_NAMES + " select qid, cin, round(jaro_winkler_similarity(a, b), 6) as jw from sim where s > 0.5 and ss and jaro_winkler_similarity(a, b) >= 0.85")
def e2_jaro_winkler(t):
    m, q = _name_pairs(t)
    qn, mn = q.select("qid", "state", clean.name_light("raw_name").alias("name")), m.select("cin", F.col("registered_state").alias("state"), clean.name_light("company_name").alias("name"))
    near = resolve.similar_names(qn, mn, 0.5, ("state",))
    return resolve.judged(near, qn, mn).withColumn("jw", F.round("jw", 6)).filter("jw >= 0.85").select("qid", "cin", "jw")


@query(_NAMES + """, st as (select qid, 1 as stage, qcin as cin, 100.0 as c, 'cin' as method from ql join ml on qcin = ml.cin union all select qid, 2, ml.cin, 100.0, 'pan' from ql join ml on qpan = ml.pan union all select qid, 3, ml.cin, 95.0, 'normalized_exact' from ql join ml on ql.name = ml.name
 union all select qid, 4, max_by(cin, s * 1000000 + cast(substring(cin, 16) as int) / 1000000.0), 90.0, 'trigram_state_08' from sim where ss and s > 0.8 group by qid
 union all select qid, 5, max_by(cin, s * 1000000 + cast(substring(cin, 16) as int) / 1000000.0), 85.0, 'jaro_winkler' from sim where ss and s > 0.5 and jaro_winkler_similarity(a, b) >= 0.85 group by qid
 union all select qid, 6, max_by(cin, s * 1000000 + cast(substring(cin, 16) as int) / 1000000.0), 75.0, 'trigram_state_industry' from sim where si and s > 0.6 group by qid
 union all select qid, 7, cin, 60.0, 'trigram_any' from (select *, row_number() over (partition by qid order by s desc, cin) as r, lead(s) over (partition by qid order by s desc, cin) as nx, least(count(*) over (partition by qid), 10) as n from sim where s > 0.6) where r = 1 and not coalesce(n between 2 and 3 and s between 0.5 and 0.7 and s - nx <= 0.05 + 1e-9, false)),
b as (select qid, min_by(cin, stage * 1000000000::bigint + cast(substring(cin, 16) as int)) as cin, min_by(c, stage) as c, min_by(method, stage) as method from st group by qid)
select ql.qid, b.cin, cast(coalesce(c, 0) as double) as confidence, coalesce(method, 'queue') as method from ql left join b using (qid)""")
def e4_resolve_strict(t):
    m, q = _name_pairs(t)
    return resolve.resolve_strict(q, m)


_MESSRS = r"(?i)^m/s\.?\s*"
_MORE = " Exports Imports Holdings Consultancy Associates Pvt Ltd"
_LIGHT = r"\b(pvt|ltd|private|limited|india|llp)\b"
_COMPANY, _PLAIN = r"(?i)\b(" + "|".join(fixed.COMPANY_TOKENS) + r")\b", r"[A-Za-z]+(\s+[A-Za-z]+){1,4}"
_CORE = r"\b(" + "|".join(sorted(fixed.CORE_TOKENS, key=len, reverse=True)) + r")\b"


def _bare_sql(c: str, tokens: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '{tokens}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _grams_sql(c: str) -> str:
    return f"list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split({c}, ' ') if w <> '']))"


@query(f"""with b as (select k, cin, concat(translate(substring(md5(cast(k // 3 as varchar)), 1, 8), '0123456789', 'ghijklmnop'), ' ', ['Steel', 'Textiles', 'Chemical Works', 'Motors', 'Foods'][(k // 6) % 5 + 1]) as stem from company),
m as (select *, concat(stem, ' ', k::varchar, case when k % 4 = 0 then ' Industries' else '' end, ' Pvt Ltd') as company_name from b),
q as (select k as qid, case k % 9 when 1 then replace(company_name, 'e', 'a') when 2 then stem when 3 then 'Asha Rao' when 4 then concat(stem, ' ', k::varchar, ' Exports Pvt Ltd') when 5 then concat(replace(stem, 'e', 'a'), ' ', k::varchar, '{_MORE}') when 6 then concat('M/s. Alias ', k::varchar) when 7 then concat('Zq ', md5(k::varchar)) when 8 then concat('Stray ', k::varchar) else upper(company_name) end as raw from m),
c as (select qid, trim(regexp_replace(raw, '{_MESSRS}', '')) as clean, not regexp_matches(raw, '{_COMPANY}') and regexp_full_match(trim(raw), '{_PLAIN}') as person from q),
n as (select *, {_bare_sql('clean', _LIGHT)} as light, {_bare_sql('clean', _CORE)} as core from c), ml as (select cin, company_name, {_bare_sql('company_name', _LIGHT)} as light, {_bare_sql('company_name', _CORE)} as core from m),
al as (select lower(concat('Alias ', k::varchar)) as light, cin from m where k % 2 = 0 union all select lower(concat('Stray ', k::varchar)), 'nobody' from m),
nm as (select * from n where not person and light <> ''),
ex as (select qid, 1 as stage, ml.cin, 99.0 as c, 'alias' as method from nm join al using (light) join ml on ml.cin = al.cin union all select qid, 2, cin, 95.0, 'light_exact' from nm join ml using (light) union all select qid, 3, cin, 85.0, 'same_letters' from nm join ml on lower(clean) = lower(company_name)
 union all select qid, 4, cin, 82.0, 'prefix' from nm join ml on length(nm.light) >= 5 and starts_with(ml.light, nm.light) qualify row_number() over (partition by qid order by length(ml.light), cin) = 1 union all select qid, 5, cin, 78.0, 'core_exact' from nm join ml using (core) where core <> '' and core <> nm.light),
rest as (select * from nm where qid not in (select qid from ex)),
lg as (select qid, {_grams_sql('light')} as g from rest), cg as (select qid, {_grams_sql('core')} as g from rest where core <> '' and core <> light), mlg as (select cin, {_grams_sql('light')} as g from ml), mcg as (select cin, {_grams_sql('core')} as g from ml),
s6 as (select qid, cin, len(list_intersect(lg.g, mlg.g)) / len(list_distinct(list_concat(lg.g, mlg.g))) as s from lg, mlg where list_has_any(lg.g, mlg.g)), s7 as (select qid, cin, len(list_intersect(cg.g, mcg.g)) / len(list_distinct(list_concat(cg.g, mcg.g))) as s from cg, mcg where list_has_any(cg.g, mcg.g)),
fz as (select qid, 6 as stage, cin, case when s >= 0.75 then 85.0 when s >= 0.6 then 72.0 else 55.0 end as c, 'trigram' as method from s6 where s > 0.45 qualify row_number() over (partition by qid order by s desc, cin desc) = 1
 union all select qid, 7, cin, case when s >= 0.6 then 65.0 else 45.0 end, 'core_trigram' from s7 where s > 0.4 qualify row_number() over (partition by qid order by s desc, cin desc) = 1),
got as (select *, row_number() over (partition by qid order by stage, cin) as r from (select * from ex union all select * from fz))
select n.qid, got.cin, case when person then 0.0 else coalesce(c, 0.0) end::double as confidence, case when person then 'person' else coalesce(method, 'none') end as method from n left join got on got.qid = n.qid and r = 1""")
def e5_resolve_light(t):
    """Names of every kind that the stages tell apart: as stored, with other letters, beginnings, persons, other business words,
    many of them, aliases, aliases of companies that are not there, and names of nobody."""
    word = F.translate(F.substring(F.md5(F.floor(F.col("k") / 3).cast("string")), 1, 8), "0123456789", "ghijklmnop")
    trade = F.element_at(F.array(*map(F.lit, ["Steel", "Textiles", "Chemical Works", "Motors", "Foods"])), (F.floor(F.col("k") / 6) % 5 + 1).cast("int"))
    k, other = F.col("k").cast("string"), lambda c: F.translate(c, "e", "a")
    m = t.company.withColumn("stem", F.concat_ws(" ", word, trade)).withColumn("company_name", F.concat("stem", F.lit(" "), k, F.when(F.col("k") % 4 == 0, " Industries").otherwise(""), F.lit(" Pvt Ltd")))
    raw = [F.upper("company_name"), other("company_name"), F.col("stem"), F.lit("Asha Rao"), F.concat("stem", F.lit(" "), k, F.lit(" Exports Pvt Ltd")), F.concat(other("stem"), F.lit(" "), k, F.lit(_MORE)), F.concat(F.lit("M/s. Alias "), k), F.concat(F.lit("Zq "), F.md5(k)), F.concat(F.lit("Stray "), k)]
    q = m.select(F.col("k").alias("qid"), F.element_at(F.array(*raw), (F.col("k") % 9 + 1).cast("int")).alias("raw_name"))
    aliases = m.filter("k % 2 = 0").select(F.concat(F.lit("Alias "), k).alias("alias"), "cin").unionByName(m.select(F.concat(F.lit("Stray "), k).alias("alias"), F.lit("nobody").alias("cin")))
    return resolve.resolve_light(q, m, resolve.alias_table(aliases, aliases.limit(0)))


@query(_NAMES + ", c as (select qid, s, row_number() over (partition by qid order by s desc, cin) as r, lead(s) over (partition by qid order by s desc, cin) as nx, count(*) over (partition by qid) as n from sim where s > 0.55) select qid, n between 2 and 3 and s between 0.5 and 0.7 and s - nx <= 0.05 + 1e-9 as ambiguous from c where r = 1")
def e6_ambiguous(t):
    m, q = _name_pairs(t)
    return resolve.ambiguous(resolve.similar_names(q.select("qid", clean.name_light("raw_name").alias("name")), m.select("cin", clean.name_light("company_name").alias("name")), 0.55))


@query("select case when id % 5 = 0 then 'unmapped' when id % 4 = 0 then 'legal_events' when id % 4 = 1 then 'resolution_queue' else 'unmapped' end as sink, cast(count(*) as bigint) as n from ev group by 1")
def e7_route_by_confidence(t):
    r = t.ev.select(F.when(F.col("id") % 5 != 0, F.col("cin")).alias("cin"), F.element_at(F.array(F.lit(90.0), F.lit(60.0), F.lit(10.0), F.lit(10.0)), (F.col("id") % 4 + 1).cast("int")).alias("confidence"))
    return resolve.route_by_confidence(r).groupBy("sink").agg(F.count("*").alias("n"))


@query("select case when id % 3 = 1 then 'unknown queue id' when id % 7 = 0 then 'unknown company' else 'resolved' end as result, cast(count(*) as bigint) as n from ev group by 1")
def e8_manual_resolutions(t):
    d = t.ev.select(F.col("id").alias("queue_id"), F.when(F.col("id") % 7 == 0, F.lit("X")).otherwise(F.col("cin")).alias("cin"))
    return resolve.apply_manual(d, t.ev.filter("id % 3 <> 1").select(F.col("id").alias("queue_id")), t.company).groupBy("result").agg(F.count("*").alias("n"))


@query("select event_id as signal_id, cin from events join (select pan, min(cin) as cin from company where pan is not null group by pan) on pan = concat('ABCDE', lpad(cast(user_id as string), 4, '0'), 'F') where event_id % 2 = 0")
def e9_reprocess_unmapped(t):
    u = t.base("events").select(F.col("event_id").alias("signal_id"), F.lit("PAN").alias("identifier_type"), F.expr("concat('ABCDE', lpad(cast(user_id as string), 4, '0'), 'F')").alias("identifier_value"), (F.col("event_id") % 2 == 1).alias("resolved"))
    return resolve.reprocess(u, t.company.filter("pan is not null").select(F.lit("PAN").alias("identifier_type"), F.col("pan").alias("identifier_value"), "cin"))


@query("select source, cast(count(*) filter (where id % 3 > 0) as bigint) as resolved, cast(count(*) as bigint) as total, round(count(*) filter (where id % 3 > 0) * 100.0 / count(*), 1)::double as rate from ev group by source")
def e10_resolution_rate(t):
    return resolve.resolution_rate(t.ev.select("source", F.when(F.col("id") % 3 > 0, F.col("cin")).alias("cin")))


@query("select lower(replace(c_name, '#', '')) as normalized_alias, concat('U', lpad(cast(c_custkey % 100000 as string), 5, '0'), 'MH2015PTC', lpad(cast(c_custkey as string), 6, '0')) as cin, c_name as alias from customer")
def e11_alias_table(t):
    a = t.company.select(F.col("company_name").alias("alias"), "cin")
    return resolve.alias_table(a, a)


@query("with q as (select distinct lower(concat('r#', right(c_name, 4 - c_custkey % 3))) as query from customer union select '42' union select '9' union select 'nobody'), h as (select query, cin, lower(company_name) as name, case when starts_with(lower(company_name), query) then 1 else 2 end as rank from q, company where contains(lower(company_name), query)) select query, cin, rank, cast(row_number() over (partition by query, rank order by name, cin) as int) as r from h qualify r <= 10")
def e12_search_companies(t):
    typed = t.spark.createDataFrame([("42",), ("9",), ("nobody",)], "query string")
    of_names = t.base("customer").select(F.lower(F.concat(F.lit("r#"), F.expr("right(c_name, 4 - c_custkey % 3)"))).alias("query")).distinct()
    return resolve.search_companies(typed.union(of_names), t.company)


@query("""with ids as (select pan, min(cin) as cin from company where pan is not null group by pan), dl as (select lower(director_name) as name, cin, row_number() over (partition by lower(director_name) order by date_of_appointment desc nulls last, cin) as r from edge)
select id as rid, coalesce(ids.cin, c.cin, dl.cin) as cin, case when ids.cin is not null then 'pan' when c.cin is not null then 'cin' when dl.cin is not null then 'director' else 'none' end as method
from ev left join ids on id % 3 = 0 and ids.pan = concat('ABCDE', lpad(cast(user_id as string), 4, '0'), 'F') left join company c on id % 3 = 1 and c.cin = ev.cin left join dl on dl.r = 1 and dl.name = concat('director ', cast(id % 700 as string))""")
def c4_identifier_chain(t):
    r = t.ev.select(F.col("id").alias("rid"), F.lit(None).cast("string").alias("gstin"), F.expr("case when id % 3 = 0 then concat('ABCDE', lpad(cast(user_id as string), 4, '0'), 'F') end").alias("pan"), F.expr("case when id % 3 = 1 then cin end").alias("cin_text"), F.concat(F.lit("DIRECTOR "), (F.col("id") % 700).cast("string")).alias("director"))
    ids = t.company.filter("pan is not null").select(F.lit("PAN").alias("identifier_type"), F.col("pan").alias("identifier_value"), "cin")
    return resolve.identifier_chain(r, ids, t.company, t.edge)


# ---- detectors and transitions ---------------------------------------------------------------

_FIRST = "select *, row_number() over (partition by cin, rid order by id) as n from (select id, cin, concat('R', cast(id % 400 as string)) as rid, concat('x ', data_json) as txt, value from ev)"


def _records(t, column: str, text):
    return t.ev.select("id", "cin", F.concat(F.lit("R"), (F.col("id") % 400).cast("string")).alias("record_id"), text.alias(column), "value")


def _seen(t):
    return t.ev.filter("id % 9 = 0").select("cin", F.concat(F.lit("R"), (F.col("id") % 400).cast("string")).alias("record_id")).distinct()


_TEXTS = ["Section 9 petition", "S7 filed", "CIRP Admitted", "liquidation", "resolution plan", "Order reserved", "cancelled", "suspend", "possession notice", "13(2)", "debarred", "closure"]
_TEXT_SQL = "['" + "', '".join(_TEXTS) + "'][id % 12 + 1]"
_NEW = f"""with r as (select id, cin, concat('R', cast(id % 400 as string)) as record_id, {_TEXT_SQL} as txt from ev), seen as (select distinct cin, record_id from r where id % 9 = 0),
f as (select r.* from r left join seen using (cin, record_id) where seen.cin is null qualify row_number() over (partition by r.cin, r.record_id order by r.id) = 1)"""


def _source_sql() -> str:
    return " union all ".join("select cin, '{0}' as source, {1} as event_type, {2} as severity, record_id from f".format(s, *_case("txt", s)) for s in fixed.SOURCE_RULES if s != "sarfaesi")


@query(_NEW + " " + _source_sql())
def i3_i20_append_sources(t):
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("id") % 12 + 1).cast("int"))
    sources = [x for x in fixed.SOURCE_RULES if x != "sarfaesi"]
    every = F.array(*map(F.lit, sources)).alias("sources")
    return detect.detect_sources(_records(t, "text", text).select("*", every), _seen(t).select("*", every), sources, "id")


@query(f"""with r as (select id, cin, concat('R', cast(id % 400 as string)) as record_id, {_TEXT_SQL} as txt from ev)
select cin, 'sarfaesi' as source, {_case("txt", "sarfaesi")[0]} as event_type, {_case("txt", "sarfaesi")[1]} as severity, record_id from (select distinct cin, record_id, txt from r)""")
def i5_secured_creditor_notices(t):
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("id") % 12 + 1).cast("int"))
    return detect.detect_notices(_records(t, "notice_stage", text), t.ev.limit(0).select("cin", F.lit("").alias("record_id"), F.lit("").alias("stage")))


@query("""with n as (select cin, cast(count(*) as bigint) as c from ev where id % 2 = 0 and event_type = 'SEC138_FILED' group by cin),
r as (select cin, cast(id as string) as record_id, id % 5 = 0 as closed, event_type = 'SEC138_FILED' as cheque, cast(floor(value * 100000) as bigint) as claim from ev where id % 2 = 1)
select r.cin, 'ecourts' as source, case when closed then 'CASE_DISPOSED' when cheque and coalesce(c, 0) + 1 >= 3 then 'SEC138_MULTIPLE' when cheque then 'SEC138_FILED' else 'CIVIL_SUIT_FILED' end as event_type,
case when closed then 'INFO' when cheque and coalesce(c, 0) + 1 >= 3 then 'CRITICAL' when cheque then 'ALERT' else 'WATCH' end as severity, record_id, case when not closed and cheque then coalesce(c, 0) + 1 end as cheque_count
from r left join n using (cin) where closed or cheque or claim > 10000000""")
def i6_district_courts(t):
    stored = t.ev.filter("id % 2 = 0 and event_type = 'SEC138_FILED'").groupBy("cin").agg(F.count("*").alias("cheque_count"))
    r = t.ev.filter("id % 2 = 1").select("cin", F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 5 == 0, "Case Disposed").alias("disposal_status"), F.when(F.col("event_type") == "SEC138_FILED", "Cheque bounce 138").otherwise("Civil").alias("case_type"), F.floor(F.col("value") * 100000).cast("string").alias("claim_amount"))
    return detect.detect_district_cases(r, r.limit(0), stored)


@query("""with n as (select cin, cast(count(*) as bigint) as c from ev where id % 2 = 0 and event_type = 'SEC138_FILED' group by cin),
r as (select cin, cast(id as string) as record_id, row_number() over (partition by cin order by cast(id as string)) as place from ev where id % 2 = 1 and event_type = 'SEC138_FILED')
select r.cin, case when coalesce(c, 0) + place >= 3 then 'SEC138_MULTIPLE' else 'SEC138_FILED' end as event_type, record_id, cast(coalesce(c, 0) + place as bigint) as cheque_count from r left join n using (cin)""")
def i6_cumulative_cases(t):
    stored = t.ev.filter("id % 2 = 0 and event_type = 'SEC138_FILED'").groupBy("cin").agg(F.count("*").alias("cheque_count"))
    r = t.ev.filter("id % 2 = 1 and event_type = 'SEC138_FILED'").select("cin", F.col("id").cast("string").alias("record_id"), F.lit("Open").alias("disposal_status"), F.lit("Cheque 138").alias("case_type"), F.lit("0").alias("claim_amount"))
    return detect.detect_district_cases(r, r.limit(0), stored, cumulative=True).select("cin", "event_type", "record_id", "cheque_count")


@query("""with r as (select cin, cast(id as string) as record_id, case when id % 6 = 5 then '' else ['cirp', 'Liquidation', 'moratorium', 'voluntary liquidation', 'other'][id % 6 + 1] end as ct from ev)
select cin, 'ibbi' as source, case lower(ct) when '' then 'IBBI_CIRP_ADMITTED' when 'cirp' then 'IBBI_CIRP_ADMITTED' when 'liquidation' then 'IBBI_LIQUIDATION_ORDER' when 'moratorium' then 'IBBI_MORATORIUM' when 'voluntary liquidation' then 'IBBI_VOLUNTARY_LIQUIDATION' else 'IBBI_CASE_FILED' end as event_type,
case lower(ct) when '' then 'CRITICAL' when 'cirp' then 'CRITICAL' when 'liquidation' then 'CRITICAL' when 'moratorium' then 'WATCH' else 'ALERT' end as severity, record_id from r""")
def i7_insolvency_board(t):
    r = t.ev.select("cin", F.col("id").cast("string").alias("record_id"), F.element_at(F.array(*map(F.lit, ["cirp", "Liquidation", "moratorium", "voluntary liquidation", "other", ""])), (F.col("id") % 6 + 1).cast("int")).alias("case_type"))
    return detect.detect_by_type(r, r.limit(0))


@query("select cin, 'sebi_bulk_block_deals' as source, 'SEBI_BULK_BLOCK_DEAL' as event_type, case when floor(value * 10000) > 500000 then 'ALERT' else 'WATCH' end as severity, cast(id as string) as record_id from ev union all select cin, 'naukri', case when floor(value) >= 50 then 'MASS_HIRING_SIGNAL' when floor(value) = 0 then 'HIRING_FREEZE_SIGNAL' else 'HIRING_ACTIVITY' end, case when floor(value) >= 50 or floor(value) = 0 then 'WATCH' else 'INFO' end, cast(id as string) from ev")
def i9_i19_quantities(t):
    r = t.ev.select("cin", F.col("id").cast("string").alias("record_id"), F.floor(F.col("value") * 10000).alias("quantity"), F.floor("value").alias("job_count"))
    return detect.detect_quantities(r, r.limit(0), "sebi_bulk_block_deals", "quantity").unionByName(detect.detect_quantities(r, r.limit(0), "naukri", "job_count"))


@query("select cin, 'roc_filings' as source, concat('ROC_FILING_', f) as event_type, case when f in ('MGT-7', 'AOC-4') then 'INFO' when f in ('STK-2', 'STK-7') then 'ALERT' else 'WATCH' end as severity, cast(id as string) as record_id from (select *, ['MGT-7', 'AOC-4', 'STK-2', 'OTHER', 'DIR-12'][id % 5 + 1] as f from ev)")
def i15_filings(t):
    r = t.ev.select("cin", F.col("id").cast("string").alias("record_id"), F.element_at(F.array(*map(F.lit, ["mgt-7", "AOC-4", "stk-2", "", "DIR-12"])), (F.col("id") % 5 + 1).cast("int")).alias("form_type"))
    return detect.detect_filings(r, r.limit(0))


@query("select source, cast(count(*) as bigint) as n from ev where source in ('s1', 's3') group by source")
def i0_d11_changed_sources(t):
    now = t.ev.select("source", "cin", "event_type", "id")
    before = now.withColumn("id", F.when(F.col("source") == "s1", F.col("id") + 1).otherwise(F.col("id"))).filter("source <> 's3'").repartition(3)
    return detect.changed_sources(detect.fingerprint(now, ["source"]), detect.fingerprint(before, ["source"]), ["source"])


@query(_NEW.replace("from ev), seen", "from ev where user_id % 3 > 0), seen") + " select cin, 'nclt' as source, {0} as event_type, {1} as severity, record_id from f".format(*_case("txt", "nclt")))
def i0_process_source(t):
    """Companies whose records are as they were (every third user) give no events, whatever is stored of them."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("id") % 12 + 1).cast("int"))
    column = fixed.SOURCE_RULES["nclt"][0]
    records = _records(t, column, text)
    same = t.ev.filter("user_id % 3 = 0").select("cin").distinct()
    before = detect.fingerprint(records.join(same, "cin", "left_semi"), ["cin"])
    events, _ = detect.process_source(records, _seen(t), before, "nclt", "id")
    return events


@query("select id, case id % 4 when 0 then concat('C', cast(id as string)) when 1 then 'R' when 2 then concat('O', cast(id as string)) else cast(id as string) end as record_id from ev")
def i21_record_id(t):
    e = t.ev.select("id", *[F.when(F.col("id") % 4 == i, x).otherwise(F.lit(" ")).alias(n) for i, (n, x) in enumerate({"case_number": F.concat(F.lit("C"), "id"), "record_id": F.lit("R"), "order_number": F.concat(F.lit("O"), "id")}.items())], F.lit(None).cast("string").alias("filing_number"), F.col("id").cast("string").alias("key"))
    return e.select("id", detect.record_id("case_number", "record_id", "order_number", "filing_number", "key").alias("record_id"))


_SNAP = """with o as (select cin, status, paid_up_capital as cap, old_agm as agm from company where k % 89 <> 0), n as (select cin, case when k % 23 = 0 then 'Struck Off' else status end as status, case when k % 13 = 0 then paid_up_capital * 2 else paid_up_capital end as cap, case when k % 2 = 0 then old_agm else date_of_last_agm end as agm from company where k % 97 <> 0),
b as (select coalesce(o.cin, n.cin) as cin, o.cin is not null as io, n.cin is not null as inn, o.status as os, n.status as ns, o.cap as oc, n.cap as nc, o.agm as oa, n.agm as na from o full outer join n on o.cin = n.cin)"""


@query(_SNAP + """ select cin, 'NEW_COMPANY' as event_type, 'INFO' as severity from b where not io union all select cin, 'COMPANY_REMOVED', 'ALERT' from b where not inn and os = 'Active' union all select cin, 'STATUS_CHANGE', 'ALERT' from b where io and inn and os <> ns
 union all select cin, 'CAPITAL_CHANGE', 'WATCH' from b where io and inn and oc > 0 and abs(nc - oc) / oc > 0.5 union all select cin, 'AGM_OVERDUE', 'WATCH' from b where io and inn and ns = 'Active' and coalesce(date_diff('day', na, date '2002-06-01') > 548, false) and not coalesce(date_diff('day', oa, date '2002-06-01') > 548, false)""")
def i1_c3_company_diff(t):
    return detect.diff_companies(*_snapshots(t), F.lit("2002-06-01").cast("date"))


def _snapshots(t):
    cap = F.col("paid_up_capital")
    o = t.company.filter("k % 89 <> 0").select("cin", "status", cap.cast("string").alias("paid_up_capital"), F.col("old_agm").alias("date_of_last_agm"))
    n = t.company.filter("k % 97 <> 0").select("cin", F.expr("case when k % 23 = 0 then 'Struck Off' else status end").alias("status"), F.when(F.col("k") % 13 == 0, cap * 2).otherwise(cap).cast("string").alias("paid_up_capital"), F.expr("case when k % 2 = 0 then old_agm else date_of_last_agm end").alias("date_of_last_agm"))
    return o, n


@query("""with n as (select *, cast(din as int) as d from edge), o as (select din, cin, case when d % 3 = 0 then null else cessation_date end as e from n where d % 5 <> 0)
select n.cin, n.din, 'DIRECTOR_APPOINTED' as event_type, 'INFO' as severity from n left join o using (din, cin) where o.din is null and cessation_date is null
union all select n.cin, n.din, 'DIRECTOR_RESIGNED', case when designation in ('CFO', 'Auditor') then 'ALERT' else 'WATCH' end from n join o using (din, cin) where o.e is null and cessation_date is not null
union all select min(cin), din, 'DIRECTOR_OVERLOADED', 'WATCH' from edge where cessation_date is null group by din having count(distinct cin) >= 3""")
def i2_director_diff(t):
    e = t.edge.withColumn("d", F.col("din").cast("int"))
    o = e.filter("d % 5 <> 0").withColumn("cessation_date", F.expr("case when d % 3 = 0 then null else cessation_date end"))
    return detect.diff_directors(o, e, boards_from=3)


@query("""with p as (select cin, din, designation, case when din::int % 3 = 0 then null else cessation_date end as e, case when din::int % 4 = 0 then concat('Old ', director_name) else director_name end as name, coalesce(date_of_appointment, date '1900-01-01') as since from edge where din::int % 5 <> 0),
a as (select cin, name from p where designation = 'Auditor' qualify row_number() over (partition by cin order by since desc, name desc) = 1), b as (select din, count(distinct cin) as boards from edge where cessation_date is null group by din)
select c.cin, c.din as key, director_name, 'CFO_RESIGNED' as event_type, 'ALERT' as severity from edge c join p using (cin, din) where c.designation = 'CFO' and p.e is null and cessation_date is not null
union all select c.cin, c.din, director_name, 'DIRECTOR_RESIGNED', 'WATCH' from edge c join p using (cin, din) where c.designation <> 'CFO' and p.e is null and cessation_date is not null
union all select c.cin, c.din, director_name, 'AUDITOR_CHANGED', 'ALERT' from edge c left join p using (cin, din) left join a on a.cin = c.cin where c.designation = 'Auditor' and (p.name <> director_name or a.name <> director_name)
union all select c.cin, c.din, director_name, 'DIRECTOR_OVERLOADED', 'WATCH' from edge c join b using (din) where boards > 2""")
def j10_director_refresh(t):
    e = t.edge.withColumn("d", F.col("din").cast("int"))
    old = e.filter("d % 5 <> 0").withColumn("cessation_date", F.expr("case when d % 3 = 0 then null else cessation_date end")).withColumn("director_name", F.expr("case when d % 4 = 0 then concat('Old ', director_name) else director_name end"))
    return detect.refresh_directors(old, e, boards_above=2)


def _transition_sql(source: str) -> str:
    out = []
    for previous, new, kind, severity in fixed.TRANSITIONS[source]:
        more = " and was in ('" + "', '".join(previous) + "')" if previous else ""
        out.append(f"select '{source}' as source, key, pull_ts, '{kind}' as event_type, '{severity}' as severity from p where status = '{new}' and status <> was and was <> ''{more}")
    if source in fixed.FIRST_SIGHT:
        out.append("select '{0}', key, pull_ts, '{1}', '{2}' from p where n = 1".format(source, *fixed.FIRST_SIGHT[source]))
    return " union all ".join(out)


@query("with p as (select key, pull_ts, status, coalesce(lag(status) over w, '') as was, row_number() over w as n from pull window w as (partition by key order by pull_ts, id)) " + " union all ".join(_transition_sql(s) for s in fixed.TRANSITIONS))
def j1_j7_f7_transitions(t):
    return detect.all_transitions(t.pull, list(fixed.TRANSITIONS), ["key"], order=("id",))


@query("with p as (select key, pull_ts, case when value > 100 then 'Revoked' when value > 50 then 'granted' when value > 10 then 'refused' else 'applied' end as status, floor(value) * 20000000 as cost, row_number() over w as n, lag(case when value > 100 then 'Revoked' when value > 50 then 'granted' when value > 10 then 'refused' else 'applied' end) over w as was from (select user_id as key, cast(ts as timestamp) as pull_ts, event_id as id, value from events) window w as (partition by key order by pull_ts, id)) select key, pull_ts, case when n = 1 and cost > 1000000000 then 'EC_NEW_APPLICATION' else concat('EC_', upper(status)) end as event_type, case when n = 1 and cost > 1000000000 then 'INFO' when status = 'Revoked' then 'CRITICAL' when status = 'refused' then 'ALERT' else 'INFO' end as severity from p where n = 1 and cost > 1000000000 or (n = 1 or status <> was) and status <> 'applied'")
def j7_clearances(t):
    e = t.base("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("pull_ts"), F.col("event_id").alias("id"), F.when(F.col("value") > 100, "Revoked").when(F.col("value") > 50, "granted").when(F.col("value") > 10, "refused").otherwise("applied").alias("status"), (F.floor("value") * 20_000_000).alias("project_cost"))
    return detect.clearances(e, order=("id",))


@query("with p as (select key, pull_ts, case classification when 'micro' then 1 when 'small' then 2 else 3 end as r, complaints from pull), q as (select *, lag(r) over w as was, lag(complaints) over w as cw from p window w as (partition by key order by pull_ts)) select key, pull_ts, 'UDYAM_CLASSIFICATION_UPGRADE' as event_type, 'INFO' as severity from q where r > was union all select key, pull_ts, 'RERA_COMPLAINT_SPIKE', 'ALERT' from q where cw > 0 and complaints >= greatest(cw, 1) * 3")
def j4_j6_upgrades_and_spikes(t):
    return detect.upgrades(t.pull).unionByName(detect.project_changes(t.pull))


_CHG = """with cur as (select cin, case_number as id, amount * 200 as amount, case when amount % 5 = 0 then 'Satisfied' else 'Open' end as status, 30000000 as cap from legal), prev as (select cin, id, amount - cast(amount % 3 as bigint) * 100 as was, 'Open' as ws from cur where (amount // 200) % 2 = 0),
b as (select cur.*, was, ws, prev.id is not null as known from cur left join prev on cur.cin = prev.cin and cur.id = prev.id)"""


@query(_CHG + """, h as (select cin, id as charge_id, case when not known and amount > 100000000 then 'CHARGE_EXCEEDS_CAPITAL' when not known and amount >= 10000000 then 'CHARGE_CREATED' when not known then null when amount > was then 'CHARGE_MODIFIED' when status = 'Satisfied' then 'CHARGE_SATISFIED' when amount > cap then 'CHARGE_EXCEEDS_CAPITAL' end as event_type from b)
select cin, charge_id, event_type, case event_type when 'CHARGE_EXCEEDS_CAPITAL' then 'CRITICAL' when 'CHARGE_CREATED' then 'ALERT' else 'WATCH' end as severity from h where event_type is not null""")
def j9_i14_charges(t):
    cur = t.legal.select("cin", F.col("case_number").alias("charge_id"), F.col("amount").alias("a"), (F.col("amount") * 200).alias("amount"), F.lit(30_000_000).alias("authorized_capital")).withColumn("status", F.when(F.col("a") % 5 == 0, "Satisfied").otherwise("Open"))
    prev = cur.filter("a % 2 = 0").select("cin", "charge_id", (F.col("amount") - F.col("amount") % 3 * 100).alias("amount"), F.lit("Open").alias("status"))
    return detect.classify_charges(prev, cur)


@query("with c as (select cin, count(distinct case_type) filter (where status <> 'Disposed') as now, count(distinct case_type) filter (where status <> 'Disposed' and amount % 3 = 0) as old from legal group by cin) select cin, 'MULTIPLE_LENDERS' as event_type, 'ALERT' as severity, cast(now as bigint) as lenders from c where now >= 3 and old < 3")
def f9_multiple_lenders(t):
    c = t.legal.select("cin", F.col("case_type").alias("lender"), F.when(F.col("status") == "Disposed", "Satisfied").otherwise("Open").alias("status"), "amount")
    return detect.multiple_lenders(c.filter("amount % 3 = 0"), c)


@query("""with c as (select cin, case_number as id, amount * 100 as amount, case when status = 'Disposed' then filing_date end as done from legal), o as (select cin, count(*) as n from c where done is null group by cin)
select c.cin, id as interest_id, case when amount % 200 = 0 and done is not null then 'CERSAI_SI_SATISFIED' when coalesce(n, 0) >= 3 then 'CERSAI_MULTIPLE_LENDERS' else 'CERSAI_NEW_SI' end as event_type, case when amount % 200 = 0 and done is not null then 'INFO' else 'ALERT' end as severity from c left join o using (cin)
where (amount % 200 = 0 and done is not null) or coalesce(n, 0) >= 3 or (amount % 200 <> 0 and amount >= 10000000)""")
def j8_security_interests(t):
    c = t.legal.select("cin", F.col("case_number").alias("interest_id"), (F.col("amount") * 100).alias("amount"), F.when(F.col("status") == "Disposed", F.col("filing_date")).alias("satisfied_on"))
    return detect.security_interests(c.filter("amount % 200 = 0").withColumn("satisfied_on", F.lit(None).cast("date")), c)


@query("select distinct on (d, s, c) cin, d as deal_date, s as scrip, c as client_name, case when p and dt = 'sell' then 'SEBI_BULK_DEAL_PROMOTER_SELL' when c like '%capital%' then 'SEBI_BULK_DEAL_INSTITUTIONAL_EXIT' else 'SEBI_INSIDER_BUY' end as event_type, case when p and dt = 'sell' then 'ALERT' when c like '%capital%' then 'WATCH' else 'INFO' end as severity from (select cin, id, cast(detected_at as date) as d, concat('S', cast(id as string)) as s, case when id % 4 = 0 then 'x capital' else 'person' end as c, case when id % 3 = 0 then 'sell' else 'buy' end as dt, id % 5 = 0 as p from ev) where (p and dt = 'sell') or c like '%capital%' or (p and dt = 'buy')")
def j11_bulk_deals(t):
    d = t.ev.select("cin", F.col("detected_at").cast("date").alias("deal_date"), F.concat(F.lit("S"), F.col("id")).alias("scrip"), F.when(F.col("id") % 4 == 0, "x capital").otherwise("person").alias("client_name"), F.when(F.col("id") % 3 == 0, "Sell").otherwise("Buy").alias("deal_type"), F.col("id").alias("quantity"), (F.col("id") % 5 == 0).alias("promoter"))
    return detect.classify_deals(d.union(d), d.limit(0))


@query("""with r as (select distinct c_name as b, concat('Director ', cast(c_custkey % 900 as string)) as dn, c_custkey as k from customer), dl as (select distinct director_name, cin from edge)
select case when k % 4 = 0 then b else concat('X', b) end as borrower, case when k % 4 = 0 then concat('U', lpad(cast(k % 100000 as string), 5, '0'), 'MH2015PTC', lpad(cast(k as string), 6, '0')) end as cin, case when k % 4 = 0 then 'WILFUL_DEFAULT_COMPANY' else 'UNMAPPED' end as event_type, case when k % 4 = 0 then 'CRITICAL' else 'INFO' end as severity from r
union all select case when k % 4 = 0 then b else concat('X', b) end, dl.cin, 'WILFUL_DEFAULT_DIRECTOR', 'ALERT' from r join dl on dl.director_name = r.dn""")
def j12_wilful_defaulters(t):
    r = t.base("customer").select(F.expr("case when c_custkey % 4 = 0 then c_name else concat('X', c_name) end").alias("borrower"), F.concat(F.lit("DIRECTOR "), (F.col("c_custkey") % 900).cast("string")).alias("director_name"))
    return detect.defaulter_rows(r, r.limit(0), t.company, t.edge.select("director_name", "cin").distinct())


@query("select cin, cast(id as string) as award_id, case when floor(value * 100000) >= 10000000 then 'GEM_LARGE_CONTRACT' when floor(value * 100000) >= 5000000 then 'GEM_ORDER_WON' else 'GEM_NEW_SELLER' end as event_type, 'INFO' as severity from ev")
def j13_awards(t):
    return detect.classify_awards(t.ev.select("cin", F.col("id").cast("string").alias("award_id"), F.floor(F.col("value") * 100000).alias("order_value")))


_KINDS = list(fixed.TEXT_RULES)
_ORDERS = ["Show Cause notice", "interim order", "Final order", "settlement", "approval granted", "penalty", "attachment", "injunction", "stay", "appeal dismissed", "closure", "CTO revoked", "CP(IB) 12", "Resolution Plan", "warning", "restriction"]
_ORDER_SQL = "['" + "', '".join(_ORDERS) + "'][id % 16 + 1]"


@query(" union all ".join("select '{0}' as kind, id, {1} as event_type, {2} as severity from (select id, {3} as txt from ev)".format(k, *_case("txt", k, texts=True), _ORDER_SQL) for k in _KINDS))
def j14_j21_order_texts(t):
    text = t.ev.select("id", F.element_at(F.array(*map(F.lit, _ORDERS)), (F.col("id") % 16 + 1).cast("int")).alias("txt"))
    out = None
    for k in _KINDS:
        one = detect.classify_text(text, k, "txt", ["id"]).select(F.lit(k).alias("kind"), "id", "event_type", "severity")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with r as (select id, cast(detected_at as date) as release_date, concat('E', cast(user_id % 50 as string)) as entity_name, ['Penalty on a bank', 'Cancellation of CoR', 'Restrictions eased', 'Warning letter', 'Speech', 'Enforcement action'][id % 6 + 1] as title from ev),
c as (select *, case when contains(lower(title), 'cancellation') then 'cancellation' when contains(lower(title), 'restriction') then 'restriction' when contains(lower(title), 'warning') then 'warning' else 'penalty' end as action from r where title <> 'Speech'), seen as (select distinct release_date, entity_name, action from c where id % 11 = 0)
select distinct release_date, entity_name, action, case action when 'cancellation' then 'RBI_LICENSE_CANCELLED' when 'restriction' then 'RBI_RESTRICTION' when 'warning' then 'RBI_WARNING' else 'RBI_ENFORCEMENT' end as event_type, case action when 'cancellation' then 'CRITICAL' when 'warning' then 'WATCH' else 'ALERT' end as severity from c anti join seen using (release_date, entity_name, action)""")
def j14_press_releases(t):
    r = t.ev.select("id", F.col("detected_at").cast("date").alias("release_date"), F.concat(F.lit("E"), (F.col("user_id") % 50).cast("string")).alias("entity_name"), F.element_at(F.array(*map(F.lit, ["Penalty on a bank", "Cancellation of CoR", "Restrictions eased", "Warning letter", "Speech", "Enforcement action"])), (F.col("id") % 6 + 1).cast("int")).alias("title"))
    none = r.limit(0).select("release_date", "entity_name", F.lit("").alias("action"))
    seen = detect.press_releases(r.filter("id % 11 = 0"), none).select("release_date", "entity_name", "action")
    return detect.press_releases(r, seen)


@query("select c_custkey as k, concat(c_name, ' Pvt Ltd') as party, cin, 'CCI_PENALTY' as event_type, 'ALERT' as severity from customer join company on k = c_custkey union all select c_custkey, concat('Beta ', cast(c_custkey as string), ' LLP'), null, 'CCI_PENALTY', 'ALERT' from customer")
def j16_j18_resolved_parties(t):
    text = F.concat("c_name", F.lit(" Pvt Ltd; Beta "), F.col("c_custkey"), F.lit(" LLP; the State, penalty"))
    return detect.resolved_party_events(t.base("customer").select(F.col("c_custkey").alias("k"), text.alias("text")), "competition", "text", "k", t.company).drop("confidence")


_PARTIES = """with p as (select c_custkey as k, case c_custkey % 3 when 0 then concat(upper(c_name), ' Private Limited') when 1 then concat('Alias ', c_custkey::varchar, ' LLP') else concat('Nobody ', c_custkey::varchar, ' Ltd') end as party from customer)"""


@query(_PARTIES + " select k, party, case when k % 3 < 2 then cin end as cin, case k % 3 when 0 then 95.0 when 1 then 99.0 else 0.0 end::double as confidence, 'SC_APPEAL_DISMISSED' as event_type, 'ALERT' as severity from p join company using (k)")
def j18_parties_by_cascade(t):
    """Parties by the whole cascade: other letters, aliases, and companies that nobody knows."""
    k = F.col("c_custkey")
    party = F.when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit(" Private Limited"))).when(k % 3 == 1, F.concat(F.lit("Alias "), k, F.lit(" LLP"))).otherwise(F.concat(F.lit("Nobody "), k, F.lit(" Ltd")))
    orders = t.base("customer").select(k.alias("k"), F.concat(party, F.lit(" vs Union of India, dismissed")).alias("text"))
    aliases = t.company.filter("k % 3 = 1").select(F.concat(F.lit("alias "), F.col("k")).alias("normalized_alias"), "cin")
    return detect.resolved_party_events(orders, "supreme_court", "text", "k", t.company, aliases)


_BATCH_TEXTS = {"regulator_order_type": ["Debarment order", "Investigation", "Director action", "Penalty", "Settlement", "Other"], "promoter_disclosure": ["Pledge created", "Sale"], "vat_backfill": ["any"]}


def _batch_sql() -> str:
    out = []
    for kind, texts in _BATCH_TEXTS.items():
        rules, default = fixed.BATCH_RULES[kind]
        text = "lower(['" + "', '".join(texts) + f"'][id % {len(texts)} + 1])"
        pick = lambda i: "case " + " ".join(f"when contains({text}, '{r[0]}') then '{r[i]}'" for r in rules) + (f" else '{default[i - 1]}' end" if default[0] else " end") if rules else f"'{default[i - 1]}'"  # noqa: B023, E731
        out.append(f"select '{kind}' as kind, id, {pick(1)} as event_type, {pick(2)} as severity from ev where {pick(1)} is not null")
    return " union all ".join(out)


@query(_batch_sql())
def o17_batch_rules(t):
    """Order types, disclosures and backfilled lists by the rules of the batch specifications."""
    out = None
    for kind, texts in _BATCH_TEXTS.items():
        text = F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int"))
        one = detect.classify_batch(t.ev.select("id", text.alias("txt")), kind, "txt", ["id"]).select(F.lit(kind).alias("kind"), "id", "event_type", "severity")
        out = one if out is None else out.unionByName(one)
    return out


@query("select id, case id % 3 when 0 then 'HIGH_COURT_ATTACHMENT' when 1 then 'HIGH_COURT_INJUNCTION' else 'HIGH_COURT_COMMERCIAL_SUIT' end as event_type, case id % 3 when 0 then 'CRITICAL' else 'ALERT' end as severity from ev where id % 3 < 2 or coalesce(case when id % 5 > 0 then floor(value * 400000) end, 0) > 10000000")
def o17_commercial_suits(t):
    """A commercial suit counts only above a crore; one without a claim does not."""
    text = F.element_at(F.array(F.lit("Attachment ordered"), F.lit("Interim INJUNCTION"), F.lit("Recovery suit")), (F.col("id") % 3 + 1).cast("int"))
    return detect.classify_suits(t.ev.select("id", text.alias("txt"), F.when(F.col("id") % 5 > 0, F.floor(F.col("value") * 400_000)).alias("claim")), "txt", "claim", ["id"])


@query(_SNAP + " select cin, 'CAPITAL_INCREASE' as event_type, 'INFO' as severity from b where io and inn and oc > 0 and (nc - oc) / oc > 0.5")
def o10_capital_increases(t):
    return detect.capital_increases(*_snapshots(t))


@query(_SNAP + """, up as (select distinct cin from b where io and inn and oc > 0 and (nc - oc) / oc > 0.5), gone as (select n.cin, max(cast(din as int)) as d from edge n where cast(din as int) % 3 = 0 and cast(din as int) % 5 <> 0 and cessation_date is not null group by n.cin)
select cin, 'UNSTABLE_GROWTH' as rule, 'WATCH' as severity, [1::bigint, d + 10] as event_ids from up join gone using (cin)""")
def o10_unstable_growth_of_detected_events(t):
    """Composite signals from what the detectors themselves report: capital that rises (I1) and directors who resign (I2)."""
    e = t.edge.withColumn("d", F.col("din").cast("int"))
    was = e.filter("d % 5 <> 0").withColumn("cessation_date", F.expr("case when d % 3 = 0 then null else cessation_date end"))
    left = detect.diff_directors(was, e).filter("event_type = 'DIRECTOR_RESIGNED'").select((F.col("din").cast("long") + 10).alias("id"), "cin", "event_type")
    found = detect.capital_increases(*_snapshots(t)).select(F.lit(1).cast("long").alias("id"), "cin", "event_type").unionByName(left)
    return score.combine_signals(found.withColumn("detected_at", t.event_day), t.company, t.event_day).filter("rule = 'UNSTABLE_GROWTH'")


@query("select cin, cast(id as string) as record_id, case when id % 3 = 0 and floor(value) > 50 then 'LABOUR_MASS_RETRENCHMENT' when id % 3 = 1 then 'LABOUR_BACK_WAGES' else 'LABOUR_INDUSTRIAL_DISPUTE' end as event_type, case when id % 3 = 0 and floor(value) > 50 then 'ALERT' else 'WATCH' end as severity from ev")
def j19_labour_orders(t):
    return detect.classify_labour(t.ev.select("cin", F.col("id").cast("string").alias("record_id"), F.element_at(F.array(F.lit("Retrenchment"), F.lit("Back Wages"), F.lit("other")), (F.col("id") % 3 + 1).cast("int")).alias("order_type"), F.floor("value").alias("affected")))


@query("select id, case id % 4 when 0 then [7] when 1 then [9] when 2 then [10] else [] end as sections from ev")
def j22_sections(t):
    text = F.element_at(F.array(F.lit("petition u/s 7 of IBC"), F.lit("Section 9 filed"), F.lit("IBC 10"), F.lit("section 71")), (F.col("id") % 4 + 1).cast("int"))
    return detect.section_hits(t.ev.select("id", text.alias("txt")), "txt").select("id", "sections")


@query("select n_nationkey as state from nation where n_nationkey % 3 <> 0")
def j23_backfill_guard(t):
    n = t.base("nation").select(F.col("n_nationkey").alias("state"))
    return detect.not_done(n, n.withColumn("complete", F.col("state") % 3 == 0), "state")


# ---- scores ----------------------------------------------------------------------------------

_SCORE = """with ff as (select cin, case when date_of_last_agm is null then case when status = 'Active' then 30.0 else 0.0 end when m < 12 then 100.0 when m < 18 then 70.0 when m < 24 then 40.0 when m < 36 then 15.0 else 0.0 end as filing_freshness from (select *, date_diff('day', date_of_last_agm, date '2001-08-02') / 30.44 as m from company)),
ds as (select cin, case count(*) when 1 then 80.0 when 2 then 50.0 else 20.0 end as director_stability from edge where date_of_appointment >= date '2001-05-04' or cessation_date >= date '2001-05-04' group by cin),
lr as (select cin, case when bool_or(case_type in ('NCLT_7', 'NCLT_9', 'NCLT_10', 'SARFAESI_13_4', 'SARFAESI_AUCTION')) then 5.0 when count(*) >= 3 then 20.0 when count(*) filter (where case_type = 'SEC_138') between 1 and 2 then 50.0 when count(*) = 1 then 80.0 else 100.0 end as legal_risk from legal where status not in ('Disposed', 'Dismissed', 'Withdrawn', 'Closed') group by cin),
fh as (select cin, case when d is null then 50.0 when d < 1 then 100.0 when d <= 2 then 70.0 when d <= 4 then 40.0 else 15.0 end as financial_health from (select cin, arg_max({'d': debt_to_equity}, financial_year).d as d from finance group by cin)),
cw as (select cin, max_by(floor(value)::bigint * 40000, epoch_us(detected_at)::hugeint * 100000000 + id)::double as was from ev where event_type = 'CAPITAL_CHANGE' group by cin),
ct as (select c.cin, case when was is null or was = 0 then 50.0 when (authorized_capital::double - was) / was * 100 > 5 then 100.0 when (authorized_capital::double - was) / was * 100 >= -5 then 60.0 else 20.0 end as capital_trajectory from company c left join cw using (cin)),
parts as (select c.cin, filing_freshness, coalesce(director_stability, 100.0) as director_stability, coalesce(legal_risk, 100.0) as legal_risk, coalesce(financial_health, 50.0) as financial_health, capital_trajectory from company c left join ff using (cin) left join ds using (cin) left join lr using (cin) left join fh using (cin) left join ct using (cin)),
sc as (select *, round(cast(filing_freshness * 0.25 + director_stability * 0.2 + legal_risk * 0.25 + financial_health * 0.2 + capital_trajectory * 0.1 as double), 1) as score from parts),
bd as (select *, case when score >= 70 then 'GREEN' when score >= 40 then 'AMBER' else 'RED' end as band from sc),
act as (select distinct din, cin from edge where cessation_date is null), peer as (select distinct a.cin, b.cin as peer from act a join act b on a.din = b.din and a.cin <> b.cin),
pen as (select p.cin, sum(case band when 'RED' then 15 else 5 end) as penalty, count(*) as peers, list_sort(list(p.peer)) as contributors from peer p join bd on bd.cin = p.peer where band in ('RED', 'AMBER') group by p.cin)"""


def _parts(t):
    return score.components(t.company, t.edge, t.legal, t.finance, _capital_events(t), t.order_day)


def _capital_events(t):
    """Events whose capital changes tell the capital before them."""
    before = F.concat(F.lit('{"previous_capital":'), (F.floor("value") * 40_000).cast("string"), F.lit("}"))
    return t.ev.withColumn("data_json", F.when(F.col("event_type") == "CAPITAL_CHANGE", before).otherwise(F.col("data_json")))


@query(_SCORE + " select cin, filing_freshness::double as filing_freshness, director_stability::double as director_stability, legal_risk::double as legal_risk, financial_health::double as financial_health, capital_trajectory::double as capital_trajectory from parts")
def k1_k5_components(t):
    return _parts(t).select("cin", *fixed.WEIGHTS)


@query(_SCORE + ", f as (select bd.cin, coalesce(penalty, 0)::bigint as penalty, round(greatest(0, least(100, score - coalesce(penalty, 0))), 1)::double as score from bd left join pen using (cin)) select cin, penalty, score, case when score >= 70 then 'GREEN' when score >= 40 then 'AMBER' else 'RED' end as band, cast(floor(score) as int) as score_stored from f")
def k6_health_score(t):
    parts = kept(_parts(t))
    pen = score.contagion_penalty(score.peers(t.edge), score.weigh(parts).select("cin", "band"))
    return score.weigh(parts, pen).select("cin", F.col("penalty").cast("long").alias("penalty"), "score", "band", "score_stored")


@query(_SCORE + " select cin, penalty::bigint as penalty, peers::bigint as peers, contributors from pen")
def k7_c6_contagion_penalty(t):
    return score.contagion_penalty(score.peers(t.edge), score.weigh(_parts(t)).select("cin", "band")).select("cin", F.col("penalty").cast("long").alias("penalty"), "peers", "contributors")


_REACH = _SCORE + """, ch as (select cin from bd where band = 'RED'), l1 as (select p.peer as cin, min([ch.cin]) as via from peer p join ch on p.cin = ch.cin where p.peer not in (select cin from ch) group by p.peer),
r1 as (select l1.cin, 1 as depth, via[1] as origin, list_append(via, l1.cin) as chain, coalesce(penalty, 0) as penalty, score as score_before, round(greatest(0.0, score - coalesce(penalty, 0)), 1) as score_after, band as band_before from l1 join bd using (cin) left join pen using (cin)),
s1 as (select *, case when score_after >= 70 then 'GREEN' when score_after >= 40 then 'AMBER' else 'RED' end as band_after from r1),
b2 as (select bd.cin, score, coalesce(band_after, band) as band from bd left join s1 using (cin)), done as (select cin from ch union select cin from s1),
l2 as (select p.peer as cin, min(s1.chain) as via from peer p join s1 on p.cin = s1.cin and s1.band_after <> s1.band_before where p.peer not in (select cin from done) group by p.peer),
pen2 as (select p.cin, sum(case band when 'RED' then 15 else 5 end) as penalty from peer p join b2 on b2.cin = p.peer where band in ('RED', 'AMBER') group by p.cin),
r2 as (select l2.cin, 2 as depth, via[1] as origin, list_append(via, l2.cin) as chain, coalesce(penalty, 0) as penalty, score as score_before, round(greatest(0.0, score - coalesce(penalty, 0)), 1) as score_after, band as band_before from l2 join b2 using (cin) left join pen2 using (cin)),
s2 as (select *, case when score_after >= 70 then 'GREEN' when score_after >= 40 then 'AMBER' else 'RED' end as band_after from r2),
re as (select * from s1 union all select * from s2)"""


@query(_REACH + " select cin, depth, origin, chain, penalty::bigint as penalty, score_before::double as score_before, score_after::double as score_after, band_before, band_after from re")
def k8_propagate_contagion(t):
    first = kept(score.weigh(_parts(t)).select("cin", "score", "band"))
    return score.propagate(first, t.edge, first.filter("band = 'RED'"), kept).withColumn("penalty", F.col("penalty").cast("long"))


@query(_REACH + """ select cin, 'CONTAGION_ENGINE' as source, 'CONTAGION_PROPAGATED' as event_type, 'WATCH' as severity, timestamp '2001-08-02 00:00:00' as detected_at, concat('{"origin_cin":"', origin, '","depth":', (depth - 1)::varchar, ',"chain":["', array_to_string(chain, '","'), '"]}') as data_json from re""")
def k8_contagion_events(t):
    first = kept(score.weigh(_parts(t)).select("cin", "score", "band"))
    return score.contagion_events(score.propagate(first, t.edge, first.filter("band = 'RED'"), kept), t.order_day)


@query(_SCORE + " select id, ev.cin, event_type, severity, 50 as health_score_before, cast(floor(score) as int) as health_score_after, band from ev join bd using (cin)")
def k9_apply_scores(t):
    return score.apply_scores(t.ev, score.weigh(_parts(t)))


@query(_SCORE + " select cin, case when k % 4 = 0 then 11 else cast(floor(score) as int) end as health_score, case when k % 4 = 0 then 'OLD' else band end as health_band, case when k % 4 > 0 then timestamp '2001-08-02 00:00:00' end as last_score_computed_at from company join bd using (cin)")
def k9_scored_master(t):
    m = t.company.select("cin", "k", F.lit(11).alias("health_score"), F.lit("OLD").alias("health_band"))
    return score.scored_master(m.drop("k"), score.weigh(_parts(t)).join(m.filter("k % 4 > 0").select("cin"), "cin", "left_semi"), t.order_day)


@query(_SCORE + " select ev.cin, id as event_id, cast(floor(score) as int) as health_score_at_firing, severity, timestamp '2001-08-02 00:00:00' as fired_at from ev join bd using (cin)")
def k9_predictions(t):
    return score.predictions_of(t.ev, score.weigh(_parts(t)), t.order_day)


#: every type that a rule names, and what stands for one
_KINDS_OF_RULES = sorted({x for _, _, conditions in fixed.COMPOSITES.values() for c in conditions if isinstance(c, list) for x in c} | set(fixed.EVENT_ALIASES))
_KIND_SQL = "['" + "', '".join(_KINDS_OF_RULES) + "']"


def _combo_sql(more: str = "", source: str | None = None) -> str:
    """All rules: the newest event of each condition within the rule's days, where every condition has one. source: select
    statement of the events (id, cin, raw, detected_at)."""
    source = source or f"select id, {cin('((user_id // 25) * 25 + 1)')} as cin, {_KIND_SQL}[id % {len(_KINDS_OF_RULES)} + 1] as raw, detected_at from ev"
    stands = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.EVENT_ALIASES.items())
    out = [f"with e as ({source}), n as (select id, cin, case raw {stands} else raw end as et, epoch_us(detected_at)::hugeint * 100000000 + id as tm, detected_at from e where detected_at <= timestamp '2024-01-31 00:00:00')"]
    parts = []
    for rule, (severity, window, conditions) in fixed.COMPOSITES.items():
        typed = [c for c in conditions if isinstance(c, list)]
        best = ["max_by(id, tm) filter (where et in ('" + "', '".join(c) + "'))" for c in typed]
        status = "".join(f" and cin in (select cin from company where status = '{c['status']}')" for c in conditions if isinstance(c, dict))
        parts.append(f"select cin, '{rule}' as rule, '{severity}' as severity, list_sort(list_distinct(list_value({', '.join(best)}))) as event_ids from n where detected_at >= timestamp '2024-01-31 00:00:00' - interval {window or 365} days{status} group by cin having " + " and ".join(f"{b} is not null" for b in best))
    out.append("s as (" + " union all ".join(parts) + ")")
    return ", ".join(out) + " select cin, rule, severity, event_ids from s" + more


def _signals(t):
    kind = F.element_at(F.array(*map(F.lit, _KINDS_OF_RULES)), (F.col("id") % len(_KINDS_OF_RULES) + 1).cast("int"))
    return t.ev.select("id", F.expr(cin("(floor(user_id / 25) * 25 + 1)")).alias("cin"), kind.alias("event_type"), "detected_at")


@query(_combo_sql())
def k10_f6_combine_signals(t):
    return score.combine_signals(_signals(t), t.company, t.event_day)


_TRIGGERED = " or ".join("rule = '{0}' and exists (select 1 from n where n.cin = s.cin and id % 50 = 0 and et in ('{1}'))".format(rule, "', '".join(x for c in conditions if isinstance(c, list) for x in c)) for rule, (_, _, conditions) in fixed.COMPOSITES.items())


@query(_combo_sql(f" where ({_TRIGGERED}) and not (substring(cin, 16)::int % 2 = 0 and rule = 'ZOMBIE_COMPANY') and not (substring(cin, 16)::int % 3 = 0 and rule = 'FUNDED_GROWTH')"))
def k10_c8_triggered_signals(t):
    """Only rules that name a new event of the company (one of fifty is new), none whose own name is among its events, and
    none that has fired within the last 30 days."""
    e = _signals(t)
    named = e.filter("cast(substring(cin, 16) as int) % 2 = 0").select("cin").distinct()
    own = named.select(F.lit(-1).cast("long").alias("id"), "cin", F.lit("ZOMBIE_COMPANY").alias("event_type"), (t.event_day - F.expr("INTERVAL 300 DAYS")).alias("detected_at"))
    old = named.select(F.lit(-2).cast("long").alias("id"), "cin", F.lit("FUNDED_GROWTH").alias("event_type"), (t.event_day - F.expr("INTERVAL 400 DAYS")).alias("detected_at"))
    fired = e.filter("cast(substring(cin, 16) as int) % 3 = 0").select("cin", F.lit("FUNDED_GROWTH").alias("rule"), (t.event_day - F.expr("INTERVAL 20 DAYS")).alias("detected_at")).distinct()
    return score.combine_signals(e.unionByName(own).unionByName(old), t.company, t.event_day, fired=fired, new=e.filter("id % 50 = 0").select("cin", "event_type"))


@query("""with act as (select distinct din, cin from edge where cessation_date is null), b as (select din, count(*) as boards from act group by din having count(*) >= 2), x as (select cin, max(boards) as boards, max_by(act.din, boards * 100000000 + cast(act.din as int)) as din from act join b using (din) group by cin),
lost as (select cin, bool_or(event_type = 'AGM_OVERDUE') as epfo, bool_or(event_type = 'GST_CANCELLED') as gst from ev group by cin)
select c.cin, x.din, boards::bigint as boards from company c join x using (cin) left join lost using (cin) where date_of_last_agm is null and date_diff('month', date_of_incorporation, date '2001-08-02') < 72 and authorized_capital <= 10000000
and (k % 2 = 0 or coalesce(epfo, false)) and (k % 3 = 0 or coalesce(gst, false)) and k % 13 > 0""")
def k11_c7_shell_companies(t):
    m = t.company.withColumn("epfo_id", F.when(F.col("k") % 2 > 0, "E")).withColumn("gstin", F.when(F.col("k") % 3 > 0, "G"))
    # the events are dated to the month before, as the companies are of 2001
    e = t.ev.select("cin", F.when(F.col("event_type") == "AGM_OVERDUE", "EPFO_ESTABLISHMENT_DELISTED").otherwise(F.col("event_type")).alias("event_type"), (t.order_day - F.expr("INTERVAL 30 DAYS")).alias("detected_at"))
    stale = e.withColumn("event_type", F.lit("GST_SUSPENDED")).withColumn("detected_at", t.order_day - F.expr("INTERVAL 13 MONTHS"))
    fired = t.company.filter("k % 13 = 0").select("cin", (t.order_day - F.expr("INTERVAL 10 DAYS")).alias("detected_at"))
    return score.shell_companies(m, t.edge, t.order_day, boards=2, months=72, capital=10_000_000, fired=fired, events=e.unionByName(stale))


@query(_SCORE + " select c.registered_state, c.industrial_class, count(*)::bigint as stressed, list_sort(list(c.cin)) as cins from bd join company c using (cin) where band in ('RED', 'AMBER') and status = 'Active' and not (registered_state in ('N1', 'N2') and industrial_class = 'BUILDING') group by 1, 2 having count(*) >= 3")
def k12_d5_sector_clusters(t):
    s = score.weigh(_parts(t)).select("cin", "band").join(t.company.select("cin", "status", "registered_state", "industrial_class"), "cin").withColumn("scored_at", t.order_day)
    ago = lambda days: (t.order_day - F.expr(f"INTERVAL {days} DAYS")).alias("detected_at")
    group = t.company.filter("industrial_class = 'BUILDING'").select("registered_state", "industrial_class").distinct()
    fired = group.filter("registered_state in ('N1', 'N2')").select("*", ago(10)).unionByName(group.filter("registered_state = 'N3'").select("*", ago(40)))
    return score.sector_clusters(s, t.order_day, least=3, fired=fired)


@query("select distinct cin, event_type from ev where detected_at >= timestamp '2024-01-20 00:00:00'")
def k13_unscored_events(t):
    return score.unscored(t.ev.withColumn("health_score_after", F.lit(None).cast("int")), F.lit("2024-01-20 00:00:00").cast("timestamp"), 0)


@query(_SCORE + """, e as (select cin, string_agg(concat(r::varchar, ':', id::varchar, ':', event_type, ':', severity), ',' order by r) as x from (select *, row_number() over (partition by cin order by detected_at desc, id desc) as r from ev) where r <= 10 group by cin),
l as (select cin, string_agg(concat(case_number, ':', case_type, ':', status), ',' order by case_number, case_type, status) as x from legal group by cin), d as (select cin, string_agg(concat(case when cessation_date is not null then 'true' else 'false' end, ':', din), ',' order by cessation_date is not null, din) as x from edge group by cin)
select p.cin, round(filing_freshness * 0.25, 2)::double as filing_freshness_weighted, round(capital_trajectory * 0.1, 2)::double as capital_trajectory_weighted, coalesce(e.x, '') as events, coalesce(l.x, '') as cases, coalesce(d.x, '') as directors from parts p left join e using (cin) left join l using (cin) left join d using (cin)""")
def k14_company_profile(t):
    p = score.company_profile(_parts(t), t.ev, t.legal, t.edge)
    written = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.array_join(F.array(*[x[f].cast("string") for f in p.schema[c].dataType.elementType.names]), ":")), ","), F.lit("")).alias(c)
    return p.select("cin", "filing_freshness_weighted", "capital_trajectory_weighted", written("events"), written("cases"), written("directors"))


# ---- routing ---------------------------------------------------------------------------------


def _watch(t):
    w = t.watch.withColumn("type_filter", F.when(F.col("one_type").isNotNull(), F.array("one_type")))
    lists = t.entry_.groupBy(F.col("subscriber_id").alias("watchlist_id")).agg(F.array_sort(F.collect_set("cin")).alias("cin_list"))
    return w.join(lists, "watchlist_id", "left").withColumn("cin_list", F.when(F.col("by_company"), F.coalesce("cin_list", F.array().cast("array<string>")))).select("watchlist_id", "state_filter", "sector_filter", "severity_min", "type_filter", "cin_list", "is_active")


def _alerts(t):
    return route.match_watchlists(t.ev, _watch(t), t.company)


_R = "case {0} when 'INFO' then 1 when 'WATCH' then 2 when 'ALERT' then 3 when 'CRITICAL' then 4 else 0 end"
_ALERT = f"""with al as (select ev.id as event_id, watchlist_id, ev.cin, ev.severity, detected_at from ev left join company c on c.cin = ev.cin join watch w on is_active and (not by_company or exists (select 1 from entry_ e where e.subscriber_id = watchlist_id and e.cin = ev.cin))
and (state_filter is null or state_filter = registered_state) and (sector_filter is null or sector_filter = industrial_class) and {_R.format('ev.severity')} >= {_R.format('severity_min')} and (one_type is null or one_type = event_type))"""


@query(_ALERT + " select event_id, watchlist_id, cin, severity from al")
def l1_c12_match_watchlists(t):
    return _alerts(t).select("event_id", "watchlist_id", "cin", "severity")


@query("select id, severity from ev where id % 3 > 0 and epoch(timestamp '2024-01-31 00:00:00') - epoch(detected_at) >= 3600 * case severity when 'CRITICAL' then 0 when 'ALERT' then 4 when 'WATCH' then 24 else 168 end or id % 3 = 0 and severity = 'CRITICAL' and id % 5 < 3")
def l2_due_alerts(t):
    a = t.ev.select("id", "severity", F.col("detected_at").alias("created_at"), F.when(F.col("id") % 3 == 0, "FAILED").otherwise("PENDING").alias("delivery_status"), (F.col("id") % 5).alias("retry_count"))
    return route.due_alerts(a, t.event_day).select("id", "severity")


def _digests(t):
    return route.build_digests(_alerts(t).withColumn("alert_id", F.col("event_id") * 100 + F.col("watchlist_id")).withColumn("score_before", F.col("event_id") % 100).withColumn("score_after", F.col("event_id") % 90))


_DIGEST = _ALERT + f", dg as (select watchlist_id, cin, count(*)::bigint as n_events, max_by(severity, {_R.format('severity')}) as max_severity, min_by(event_id % 100, epoch_us(detected_at)) as score_before, max_by(event_id % 90, epoch_us(detected_at)) as score_after, substring(md5(string_agg((event_id * 100 + watchlist_id)::varchar, ',' order by event_id)), 1, 16) as batch_id from al group by 1, 2)"


@query(_DIGEST + " select watchlist_id, cin, n_events, max_severity, score_before, score_after, batch_id from dg")
def l3_f8_build_digests(t):
    return _digests(t).drop("alert_ids")


@query(_DIGEST + """, o as (select batch_id, n_events % 3 as m from dg where n_events % 4 > 0) select dg.batch_id, watchlist_id, cin, case when max_severity = 'CRITICAL' then ['telegram', 'email'] else ['email'] end as channels, case when o.m is null then 'PENDING' when o.m = 1 then 'DELIVERED' when o.m = 2 then 'PERMANENTLY_FAILED' else 'FAILED' end as delivery_status, cast(case when o.m is null then 0 when o.m = 1 then 1 else o.m + 1 end as bigint) as retry_count from dg left join o using (batch_id)""")
def l4_l6_mark_delivery(t):
    d = kept(_digests(t))
    o = d.filter("n_events % 4 > 0").select("batch_id", (F.col("n_events") % 3 == 1).alias("ok"), (F.col("n_events") % 3).alias("retry_count"))
    return route.mark_delivery(d, o)


@query(_DIGEST + """ select cin, 'routing' as source, 'TELEGRAM_DELIVERY_FAILED' as event_type, 'ALERT' as severity, timestamp '2024-01-31 00:00:00' as detected_at, concat('{"watchlist_id":', watchlist_id::varchar, ',"batch_id":"', batch_id, '"}') as data_json from dg where n_events % 4 > 0 and n_events % 3 = 2""")
def l4_delivery_events(t):
    d = kept(_digests(t))
    o = d.filter("n_events % 4 > 0").select("batch_id", (F.col("n_events") % 3 == 1).alias("ok"), (F.col("n_events") % 3).alias("retry_count"))
    return route.delivery_events(route.mark_delivery(d, o), t.event_day)


_S = "case {0} when 'INFO' then 0 when 'WATCH' then 1 when 'AMBER' then 2 when 'RED' then 3 when 'ALERT' then 3 when 'CRITICAL' then 4 else 0 end"


@query(f"select ev.id, e.subscriber_id, ev.cin, ev.event_type, ev.severity from ev join entry_ e using (cin) join subscriber s using (subscriber_id) where {_S.format('ev.severity')} >= {_S.format('severity_threshold')} and not exists (select 1 from ev p where p.id % 4 = 0 and p.cin = ev.cin and p.event_type = ev.event_type and p.detected_at <= ev.detected_at and epoch(ev.detected_at) - epoch(p.detected_at) < 86400)")
def l5_c15_subscriber_targets(t):
    past = t.ev.filter("id % 4 = 0").join(t.entry_, "cin").select("subscriber_id", "cin", "event_type", F.col("detected_at").alias("delivered_at"))
    return route.subscriber_targets(t.ev, t.subscriber, t.entry_, past).drop("channels")


@query(_DIGEST + " select watchlist_id, cin, concat('- ', cin, ': ', n_events::varchar, ' new events', chr(10), '- Highest severity: ', max_severity, chr(10), '- Indicative score: ', score_after::varchar) as summary, true as well_formed from dg")
def l7_l8_digest_text(t):
    return route.digest_text(_digests(t)).select("watchlist_id", "cin", "summary", "well_formed")


@query("select id, id % 5 = 0 as well_formed from ev")
def l8_bullet_check(t):
    """Three lines with a dash each; two, four, one without a dash and an empty text are not."""
    texts = ["- a\n- b\n- c", "- a\n- b", "- a\n- b\n- c\n- d", "- a\nb\n- c", ""]
    return t.ev.select("id", route.bullets_ok(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 5 + 1).cast("int"))).alias("well_formed"))


def _delivered(t):
    return t.ev.join(t.entry_, "cin").select("subscriber_id", "cin", "event_type", F.col("detected_at").alias("delivered_at"))


_DLV = "with dl as (select subscriber_id, cin, event_type, detected_at as delivered_at from ev join entry_ using (cin))"


@query(_DLV + " select subscriber_id, t.cin, coalesce(company_name, t.cin) as company, event_type, delivered_at, (select max(detected_at) from ev where ev.cin = t.cin and ev.event_type = t.event_type) as last_event_at from (select * from dl order by delivered_at desc, subscriber_id, cin, event_type limit 50) t left join company c on c.cin = t.cin")
def l9_c9_alert_feed(t):
    return route.alert_feed(_delivered(t), t.company, t.ev)


@query(_DLV + " select s.subscriber_id, severity_threshold, coalesce((select count(distinct cin) from entry_ e where e.subscriber_id = s.subscriber_id), 0)::bigint as watching, coalesce((select count(*) from dl where dl.subscriber_id = s.subscriber_id and delivered_at >= timestamp '2024-01-01 00:00:00'), 0)::bigint as this_month from subscriber s")
def l10_subscriber_overview(t):
    return route.subscriber_overview(t.subscriber, t.entry_, _delivered(t), t.event_day)


@query("select subscriber_id, entry_.cin, company_name as company, registered_state from entry_ left join company using (cin)")
def l11_watchlist_entries(t):
    return route.watchlist_entries(t.entry_, t.company)


@query("""with recursive o as (select id, cin, event_type, epoch_us(detected_at) as tm, row_number() over (partition by cin, event_type order by detected_at, id) as r from ev),
f as (select id, cin, event_type, r, tm as last, true as fires from o where r = 1 union all select o.id, o.cin, o.event_type, o.r, case when tm - last >= 172800000000 then tm else last end, tm - last >= 172800000000 from f join o on o.cin = f.cin and o.event_type = f.event_type and o.r = f.r + 1)
select id, cin, event_type from f where fires""")
def f10_cool_down(t):
    return route.cool_down(t.ev, 2).select("id", "cin", "event_type")


# ---- feedback and operations -----------------------------------------------------------------


@query("select count(*)::bigint as alerts, count(*) filter (where confirmed)::bigint as confirmed, count(*) filter (where false_positive)::bigint as false_positives, 0::bigint as expired, round(count(*) filter (where confirmed) * 100.0 / (count(*) filter (where confirmed) + count(*) filter (where false_positive)), 1)::double as accuracy from pred where fired_at >= timestamp '2024-01-01 00:00:00'")
def m1_d4_accuracy(t):
    return route.accuracy(t.pred, t.event_day)


@query("select e as event_type, count(*)::bigint as n from (select unnest([severity, concat('S', (prediction_id % 7)::varchar)]) as e from pred where false_positive) group by e order by n desc, e limit 5")
def m2_d8_top_reasons(t):
    return route.top_reasons(t.pred.withColumn("event_combination", F.array("severity", F.concat(F.lit("S"), (F.col("prediction_id") % 7).cast("string")))))


@query("""with f as (select cin, fired_at + interval 30 minutes as delivered_at, case when prediction_id % 2 = 0 then 'confirmed' else 'false_positive' end as verdict from pred where prediction_id % 3 = 0), m as (select f.*, prediction_id, row_number() over (partition by f.cin, delivered_at, verdict order by fired_at desc, prediction_id desc) as r from f join pred p on p.cin = f.cin and abs(epoch(f.delivered_at) - epoch(p.fired_at)) <= 3600)
select prediction_id, cin, verdict = 'confirmed' as confirmed, verdict = 'false_positive' as false_positive from m where r = 1""")
def m3_c10_apply_feedback(t):
    f = t.pred.filter("prediction_id % 3 = 0").select("cin", (F.col("fired_at") + F.expr("INTERVAL 30 MINUTES")).alias("delivered_at"), F.when(F.col("prediction_id") % 2 == 0, "confirmed").otherwise("false_positive").alias("verdict"))
    return route.apply_feedback(f, t.pred)


@query("select prediction_id, confirmed is null and false_positive is null and fired_at < timestamp '2024-01-10 00:00:00' as expired from pred")
def m4_expire(t):
    return route.expire(t.pred, F.lit("2024-01-10 00:00:00").cast("timestamp"), 0).select("prediction_id", "expired")


@query("""with m as (select source, p.severity, false_positive, confirmed from pred p join ev e on e.cin = p.cin and e.severity = p.severity and abs(epoch(p.fired_at) - epoch(e.detected_at)) <= 7200 where fired_at >= timestamp '2024-01-31 00:00:00' - interval 90 days), g as (select source, severity, count(*) as n, count(*) filter (where false_positive) as fp, count(*) filter (where confirmed) as ok from m group by 1, 2 having count(*) >= 5)
select source, severity, n::bigint as samples, round(fp / n, 4)::double as fp_rate, case when fp / n > 0.2 then 'raise' when ok / n > 0.95 and n >= 10 then 'lower' else 'keep' end as action from g""")
def m5_c11_recalibrate(t):
    return route.recalibrate(t.pred, t.ev, t.event_day)


@query("with b as (select log_date, service, operation, sum(cost_inr) as cost, sum(units)::bigint as units from cost group by 1, 2, 3) select *, sum(cost) over (partition by log_date) as day_total, sum(cost) over (partition by log_date) > 500 as breached from b")
def m6_d13_cost_summary(t):
    return route.cost_summary(t.cost)


@query("select coalesce(sum(units), 0)::bigint as used, greatest(500 - coalesce(sum(units), 0), 0)::bigint as left from cost where service = 'click' and log_date >= date '2024-01-01'".replace("as left", 'as "left"'))
def m7_call_budget(t):
    return route.call_budget(t.cost, t.event_day, "click")


_PULLS = "with p as (select concat('s', (event_id % 4)::varchar) as source_id, cast(ts as timestamp) as pull_at, event_id as id, event_type = 'error' as failed from events)"


def _pulls(t):
    return t.base("events").select(F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source_id"), F.col("ts").cast("timestamp").alias("pull_at"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))


@query(_PULLS + ", i as (select *, sum(case when failed then 0 else 1 end) over (partition by source_id order by pull_at, id) as g from p), f as (select *, sum(case when failed then 1 else 0 end) over (partition by source_id, g order by pull_at, id)::bigint as failures from i) select source_id, id, failures, case when failures >= 4 then 'UNREACHABLE' when failures > 0 then 'DEGRADED' else 'OK' end as state, failures = 4 as operator_event from f")
def m9_failure_ladder(t):
    return route.failure_ladder(_pulls(t)).select("source_id", "id", "failures", "state", "operator_event")


@query("select cin as source_id, s as status, (k % 3)::int as consecutive_failures, case when k % 7 > 0 and (k % 50) - 20 > 0 then round((k % 50) - 20, 2)::double end as lag, case when k % 7 = 0 then 'grey' when s = 'UNREACHABLE' then 'red' when s = 'DEGRADED' or k % 3 > 0 then 'amber' else 'green' end as colour, (case when k % 7 = 0 then 3 when s = 'UNREACHABLE' then 2 when k % 3 > 0 then 1 else 0 end)::int as problem from (select cin, k, ['OK', 'DEGRADED', 'UNREACHABLE'][k % 3 + 1] as s from company)")
def m8_b22_b23_g4_source_status(t):
    s = t.company.select(F.col("cin").alias("source_id"), F.element_at(F.array(F.lit("OK"), F.lit("DEGRADED"), F.lit("UNREACHABLE")), (F.col("k") % 3 + 1).cast("int")).alias("status"), (F.col("k") % 3).cast("int").alias("consecutive_failures"), F.when(F.col("k") % 7 > 0, t.event_day).alias("last_pull_at"), F.when(F.col("k") % 7 > 0, t.event_day - F.make_interval(hours=(F.col("k") % 50 - 20).cast("int"))).alias("next_pull_at"))
    return route.source_status(s, t.event_day)


@query("select cin as source_id, timestamp '2024-01-31 00:00:00' - ((k % 50) - 20) * interval 1 hour as next_pull_at, ['OK', 'DEGRADED', 'UNREACHABLE'][k % 3 + 1] as status, round((k % 50) - 20, 2)::double as lag_hours from company where k % 7 > 0 and (k % 50) - 20 > 0")
def g3_past_due(t):
    s = t.company.select(F.col("cin").alias("source_id"), F.element_at(F.array(F.lit("OK"), F.lit("DEGRADED"), F.lit("UNREACHABLE")), (F.col("k") % 3 + 1).cast("int")).alias("status"), F.when(F.col("k") % 7 > 0, t.event_day - F.make_interval(hours=(F.col("k") % 50 - 20).cast("int"))).alias("next_pull_at"))
    return route.past_due(s, t.event_day)


@query("select id, cin from ev where detected_at + interval 5 days < timestamp '2024-01-20 00:00:00' and id % 9 > 0")
def m13_expired_cache(t):
    rows = t.ev.select("id", "cin", F.when(F.col("id") % 9 > 0, F.col("detected_at") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    return route.expired_rows(rows, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "cin")


@query("select id, severity, detected_at from ev where detected_at between timestamp '2024-01-20 00:00:00' - interval 24 hours and timestamp '2024-01-20 00:00:00' order by case severity when 'CRITICAL' then 4 when 'ALERT' then 3 when 'WATCH' then 2 else 1 end desc, detected_at desc, id desc limit 5")
def g1_m10_top_events(t):
    return route.top_events(t.ev, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "severity", "detected_at")


@query("""with s as (select case when k % 7 = 0 then 'grey' when k % 5 = 0 or k % 4 = 3 then 'red' when k % 4 > 0 then 'amber' else 'green' end as colour from company), p as (select * from pred where severity = 'CRITICAL' and fired_at >= timestamp '2024-01-20 00:00:00' - interval 30 days)
select 'top event' as section, cast(row_number() over (order by case severity when 'CRITICAL' then 4 when 'ALERT' then 3 when 'WATCH' then 2 else 1 end desc, detected_at desc, id desc) as int) as place, concat(coalesce(company_name, ev.cin), ' ', event_type, ' ', severity) as label, id::double as value from ev left join company using (cin) where detected_at between timestamp '2024-01-20 00:00:00' - interval 24 hours and timestamp '2024-01-20 00:00:00' qualify place <= 5
union all select 'sources', 0, colour, count(*)::double from s group by colour union all select 'costs', 0, concat(service, ' ', operation), round(sum(cost_inr), 4)::double from cost where log_date = date '2024-01-20' group by service, operation
union all select 'critical predictions', 0, 'all', count(*)::double from p union all select 'critical predictions', 0, 'confirmed', count(*) filter (where confirmed)::double from p union all select 'critical predictions', 0, 'per cent', case when count(*) > 0 then round(count(*) filter (where confirmed) * 100.0 / count(*), 1)::double else 0 end from p
union all (select 'commonest false reason', 0, concat('R', (prediction_id % 5)::varchar) as r, count(*)::double as n from pred where false_positive and fired_at >= timestamp '2024-01-20 00:00:00' - interval 30 days group by r order by n desc, r limit 1) union all select 'open names', 0, 'unresolved', count(*)::double from ev where id % 3 > 0""")
def m10_daily_digest(t):
    day = F.lit("2024-01-20 00:00:00").cast("timestamp")
    state = t.company.select(F.col("cin").alias("source_id"), F.when(F.col("k") % 5 == 0, "Blocked").otherwise("OK").alias("status"), (F.col("k") % 4).cast("int").alias("consecutive_failures"), F.when(F.col("k") % 7 > 0, day).alias("last_pull_at"))
    wrong = t.pred.withColumn("false_positive_reason", F.concat(F.lit("R"), (F.col("prediction_id") % 5).cast("string")))
    return route.daily_digest(t.ev, t.company, state, t.cost, wrong, t.ev.select((F.col("id") % 3 == 0).alias("resolved")), day)


@query("select id, cin, severity, source from ev where severity in ('CRITICAL', 'ALERT') and source = 's1' order by detected_at desc, id desc limit 100")
def g2_event_feed(t):
    return t.ev.filter(F.col("severity").isin("CRITICAL", "ALERT") & (F.col("source") == "s1")).orderBy(F.desc("detected_at"), F.desc("id")).limit(100).select("id", "cin", "severity", "source")


@query("select din, cin, cast(row_number() over (partition by cin order by case when cessation_date is null then 0 else 1 end, date_of_appointment desc nulls last, din) as int) as rank from edge")
def g5_directors_in_order(t):
    w = Window.partitionBy("cin").orderBy(F.col("cessation_date").isNotNull().cast("int"), F.col("date_of_appointment").desc_nulls_last(), "din")
    return t.edge.select("din", "cin", F.row_number().over(w).alias("rank"))


@query("select event_type, count(*)::bigint as n from ev group by 1 order by n desc, event_type limit 1")
def d7_mode(t):
    return route.mode(t.ev, "event_type")


@query("select source, severity, date_trunc('day', detected_at)::date as day, count(*)::bigint as n, count(distinct cin)::bigint as companies, sum(value)::double as total, count(*) filter (where value > 100)::bigint as large, list_sort(list(distinct event_type)) as kinds from ev group by 1, 2, 3 having count(*) >= 2")
def d1_d6_d12_counts(t):
    return t.ev.groupBy("source", "severity", F.date_trunc("day", "detected_at").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("cin").alias("companies"), F.sum("value").alias("total"), F.count_if(F.col("value") > 100).alias("large"), F.array_sort(F.collect_set("event_type")).alias("kinds")).filter("n >= 2")


@query("select cin, count(*) filter (where case_type = 'NCLT_7')::bigint as nclt, count(*) filter (where case_type = 'SEC_138')::bigint as cheque, max_by(case_number, (epoch(filing_date)::bigint) * 10000000 + substring(case_number, 2)::bigint) as newest from legal group by cin")
def d9_d10_case_pivot(t):
    return t.legal.groupBy("cin").agg(F.count_if(F.col("case_type") == "NCLT_7").alias("nclt"), F.count_if(F.col("case_type") == "SEC_138").alias("cheque"), F.max_by("case_number", F.struct("filing_date", F.expr("cast(substring(case_number, 2) as bigint)"))).alias("newest"))


@query("select cin, id, event_type, cast(row_number() over (partition by cin order by detected_at desc, id desc) as int) as rank from ev qualify rank <= 10")
def f3_recent_events(t):
    return signals.recent_events(t.ev)


@query("select cin, max_by(din, (epoch(coalesce(date_of_appointment, date '1900-01-01'))::bigint) * 100000000 + din::bigint) as din from edge where designation = 'Auditor' group by cin")
def f4_latest_auditor(t):
    return signals.latest_auditor(t.edge)


@query("select channel, status, count(*)::bigint as n from (select unnest(case when severity = 'CRITICAL' then ['telegram', 'email'] else ['email'] end) as channel, case when id % 9 = 0 then 'FAILED' else 'DELIVERED' end as status from ev) group by 1, 2")
def m12_alerts_by_channel(t):
    return t.ev.select(F.explode(route.channels("severity")).alias("channel"), F.when(F.col("id") % 9 == 0, "FAILED").otherwise("DELIVERED").alias("status")).groupBy("channel", "status").agg(F.count("*").alias("n"))


@query("select source, count(*)::bigint as n, count(*) filter (where detected_at < timestamp '2024-01-20 00:00:00')::bigint as expired from ev group by 1 order by n desc, source limit 10")
def m11_m13_events_by_source(t):
    return t.ev.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("detected_at") < F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("expired")).orderBy(F.desc("n"), "source").limit(10)


@query("select distinct e.subscriber_id, ev.cin from ev join entry_ e using (cin)")
def c14_h2_watched_companies(t):
    watched = t.entry_.join(t.ev.select("cin").distinct(), "cin", "left_semi")
    return watched.select("subscriber_id", "cin").distinct()


# ---- from documents --------------------------------------------------------------------------


@query("""with a as (select cin, date_diff('day', filing_date, date '2001-08-02') as age from legal where filing_date <= date '2001-08-02'), n as (select cin, count(*) filter (where age < 400) as k, count(*) filter (where age >= 400) as b, max(age) as o from a group by cin), r as (select cin, k, b / greatest((o - 400) / 30.0, 1.0) as rate from n)
select cin, k::bigint as k, round(rate, 6)::double as rate, round(exp(k * ln(rate) - rate - ln(factorial(k::int)::double)), 8)::double as p, 'CRITICAL' as severity from r where rate > 0 and k > rate and exp(k * ln(rate) - rate - ln(factorial(k::int)::double)) < 0.05""")
def o1_legal_velocity(t):
    return signals.legal_velocity(t.legal, t.order_day, days=400).withColumn("rate", F.round("rate", 6)).withColumn("p", F.round("p", 8))


_MONTHLY = "select cin, date_trunc('month', detected_at)::date as month, count(*)::bigint as n from ev group by 1, 2"


@query("with m as (select cin, date_trunc('day', detected_at)::date as month, count(*)::bigint as n from ev group by 1, 2), l as (select *, lag(n) over (partition by cin order by month) as w from m) select cin, month, case when n / w <= 0.8 then 'EPFO_CONTRIBUTION_DROP' else 'EPFO_HIRING_SURGE' end as event_type from l where n / w <= 0.8 or n / w >= 1.2 union all select cin, month, 'POSTING_SPIKE' from l where n / w > 3")
def o7_o8_monthly_changes(t):
    m = t.ev.groupBy("cin", F.date_trunc("day", "detected_at").cast("date").alias("month")).agg(F.count("*").alias("headcount"), F.count("*").alias("postings"))
    return signals.head_count(m).unionByName(signals.postings(m))


@query("with m as (select cin, date_trunc('day', detected_at)::date as month, count(*)::bigint as n, avg(value)::double as r from ev group by 1, 2), l as (select *, lag(n) over (partition by cin order by month) as w, lag(r) over (partition by cin order by month) as rw from m) select cin, month, 'REVIEW_SPIKE' as event_type from l where n / w > 3 union all select cin, month, 'RATING_LOW' from l where r < 3.0 and rw >= 3.0")
def o8_reviews(t):
    return signals.reviews(t.ev.groupBy("cin", F.date_trunc("day", "detected_at").cast("date").alias("month")).agg(F.count("*").alias("reviews"), F.avg("value").alias("rating")))


@query("with l as (select *, lag(revenue) over w as rw, lag(debt) over w as dw from finance window w as (partition by cin order by financial_year)) select cin, financial_year, 'REVENUE_DROP' as event_type from l where rw <> 0 and revenue / rw <= 0.8 union all select cin, financial_year, 'DEBT_RISE' from l where dw <> 0 and debt / dw >= 1.5")
def o9_financial_change(t):
    return signals.financial_change(t.finance)


@query("with m as (select cin, industrial_class, date_trunc('week', detected_at)::date as month, count(*)::bigint as h, sum(value)::double as d from ev join company using (cin) group by 1, 2, 3), l as (select *, h - lag(h) over w as dh, d - lag(d) over w as dd from m window w as (partition by cin order by month)) select cin, month, round(2.0 * dh - 0.5 * dd, 4)::double as delta, 'WATCH' as severity from l where dh <= 0 and 2.0 * dh - 0.5 * dd < 0")
def o2_working_capital(t):
    m = t.ev.join(t.company.select("cin", "industrial_class"), "cin").groupBy("cin", "industrial_class", F.date_trunc("week", "detected_at").cast("date").alias("month")).agg(F.count("*").alias("headcount"), F.sum("value").alias("filing_delay"))
    k = t.company.select("industrial_class").distinct().select("industrial_class", F.lit(2.0).alias("alpha"), F.lit(0.5).alias("beta"))
    return signals.working_capital(m, k).withColumn("delta", F.round("delta", 4))


@query("""with recursive a as (select distinct din, edge.cin, authorized_capital::double as w from edge join company using (cin) where cessation_date is null and authorized_capital > 0), lk as (select * from a where din in (select din from a group by din having count(*) > 1)),
m as (select b.cin, a.cin as peer, sum(a.w) as coef from lk a join lk b using (din) group by 1, 2),
v as (select 0 as r, cin, 1.0::double as x, 1.0::double as moved from (select distinct cin from lk) union all
  select r + 1, cin, z / top, max(abs(z / top - old)) over () from (select r, m.cin, sum(coef * x) as z, max(case when m.peer = m.cin then x end) as old, max(sum(coef * x)) over () as top from v join m on m.peer = v.cin where (moved >= 0.0001 or r % 5 > 0) and r < 60 group by r, m.cin)),
l as (select cin, x from v where r = (select max(r) from v))
select c.cin, round(coalesce(x, 0), 4)::double as centrality from (select distinct cin from a) c left join l using (cin)""")
def o3_centrality(t):
    return signals.centrality(t.edge, t.company.select("cin", F.col("authorized_capital").alias("capital")), kept)


@query(_SCORE + ", g as (select c.registered_state, c.industrial_class, avg(70 - score) as st, count(*) as n from bd join company c using (cin) group by 1, 2 having count(*) >= 5 and avg(70 - score) > 2) select c.cin, c.registered_state, c.industrial_class, round(st, 4)::double as stress, 'SECTOR_STRESS' as event_type from company c join g on c.registered_state = g.registered_state and c.industrial_class = g.industrial_class")
def o4_sector_stress(t):
    s = score.weigh(_parts(t)).select("cin", F.lit(70.0).alias("score_before"), F.col("score").alias("score_after")).join(t.company.select("cin", "registered_state", "industrial_class"), "cin")
    return signals.sector_stress(s, drop=2.0)


@query("select prediction_id, p.cin, exists (select 1 from ev e where e.cin = p.cin and e.event_type = 'GST_CANCELLED' and e.detected_at between fired_at and fired_at + interval 5 days) as confirmed, not exists (select 1 from ev e where e.cin = p.cin and e.event_type = 'GST_CANCELLED' and e.detected_at between fired_at and fired_at + interval 5 days) and fired_at < timestamp '2024-01-31 00:00:00' - interval 5 days as expired from pred p")
def o5_auto_confirm(t):
    return signals.auto_confirm(t.pred, t.ev, t.event_day, 5, ("GST_CANCELLED",))


@query("with r as (select event_type as component, sum(case when value > 20 then 1 else -1 end) as net from events group by 1) select component, round(greatest(0.1, least(1.0, 0.25 + sign(net) * 0.05)), 4)::double as weight from r")
def o6_recalibrate_weights(t):
    r = t.base("events").select(F.col("event_type").alias("component"), (F.col("value") > 20).alias("ok"))
    return signals.recalibrate_weights(r.select("component").distinct().withColumn("weight", F.lit(0.25)), r)


@query(_SCORE + " select n.din, n.cin, min(a.cin) as red_cin, 'CONTAGIOUS_DIRECTOR' as event_type from edge n join act a on a.din = n.din and a.cin <> n.cin join bd on bd.cin = a.cin and band in ('AMBER', 'RED') where n.date_of_appointment >= date '2000-01-01' group by 1, 2")
def o11_contagious_directors(t):
    b = score.weigh(_parts(t)).select("cin", F.when(F.col("band") == "AMBER", "RED").otherwise(F.col("band")).alias("band"))
    return signals.contagious_directors(t.edge.filter("date_of_appointment >= date'2000-01-01'"), t.edge, b)


@query("select case when date_of_incorporation > date '1999-06-01' then 'date out of range' else 'ok' end as reason, count(*)::bigint as n from company group by 1")
def o12_strict_validation(t):
    df = src.reasons(t.company.withColumn("date_of_incorporation", F.col("date_of_incorporation").cast("string")).withColumn("date_of_last_agm", F.lit(None).cast("string")), as_of=F.lit("1999-06-01").cast("timestamp"), strict=True)
    return df.groupBy(F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("select cin as source_id, round(k % 60 / 1.0, 2)::double as age_hours, 24 as max_hours, k % 60 > 24 as late from company")
def o13_freshness(t):
    s = t.company.select(F.col("cin").alias("source_id"), (t.event_day - F.make_interval(hours=(F.col("k") % 60).cast("int"))).alias("last_pull_at"))
    return signals.freshness(s, s.select("source_id", F.lit(24).alias("max_hours")), t.event_day)


@query(_ALERT + " select event_id, watchlist_id, 'BACKFILL' as label from al where detected_at >= timestamp '2024-01-31 00:00:00' - interval 90 days ")
def o14_backfill(t):
    past = t.ev.filter(F.col("detected_at") >= t.event_day - F.expr("INTERVAL 90 DAYS"))
    return route.match_watchlists(past, _watch(t), t.company).select("event_id", "watchlist_id", F.lit("BACKFILL").alias("label"))


@query(_SCORE + " select distinct e.subscriber_id, p.peer as cin from peer p join entry_ e on e.cin = p.cin where not exists (select 1 from entry_ x where x.subscriber_id = e.subscriber_id and x.cin = p.peer)")
def o15_suggestions(t):
    reached = score.peers(t.edge).select(F.col("peer").alias("cin"), F.col("cin").alias("origin"))
    return signals.suggestions(reached, t.entry_)


@query("select cin, count(distinct source)::bigint as sources, case when count(distinct source) >= 3 then 'HIGH' when count(distinct source) = 2 then 'MEDIUM' else 'LOW' end as label from ev group by cin")
def o16_confidence_label(t):
    return signals.confidence_label(t.ev)


@query("with m as (select registered_state, industrial_class, date_trunc('month', filing_date)::date as month, count(*)::bigint as n from legal join company using (cin) group by 1, 2, 3), l as (select *, lag(n) over (partition by registered_state, industrial_class order by month) as was from m) select registered_state, industrial_class, month, n, was from l where n / was >= 2")
def o18_strike_off_spikes(t):
    return signals.strike_off_spikes(t.legal.select("cin", F.col("filing_date").alias("detected_at")), t.company)


@query("select cin, 'ADDRESS_CHANGE' as event_type, 'WATCH' as severity from company where k % 6 = 1")
def o18_address_changes(t):
    old = t.company.select("cin", F.when(F.col("k") % 6 == 2, " ").otherwise(F.concat(F.lit(" 1 Road, "), "registered_state")).alias("registered_address"))
    new = t.company.select("cin", F.when(F.col("k") % 6 == 3, F.lit(None)).when(F.col("k") % 6 == 1, "2 Lane").otherwise(F.concat(F.lit("1 Road, "), "registered_state")).alias("registered_address"))
    return detect.address_changes(old, new)


@query(_SCORE + _DIGEST[4:].join([",", ""]) + ", lb as (select cin, count(distinct source) as s, list_sort(list(distinct event_type)) as signals, coalesce(list_sort(list(distinct source) filter (where source in ('s1', 's2'))), []) as late_sources from ev group by cin) select batch_id, watchlist_id, dg.cin, company_name, n_events, max_severity, case when score_after < score_before then 'down' when score_after > score_before then 'up' else 'same' end as direction, coalesce(penalty, 0)::bigint as penalty, case when s >= 3 then 'HIGH' when s = 2 then 'MEDIUM' else 'LOW' end as confidence, (" + _R.format("max_severity") + ")::int as rank, signals, late_sources from dg left join company using (cin) left join pen using (cin) left join lb using (cin)")
def o19_alert_record(t):
    pen = score.contagion_penalty(score.peers(t.edge), score.weigh(_parts(t)).select("cin", "band"))
    return signals.alert_record(_digests(t), pen, signals.confidence_label(t.ev), t.company, t.ev, t.ev.select(F.col("source").alias("source_id"), F.col("source").isin("s1", "s2").alias("late")).distinct()).withColumn("penalty", F.col("penalty").cast("long"))


# ---- streams, replayed from the events table -------------------------------------------------

_CUT = "2024-01-16 00:00:00"


def _stream(t):
    return replay.file_stream(t.spark, t.dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _in_time(df, ts: str, *cuts: str) -> list:
    """Conditions that cut a table by time, the last one for what has none too."""
    at = [F.lit(c).cast("timestamp") for c in cuts]
    out = [F.col(ts) < at[0], *[(F.col(ts) >= a) & (F.col(ts) < b) for a, b in zip(at, at[1:], strict=False)]]
    return [*out, ~F.coalesce(F.col(ts) < at[-1], F.lit(False))]


def _by_parts(t, df, ts: str = "ts"):
    """A table as a stream of three files, in the order of time."""
    return replay.part_stream(t.spark, replay.in_parts(df, _in_time(df, ts, "2024-01-09 00:00:00", "2024-01-20 00:00:00")), df.schema)


@query("select distinct user_id, event_type from events")
def n1_h3_deduplicated_stream(t):
    return replay.drained(streams.deduplicated(_stream(t), ["user_id", "event_type"], delay="400 days").select("user_id", "event_type"))


@query("select user_id, event_type from events group by 1, 2")
def n1_durable_keys(t):
    """The same stream drained twice: what comes again finds its key in the table."""
    path, numbers = replay.shared(t.spark), iter(range(1_000_000))
    append = streams.append_unseen(path, ["user_id", "event_type"])
    for part in ("first", "again"):
        writer = _stream(t).select("user_id", "event_type").writeStream.foreachBatch(lambda batch, _: append(batch, next(numbers)))
        replay.run(writer.option("checkpointLocation", f"{path}/{part}"))
    return t.spark.read.parquet(f"{path}/rows").select("user_id", "event_type")


@query("with l as (select key, pull_ts as ts, id, status, lag(status) over (partition by key order by pull_ts, id) as was from pull) select * from l where status <> was")
def n2_status_changes_stream(t):
    """Changes of status from three micro-batches: those of the window function over all pulls."""
    replay.with_state(t.spark)
    pulls = t.pull.select("key", F.col("pull_ts").alias("ts"), "id", "status")
    return replay.drained(streams.status_changes(_by_parts(t, pulls)))


_HELD = "select watchlist_id, cin, n_events, max_severity, score_before, score_after, batch_id from dg"


@query(_DIGEST + " " + _HELD)
def n3_held_digests_stream(t):
    """Alerts of two micro-batches with a stop of the stream between them, held by timers for their severity's hours (of 10 ms).
    The digests that come out, added up for each watchlist and company, are those of the batch: each alert is in one."""
    replay.with_state(t.spark)
    path, files = replay.shared(t.spark), replay.shared(t.spark)
    a = _alerts(t).withColumn("alert_id", F.col("event_id") * 100 + F.col("watchlist_id")).withColumn("score_before", F.col("event_id") % 100).withColumn("score_after", F.col("event_id") % 90)
    early, late = _in_time(a, "detected_at", _CUT)
    writer = lambda: replay.into(streams.held_digests(replay.part_stream(t.spark, files, a.schema, whole=True), 10), path)
    out = lambda: t.spark.read.schema(streams.DIGEST).parquet(f"{path}/rows")
    come = lambda: out().agg(F.coalesce(F.sum("n_events"), F.lit(0))).first()[0]
    a.filter(early).write.mode("append").parquet(files)
    replay.run_until(writer(), lambda: _folder(t.spark, f"{path}/state/commits/0"))
    a.filter(late).write.mode("append").parquet(files)
    alerts = t.spark.read.schema(a.schema).parquet(files)
    total = alerts.count()
    replay.run_until(writer(), lambda: come() >= total)
    again = out().select("watchlist_id", "cin", F.explode("alert_ids").alias("alert_id"))
    ids = again.join(alerts.select("alert_id", "event_id", "severity", "detected_at", "score_before", "score_after").hint("merge"), "alert_id")
    return route.build_digests(ids).drop("alert_ids")


def _folder(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_FIRED = """o as (select *, epoch_us(detected_at) as tm, row_number() over (partition by {keys} order by detected_at, id) as r from src),
f as (select {keys}, id, detected_at, r, tm as last, true as fires from o where r = 1 union all select {o_keys}, o.id, o.detected_at, o.r, case when tm - last >= {span} then tm else last end, tm - last >= {span} from f join o on {same} and o.r = f.r + 1)"""


def _fired(keys: list[str], hours: int) -> str:
    listed = ", ".join(keys)
    return _FIRED.format(keys=listed, o_keys=", ".join(f"o.{k}" for k in keys), same=" and ".join(f"o.{k} = f.{k}" for k in keys), span=hours * 3_600_000_000)


@query("with recursive src as (select id, cin, event_type, detected_at from ev), " + _fired(["cin", "event_type"], 48) + " select cin, event_type, detected_at as ts, id from f where fires")
def n4_cool_down_stream(t):
    """Cool-down over three micro-batches, by the times of the events."""
    replay.with_state(t.spark)
    e = t.ev.select("cin", "event_type", F.col("detected_at").alias("ts"), "id")
    return replay.drained(streams.cooled(_by_parts(t, e), hours=48))


@query("with recursive src as (select id, cin, event_type, detected_at from ev), " + _fired(["cin", "event_type"], 24 * 30) + " select cin, event_type, detected_at as ts, id from f where fires")
def n4_c8_silent_for_30_days_stream(t):
    replay.with_state(t.spark)
    e = t.ev.select("cin", "event_type", F.col("detected_at").alias("ts"), "id")
    return replay.drained(streams.cooled(_by_parts(t, e)))


@query(f"with recursive src as (select ev.id, e.subscriber_id, ev.cin, ev.event_type, detected_at from ev join entry_ e using (cin) join subscriber s using (subscriber_id) where {_S.format('ev.severity')} >= {_S.format('severity_threshold')}), " + _fired(["subscriber_id", "cin", "event_type"], 24) + " select subscriber_id, cin, event_type, detected_at as ts, id from f where fires")
def n4_l5_subscriber_stream(t):
    """Each subscriber's alerts of a company and type, at most one in 24 hours, from three micro-batches."""
    replay.with_state(t.spark)
    none = t.ev.limit(0).select(F.lit(0).alias("subscriber_id"), "cin", "event_type", F.col("detected_at").alias("delivered_at"))
    hits = route.subscriber_targets(t.ev, t.subscriber, t.entry_, none).join(t.ev.select("id", F.col("detected_at").alias("ts")), "id")
    rows = hits.select("subscriber_id", "cin", "event_type", "ts", "id")
    return replay.drained(streams.cooled(_by_parts(t, rows), ("subscriber_id", "cin", "event_type"), 24))


@query("select w as window_start, event_type, count(*)::bigint as n from (select time_bucket(interval 6 hours, ts) - k * interval 6 hours as w, event_type from events, range(0, 4) r(k)) group by 1, 2")
def n6_rolling_counts_stream(t):
    return replay.drained(streams.rolling_counts(_stream(t), ["event_type"], length="24 hours", step="6 hours"), "complete")


@query(_SCORE + " select ev.id, ev.cin, cast(floor(score) as int) as health_score_after from ev join bd using (cin)")
def n5_scored_batches(t):
    """Each micro-batch scores the companies that it touches."""
    spark, path = t.spark, replay.shared(t.spark)

    def score_batch(batch: DataFrame, _: int) -> None:
        touched = batch.select(F.col("user_id").alias("k")).distinct()
        master = t.company.join(touched, "k", "left_semi")
        scored = score.weigh(score.components(master, t.edge, t.legal, t.finance, _capital_events(t), t.order_day))
        ids = batch.select(F.col("event_id").alias("id"), F.col("user_id").alias("k")).join(t.company.select("k", "cin"), "k")
        ids.join(scored.select("cin", F.col("score_stored").alias("health_score_after")), "cin").select("id", "cin", "health_score_after").write.mode("append").parquet(f"{path}/rows")

    replay.run(monitor.scored_batches(_stream(t), f"{path}/state", score_batch))
    return spark.read.parquet(f"{path}/rows")


def _chain_sql() -> str:
    """K6, K8, K10 and L1 by two micro-batches: scores by the events so far, contagion from the bands that each batch changes."""
    kind = f"case when id % 7 = 0 then 'CAPITAL_CHANGE' else {_KIND_SQL}[id % {len(_KINDS_OF_RULES)} + 1] end"
    common, rest = _SCORE.split("cw as (", 1)
    scores, graph = rest.split("act as (", 1)
    people, penalty = graph.split("pen as (", 1)
    reach = _REACH[len(_SCORE) :].lstrip(", ")
    out = [common.rstrip() + " act as (" + people.rstrip().rstrip(",")]
    own = r"\b(cw|ct|parts|sc|bd|pen2|pen|ch|l1|l2|r1|r2|s1|s2|b2|done|re)\b"
    for step, when in enumerate(("false", f"detected_at < timestamp '{_CUT}'", "true")):
        text = "cw as (" + scores.rstrip().rstrip(",").replace("from ev where event_type = 'CAPITAL_CHANGE'", f"from ev where id % 7 = 0 and {when}")
        if step:
            text += ", pen as (" + penalty + ", " + reach.replace("select cin from bd where band = 'RED'", f"select bd.cin from bd join bd__{step - 1} o using (cin) where bd.band <> o.band")
        out.append(re.sub(own + r"(?!\s*')(?!__)", rf"\1__{step}", text))
    combined = re.sub(r"\b(e|n|s)\b(?= as \(|\.|(?: where| group| having|\)|$))", r"x_\1", _combo_sql(source=f"select id, cin, {kind} as raw, detected_at from ev"))
    combo, last = combined.removeprefix("with ").rsplit(" select cin, rule", 1)
    out.append(combo)
    alerts = re.sub(r"\bal\b", "x_al", _ALERT.removeprefix("with ").replace("one_type = event_type", f"one_type = {kind.replace('id %', 'ev.id %')}"))
    out.append(alerts)
    rows = ["select 'score' as part, cin, band as item, score::double as value from bd__2 where cin in (select cin from ev)"]
    rows += [f"select 'contagion', cin, concat('{i - 1}:', depth::varchar, ':', array_to_string(chain, '>'), ':', band_before, ':', band_after), score_after::double from re__{i}" for i in (1, 2)]
    rows += ["select 'composite', cin, concat(rule, ':', severity), 0::double from x_s", "select 'alert', cin, concat(watchlist_id::varchar, ':', event_id::varchar, ':', severity), 0::double from x_al"]
    return ", ".join(out) + " " + " union all ".join(rows)


def _chain_events(t):
    kind = F.when(F.col("id") % 7 == 0, "CAPITAL_CHANGE").otherwise(F.element_at(F.array(*map(F.lit, _KINDS_OF_RULES)), (F.col("id") % len(_KINDS_OF_RULES) + 1).cast("int")))
    e = t.ev.withColumn("event_type", kind)
    before = F.concat(F.lit('{"previous_capital":'), (F.floor("value") * 40_000).cast("string"), F.lit("}"))
    return e.select("id", "cin", "event_type", "severity", "detected_at", F.when(F.col("event_type") == "CAPITAL_CHANGE", before).otherwise(F.col("data_json")).alias("data_json"))


@query(_chain_sql())
def n5_k6_k8_k10_l1_chain(t):
    """The whole chain over two micro-batches: newest scores of the touched companies, contagion of each batch, composite
    signals, alerts."""
    e = _chain_events(t)
    m = monitor.Monitor(replay.shared(t.spark), kept(t.company), kept(t.edge), kept(t.legal), kept(t.finance), kept(_watch(t)), t.order_day)
    m.start(e.limit(0))
    files = replay.in_parts(e, _in_time(e, "detected_at", _CUT))
    replay.run(monitor.scored_batches(replay.part_stream(t.spark, files, e.schema), f"{m.path}/state", m.run))
    row = lambda df, part, item, value: df.select(F.lit(part).alias("part"), "cin", item.alias("item"), value.cast("double").alias("value"))
    zero = F.lit(0.0)
    out = row(m.scores().join(t.ev.select("cin").distinct(), "cin", "left_semi"), "score", F.col("band"), F.col("score"))
    out = out.unionByName(row(m.table("contagion"), "contagion", F.concat_ws(":", F.col("batch").cast("string"), F.col("depth").cast("string"), F.array_join("chain", ">"), "band_before", "band_after"), F.col("score_after")))
    out = out.unionByName(row(m.table("composites").filter("batch >= 0"), "composite", F.concat_ws(":", "rule", "severity"), zero))
    return out.unionByName(row(m.table("alerts"), "alert", F.concat_ws(":", F.col("watchlist_id").cast("string"), F.col("event_id").cast("string"), "severity"), zero))
