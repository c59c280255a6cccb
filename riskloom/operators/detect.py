"""Change detectors (survey 2.I) and transition classifiers (2.J): records in, events out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.functions.clean import as_json, col, mentions, parties, present, whole
from riskloom.operators.resolve import resolve_light

EVENT = ["cin", "source", "event_type", "severity", "record_id"]


def first_match(text, rules: list[tuple[str, str, str]], default: tuple[str, str]) -> Column:
    """struct(event_type, severity) of the first rule whose substring is in the lower-cased text."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    pair = lambda kind, severity: F.struct(F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"))
    out = None
    for token, kind, severity in rules:
        test = F.contains(lowered, F.lit(token))
        out = F.when(test, pair(kind, severity)) if out is None else out.when(test, pair(kind, severity))
    return pair(*default) if out is None else out.otherwise(pair(*default))


def record_id(*names: str) -> Column:
    return F.coalesce(*[present(n) for n in names])


def fresh(records: DataFrame, seen: DataFrame, key: list[str], order: list) -> DataFrame:
    """Records whose key is not stored yet; of records that share a key, the first. The window holds one key's records of
    one batch; keys with a null are dropped, as they cannot be stored."""
    ready = records.dropna(subset=key).join(seen.select(*key).distinct(), key, "left_anti")
    return ready.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def detect_source(records: DataFrame, seen: DataFrame, source: str, order: str = "record_id") -> DataFrame:
    """Events of an append-only source by its rules: cin, source, event_type, severity, record_id."""
    column, rules, default = fixed.SOURCE_RULES[source]
    hit = first_match(column if column in records.columns else F.lit(None).cast("string"), rules, default)
    new = fresh(records, seen, ["cin", "record_id"], [F.col(order)])
    return new.select("cin", F.lit(source).alias("source"), hit.alias("hit"), "record_id").select("cin", "source", "hit.event_type", "hit.severity", "record_id")


def detect_sources(records: DataFrame, seen: DataFrame, sources: list[str], order: str = "record_id") -> DataFrame:
    """detect_source for several sources at once: records have text and source, or sources (an array) where a record comes from
    several; so has seen. One scan, one join and one window, whatever the number of sources: those of a record are bits of a
    number, and a record is repeated for its sources only when the new ones are known."""
    hit = None
    for source in sources:
        one = first_match("text", *fixed.SOURCE_RULES[source][1:])
        hit = F.when(F.col("source") == source, one) if hit is None else hit.when(F.col("source") == source, one)
    key = ["cin", "record_id"]

    def bits(df: DataFrame) -> DataFrame:
        has = (lambda s: F.array_contains("sources", s)) if "sources" in df.columns else (lambda s: F.col("source") == s)
        each = [F.when(has(F.lit(s)), F.lit(1 << i)).otherwise(0) for i, s in enumerate(sources)]
        return df.dropna(subset=key).withColumn("__bits", sum(each[1:], each[0]).cast("long")).filter("__bits > 0")

    old = bits(seen).groupBy(*key).agg(F.bit_or("__bits").alias("__old"))
    before = Window.partitionBy(*key).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = bits(records).select(*dict.fromkeys([*key, order, "text", "__bits"])).join(old.hint("merge"), key, "left")
    taken = F.coalesce(F.bit_or("__bits").over(before), F.lit(0)).bitwiseOR(F.coalesce("__old", F.lit(0)))
    new = rows.withColumn("__new", F.col("__bits").bitwiseAND(F.bitwise_not(taken))).filter("__new <> 0")
    named = F.filter(F.array(*[F.when(F.col("__new").bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)) for i, s in enumerate(sources)]), lambda s: s.isNotNull())
    each = new.select("cin", F.explode(named).alias("source"), "text", "record_id")
    return each.select("cin", "source", hit.alias("hit"), "record_id").select("cin", "source", "hit.event_type", "hit.severity", "record_id")


def detect_notices(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Secured-creditor notices: the stage is part of the key."""
    staged = records.withColumn("stage", F.lower(F.coalesce(present("notice_stage"), F.lit(""))))
    new = fresh(staged, seen, ["cin", "record_id", "stage"], [F.col("notice_stage")])
    return new.withColumn("hit", first_match("notice_stage", *fixed.SOURCE_RULES["sarfaesi"][1:])).select("cin", F.lit("sarfaesi").alias("source"), "hit.event_type", "hit.severity", "record_id")


def detect_district_cases(records: DataFrame, seen: DataFrame, stored_cheque: DataFrame, threshold: int = 3, claim_above: int = 10_000_000, cumulative: bool = False) -> DataFrame:
    """District courts: disposals, cheque cases (multiple from `threshold` on: stored count + 1, or with the place in the
    batch if cumulative), large civil claims. stored_cheque: cin, cheque_count."""
    new = fresh(records, seen, ["cin", "record_id"], [F.col("record_id")]).join(stored_cheque, "cin", "left")
    status, kind = F.lower(F.coalesce("disposal_status", F.lit(""))), F.lower(F.coalesce("case_type", F.lit("")))
    closed = F.contains(status, F.lit("disposed")) | F.contains(status, F.lit("decided")) | F.contains(status, F.lit("closed"))
    cheque = F.contains(kind, F.lit("138")) | F.contains(kind, F.lit("cheque"))
    place = F.row_number().over(Window.partitionBy("cin", closed, cheque).orderBy("record_id")) if cumulative else F.lit(1)
    new = new.withColumn("count", F.coalesce("cheque_count", F.lit(0)) + place)
    e = lambda k, s: F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity"))
    hit = F.when(closed, e("CASE_DISPOSED", "INFO")).when(cheque & (F.col("count") >= threshold), e("SEC138_MULTIPLE", "CRITICAL")).when(cheque, e("SEC138_FILED", "ALERT")).when(whole("claim_amount") > claim_above, e("CIVIL_SUIT_FILED", "WATCH"))
    return new.withColumn("hit", hit).filter("hit is not null").select("cin", F.lit("ecourts").alias("source"), "hit.event_type", "hit.severity", "record_id", F.when(F.startswith("hit.event_type", F.lit("SEC138")), F.col("count")).cast("long").alias("cheque_count"))


def detect_by_type(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Insolvency board: exact types, a missing one is cirp, unknown ones are alerts."""
    kind = F.lower(F.coalesce(present("case_type"), F.lit("cirp")))
    table = F.create_map(*[x for t, k, s in fixed.IBBI_TYPES for x in (F.lit(t), F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity")))])
    hit = F.coalesce(F.element_at(table, kind), F.struct(F.lit("IBBI_CASE_FILED").alias("event_type"), F.lit("ALERT").alias("severity")))
    return fresh(records, seen, ["cin", "record_id"], [F.col("record_id")]).withColumn("hit", hit).select("cin", F.lit("ibbi").alias("source"), "hit.event_type", "hit.severity", "record_id")


def detect_filings(records: DataFrame, seen: DataFrame) -> DataFrame:
    form = F.upper(F.coalesce(present("form_type"), F.lit("OTHER")))
    severity = F.when(form.isin("MGT-7", "AOC-4"), "INFO").when(form.isin("STK-2", "STK-7"), "ALERT").otherwise("WATCH")
    return fresh(records, seen, ["cin", "record_id"], [F.col("record_id")]).select("cin", F.lit("roc_filings").alias("source"), F.concat(F.lit("ROC_FILING_"), form).alias("event_type"), severity.alias("severity"), "record_id")


def detect_quantities(records: DataFrame, seen: DataFrame, source: str, column: str) -> DataFrame:
    """Bulk deals (quantity over 500,000 is an alert) and hiring (50 postings or more, none, or some)."""
    n = F.coalesce(whole(column), F.lit(0))
    e = lambda k, s: F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity"))
    if source == "sebi_bulk_block_deals":
        hit = F.when(n > 500_000, e("SEBI_BULK_BLOCK_DEAL", "ALERT")).otherwise(e("SEBI_BULK_BLOCK_DEAL", "WATCH"))
    else:
        hit = F.when(n >= 50, e("MASS_HIRING_SIGNAL", "WATCH")).when(n == 0, e("HIRING_FREEZE_SIGNAL", "WATCH")).otherwise(e("HIRING_ACTIVITY", "INFO"))
    return fresh(records, seen, ["cin", "record_id"], [F.col("record_id")]).withColumn("hit", hit).select("cin", F.lit(source).alias("source"), "hit.event_type", "hit.severity", "record_id")


def fingerprint(records: DataFrame, group: list[str]) -> DataFrame:
    """Order-insensitive fingerprint per group: number of rows and exact sum of row hashes. No group is gathered."""
    cols = sorted(c for c in records.columns if c not in group)
    row = F.xxhash64(as_json(*cols)).cast("decimal(38,0)")
    return records.groupBy(*group).agg(F.count("*").alias("n"), F.sum(row).alias("digest"))


def changed_sources(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Gate: the groups whose fingerprint differs from the stored one, or is new."""
    old = before.select(*key, F.col("n").alias("old_n"), F.col("digest").alias("old_digest"))
    return now.join(old, key, "left").filter(~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("digest").eqNullSafe(F.col("old_digest")))).select(*key, "n")


def _fired(df: DataFrame, tests: list[tuple[Column, str, str]], keep: list[str]) -> DataFrame:
    """A row for each test that holds."""
    events = F.array(*[F.when(test, F.struct(F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"))) for test, kind, severity in tests])
    return df.select(*keep, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(*keep, "e.event_type", "e.severity")


def diff_companies(old: DataFrame, new: DataFrame, as_of: Column, overdue_days: int = 548, capital_share: float = 0.5) -> DataFrame:
    """Company master: new, removed while active, status change, capital change, overdue meeting (once)."""
    o, n = (df.select("cin", *[F.col(c).alias(f"{p}_{c}") for c in ("status", "paid_up_capital", "date_of_last_agm")], F.lit(True).alias(f"in_{p}")) for df, p in ((old, "o"), (new, "n")))
    both = o.join(n, "cin", "full_outer")
    there, gone, fresh_ = F.col("in_o") & F.col("in_n"), F.col("in_n").isNull(), F.col("in_o").isNull()
    a, b = whole("o_paid_up_capital"), whole("n_paid_up_capital")
    late = lambda p: F.coalesce(F.datediff(as_of, F.col(f"{p}_date_of_last_agm").cast("date")) > overdue_days, F.lit(False))
    active = F.lower("n_status") == "active"
    tests = [
        (fresh_, "NEW_COMPANY", "INFO"),
        (gone & (F.lower("o_status") == "active"), "COMPANY_REMOVED", "ALERT"),
        (there & (present("o_status") != present("n_status")), "STATUS_CHANGE", "ALERT"),
        (there & (a > 0) & (F.abs(b - a).cast("double") / a > capital_share), "CAPITAL_CHANGE", "WATCH"),
        (there & active & late("n") & ~late("o"), "AGM_OVERDUE", "WATCH"),
    ]
    return _fired(both, tests, ["cin"])


def diff_directors(old: DataFrame, new: DataFrame, boards_from: int = 10) -> DataFrame:
    """Director edges (din, cin, designation, date_of_appointment, cessation_date): appointed, resigned (an alert for a
    finance chief or auditor), overloaded once per director. A later row of a pair replaces an earlier one."""
    last = Window.partitionBy("din", "cin").orderBy(F.col("date_of_appointment").desc_nulls_last(), F.col("cessation_date").desc_nulls_last())
    one = lambda df: df.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    o, n = one(old).select("din", "cin", F.col("cessation_date").alias("o_end"), F.lit(True).alias("in_o")), one(new).select("din", "cin", "designation", F.col("cessation_date").alias("n_end"))
    both = n.join(o, ["din", "cin"], "left")
    ends = F.col("n_end").isNotNull() & F.col("in_o").isNotNull() & F.col("o_end").isNull()
    role = F.lower(F.coalesce("designation", F.lit("")))
    high = F.contains(role, F.lit("cfo")) | F.contains(role, F.lit("chief financial")) | F.contains(role, F.lit("auditor"))
    events = _fired(both, [(F.col("in_o").isNull() & F.col("n_end").isNull(), "DIRECTOR_APPOINTED", "INFO"), (ends & high, "DIRECTOR_RESIGNED", "ALERT"), (ends & ~high, "DIRECTOR_RESIGNED", "WATCH")], ["cin", "din"])
    boards = one(new).filter("cessation_date is null").groupBy("din").agg(F.countDistinct("cin").alias("boards"), F.min("cin").alias("cin")).filter(F.col("boards") >= boards_from)
    return events.unionByName(boards.select("cin", "din", F.lit("DIRECTOR_OVERLOADED").alias("event_type"), F.lit("WATCH").alias("severity")))


def transitions(pulls: DataFrame, source: str, key: list[str], status: str = "status", ts: str = "pull_ts", order: tuple = ()) -> DataFrame:
    """Status pulls to events: each pull against the one before it of the same key. First sights are silent but for
    sources that report them."""
    return all_transitions(pulls, [source], key, status, ts, order).drop("source")


def all_transitions(pulls: DataFrame, sources: list[str], key: list[str], status: str = "status", ts: str = "pull_ts", order: tuple = ()) -> DataFrame:
    """transitions by the rules of several sources (source, key, ts, event_type, severity): one window, whatever their number."""
    w = Window.partitionBy(*key).orderBy(ts, *order)
    now, before = F.lower(F.coalesce(F.trim(status), F.lit(""))), F.lower(F.coalesce(F.trim(F.lag(status).over(w)), F.lit("")))
    df = pulls.withColumn("__now", now).withColumn("__was", before).withColumn("__first", F.row_number().over(w) == 1)
    tests = []
    for source in sources:
        for previous, new, kind, severity in fixed.TRANSITIONS[source]:
            test = (F.col("__now") == new) & (F.col("__now") != F.col("__was")) & (F.col("__was") != "")
            if previous:
                test = test & F.col("__was").isin(previous)
            tests.append((test, source, kind, severity))
        if source in fixed.FIRST_SIGHT:
            tests.append((F.col("__first") & (F.col("__now") != ""), source, *fixed.FIRST_SIGHT[source]))
    events = F.array(*[F.when(test, F.struct(F.lit(source).alias("source"), F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"))) for test, source, kind, severity in tests])
    return df.select(*key, ts, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.source", *key, ts, "e.event_type", "e.severity")


def classify_text(records: DataFrame, kind: str, text: str, keep: list[str]) -> DataFrame:
    """Orders and notices classified by their text."""
    return records.select(*keep, first_match(text, *fixed.TEXT_RULES[kind]).alias("hit")).select(*keep, "hit.event_type", "hit.severity")


def classify_batch(records: DataFrame, kind: str, text: str, keep: list[str]) -> DataFrame:
    """Order types, disclosures and backfilled lists by the rules of the batch specs; rows that no rule names are dropped."""
    return records.select(*keep, first_match(text, *fixed.BATCH_RULES[kind]).alias("hit")).select(*keep, "hit.event_type", "hit.severity").filter("event_type is not null")


def classify_suits(records: DataFrame, text: str, claim: str, keep: list[str]) -> DataFrame:
    """High-court texts; a commercial suit counts only above the least claim, a null claim does not reach it."""
    hit = classify_text(records, "high_court", text, [*dict.fromkeys([*keep, claim])])
    return hit.filter((F.col("event_type") != "HIGH_COURT_COMMERCIAL_SUIT") | (F.coalesce(F.col(claim), F.lit(0)) > fixed.SUIT_CLAIM)).select(*keep, "event_type", "severity")


def classify_charges(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Charges by (cin, charge_id), one event each: a known one that is raised, then satisfied, then above the company's capital;
    a new one above ten crore or from one crore. Amounts are whole rupees."""
    p = previous.select("cin", "charge_id", F.col("amount").alias("was"), F.col("status").alias("was_status"), F.lit(True).alias("known"))
    both = current.join(p, ["cin", "charge_id"], "left")
    new = F.col("known").isNull()
    amount = F.coalesce("amount", F.lit(0))
    e = lambda k, s: F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity"))
    of_new = F.when(amount > 100_000_000, e("CHARGE_EXCEEDS_CAPITAL", "CRITICAL")).when(amount >= 10_000_000, e("CHARGE_CREATED", "ALERT"))
    ended = (F.coalesce("was_status", F.lit("")) != "Satisfied") & (F.col("status") == "Satisfied")
    of_known = F.when(amount > F.coalesce("was", F.lit(0)), e("CHARGE_MODIFIED", "WATCH")).when(ended, e("CHARGE_SATISFIED", "WATCH")).when((F.col("authorized_capital") > 0) & (amount > F.col("authorized_capital")), e("CHARGE_EXCEEDS_CAPITAL", "CRITICAL"))
    return both.withColumn("hit", F.when(new, of_new).otherwise(of_known)).filter("hit is not null").select("cin", "charge_id", "hit.event_type", "hit.severity")


def multiple_lenders(previous: DataFrame, current: DataFrame, lenders: int = 3) -> DataFrame:
    """Companies whose distinct open lenders reach the number now and did not before."""
    count = lambda df, name: df.filter("status = 'Open'").groupBy("cin").agg(F.countDistinct("lender").alias(name))
    both = count(current, "now").join(count(previous, "before"), "cin", "left")
    return both.filter((F.col("now") >= lenders) & (F.coalesce("before", F.lit(0)) < lenders)).select("cin", F.lit("MULTIPLE_LENDERS").alias("event_type"), F.lit("ALERT").alias("severity"), F.col("now").alias("lenders"))


def classify_deals(deals: DataFrame, seen: DataFrame) -> DataFrame:
    """Bulk deals keyed by date, scrip and client: promoter sells, institutional exits, promoter buys."""
    new = fresh(deals, seen, ["deal_date", "scrip", "client_name"], [F.col("quantity")])
    kind, client = F.lower("deal_type"), F.lower("client_name")
    e = lambda k, s: F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity"))
    hit = F.when(F.col("promoter") & (kind == "sell"), e("SEBI_BULK_DEAL_PROMOTER_SELL", "ALERT")).when(F.contains(client, F.lit("mutual fund")) | F.contains(client, F.lit("capital")), e("SEBI_BULK_DEAL_INSTITUTIONAL_EXIT", "WATCH")).when(F.col("promoter") & (kind == "buy"), e("SEBI_INSIDER_BUY", "INFO"))
    return new.withColumn("hit", hit).filter("hit is not null").select("cin", "deal_date", "scrip", "client_name", "hit.event_type", "hit.severity")


def classify_awards(awards: DataFrame) -> DataFrame:
    """Marketplace awards: large from a crore, won from half of that, else a new seller."""
    v = F.coalesce("order_value", F.lit(0))
    kind = F.when(v >= 10_000_000, "GEM_LARGE_CONTRACT").when(v >= 5_000_000, "GEM_ORDER_WON").otherwise("GEM_NEW_SELLER")
    return awards.select("cin", "award_id", kind.alias("event_type"), F.lit("INFO").alias("severity"))


def classify_labour(orders: DataFrame) -> DataFrame:
    t = F.lower(F.coalesce("order_type", F.lit("")))
    kind = F.when(F.contains(t, F.lit("retrench")) & (F.coalesce("affected", F.lit(0)) > 50), "LABOUR_MASS_RETRENCHMENT").when(F.contains(t, F.lit("back")) & F.contains(t, F.lit("wage")), "LABOUR_BACK_WAGES").otherwise("LABOUR_INDUSTRIAL_DISPUTE")
    return orders.select("cin", "record_id", kind.alias("event_type"), F.when(kind == "LABOUR_MASS_RETRENCHMENT", "ALERT").otherwise("WATCH").alias("severity"))


def project_changes(pulls: DataFrame, key: str = "key", ts: str = "pull_ts") -> DataFrame:
    """Real-estate projects: complaints that grow threefold (from at least 1)."""
    w = Window.partitionBy(key).orderBy(ts)
    was = F.lag("complaints").over(w)
    spike = (was > 0) & (F.coalesce("complaints", F.lit(0)) >= F.greatest(was, F.lit(1)) * 3)
    return _fired(pulls.withColumn("spike", F.coalesce(spike, F.lit(False))), [(F.col("spike"), "RERA_COMPLAINT_SPIKE", "ALERT")], [key, ts])


def clearances(pulls: DataFrame, key: str = "key", ts: str = "pull_ts", cost_above: int = 1_000_000_000, order: tuple = ()) -> DataFrame:
    """Environmental clearances: a new project above the cost; else a status other than the one before, the first one too."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    df = pulls.withColumn("__first", F.row_number().over(w) == 1).withColumn("__was", F.lag("status").over(w))
    now = F.lower(F.coalesce("status", F.lit("")))
    e = lambda k, s: F.struct(F.lit(k).alias("event_type"), F.lit(s).alias("severity"))
    same = ~F.col("__first") & F.col("status").eqNullSafe(F.col("__was"))
    hit = F.when(F.col("__first") & (F.coalesce("project_cost", F.lit(0)) > cost_above), e("EC_NEW_APPLICATION", "INFO")).when(same, F.lit(None)).when(now == "revoked", e("EC_REVOKED", "CRITICAL")).when(now == "refused", e("EC_REFUSED", "ALERT")).when(now == "granted", e("EC_GRANTED", "INFO"))
    return df.withColumn("hit", hit).filter("hit is not null").select(key, ts, "hit.event_type", "hit.severity")


def refresh_directors(previous: DataFrame, current: DataFrame, boards_above: int = 10) -> DataFrame:
    """A company's directors against the stored ones (cin, din, director_name, designation, date_of_appointment,
    cessation_date), by director number, or by name and role where it is missing: resignations (a finance chief's is an
    alert), another auditor than the latest stored one, directors on more than boards_above boards. Equal events once."""
    role = lambda c: F.lower(F.coalesce(c, F.lit("")))
    key = F.coalesce(present("din"), F.md5(F.concat_ws("|", F.lower(F.trim("director_name")), F.lower(F.trim("designation")))))
    since = F.coalesce(F.col("date_of_appointment").cast("date"), F.lit("1900-01-01").cast("date"))
    p = previous.withColumn("key", key)
    old = p.groupBy("cin", "key").agg(F.max_by(F.struct(F.col("director_name").alias("old_name"), F.col("cessation_date").alias("old_end")), F.struct(since, F.col("cessation_date"))).alias("o")).select("cin", "key", "o.old_name", "o.old_end", F.lit(True).alias("known"))
    auditor = p.filter(F.contains(role(F.col("designation")), F.lit("auditor"))).groupBy("cin").agg(F.max_by("director_name", F.struct(since, "director_name")).alias("old_auditor"), F.lit(True).alias("audited"))
    boards = current.filter("cessation_date is null and din is not null").groupBy("din").agg(F.countDistinct("cin").alias("boards"))
    both = current.withColumn("key", key).join(old, ["cin", "key"], "left").join(auditor, "cin", "left").join(boards, "din", "left")
    kind, known = role(F.col("designation")), F.coalesce("known", F.lit(False))
    chief, audits = (kind == "cfo") | F.contains(kind, F.lit("chief financial officer")), F.contains(kind, F.lit("auditor"))
    ends = known & F.col("old_end").isNull() & F.col("cessation_date").isNotNull()
    other = lambda c: ~F.col(c).eqNullSafe(F.col("director_name"))
    tests = [
        (ends & chief, "CFO_RESIGNED", "ALERT"),
        (ends & ~chief, "DIRECTOR_RESIGNED", "WATCH"),
        (audits & ((known & other("old_name")) | (F.coalesce("audited", F.lit(False)) & other("old_auditor"))), "AUDITOR_CHANGED", "ALERT"),
        (F.coalesce("boards", F.lit(0)) > boards_above, "DIRECTOR_OVERLOADED", "WATCH"),
    ]
    return _fired(both, tests, ["cin", "key", "director_name"]).distinct()


def address_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies whose registered address differs from the stored one; blank and missing addresses are no change."""
    both = new.select("cin", present("registered_address").alias("a")).join(old.select("cin", present("registered_address").alias("b")), "cin")
    return both.filter("a <> b").select("cin", F.lit("ADDRESS_CHANGE").alias("event_type"), F.lit("WATCH").alias("severity"))


def press_releases(releases: DataFrame, seen: DataFrame, order: str = "title") -> DataFrame:
    """Regulator press releases: relevant ones only, each (date, entity, action) once, classified by their text; those whose
    entity no company has go without a cin. releases: release_date, entity_name, title; seen: release_date, entity_name, action."""
    text = F.lower(F.coalesce("title", F.lit("")))
    action = F.when(F.contains(text, F.lit("cancellation")) | F.contains(text, F.lit("certificate of registration")), "cancellation").when(F.contains(text, F.lit("restriction")), "restriction").when(F.contains(text, F.lit("warning")), "warning").otherwise("penalty")
    new = fresh(releases.filter(mentions("title", fixed.PRESS_RELEVANT)).withColumn("action", action), seen, ["release_date", "entity_name", "action"], [F.col(order)])
    return new.withColumn("hit", first_match("action", *fixed.TEXT_RULES["press_release"])).select("release_date", "entity_name", "action", "hit.event_type", "hit.severity")


def process_source(records: DataFrame, seen: DataFrame, before: DataFrame, source: str, order: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """One pull of a source, by entity: where the fingerprint of an entity's records is the stored one nothing happens; else
    its records are detected. Returns the events to append and the fingerprints to store (cin, n, digest)."""
    now = fingerprint(records, ["cin"])
    moved = changed_sources(now, before, ["cin"]).select("cin")
    return detect_source(records.join(moved, "cin", "left_semi"), seen, source, order), now


def security_interests(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Security interests: satisfied; a company with three open ones or more; a new one from a crore."""
    p = previous.select("cin", "interest_id", F.col("satisfied_on").alias("was_satisfied"), F.lit(True).alias("known"))
    open_ = current.filter("satisfied_on is null").groupBy("cin").agg(F.count("*").alias("open"))
    both = current.join(p, ["cin", "interest_id"], "left").join(open_, "cin", "left")
    kind = F.when(F.col("known") & F.col("was_satisfied").isNull() & F.col("satisfied_on").isNotNull(), "CERSAI_SI_SATISFIED").when(F.coalesce("open", F.lit(0)) >= 3, "CERSAI_MULTIPLE_LENDERS").when(F.col("known").isNull() & (F.coalesce("amount", F.lit(0)) >= 10_000_000), "CERSAI_NEW_SI")
    return both.withColumn("event_type", kind).filter("event_type is not null").select("cin", "interest_id", "event_type", F.when(F.col("event_type") == "CERSAI_SI_SATISFIED", "INFO").otherwise("ALERT").alias("severity"))


def upgrades(pulls: DataFrame, key: str = "key", ts: str = "pull_ts") -> DataFrame:
    """MSME class that rises from one pull to the next."""
    rank = F.create_map(*[F.lit(x) for kv in {"micro": 1, "small": 2, "medium": 3}.items() for x in kv])
    w = Window.partitionBy(key).orderBy(ts)
    df = pulls.withColumn("r", F.coalesce(F.element_at(rank, F.lower("classification")), F.lit(0))).withColumn("was", F.lag("r").over(w))
    return df.filter((F.col("was") > 0) & (F.col("r") > F.col("was"))).select(key, ts, F.lit("UDYAM_CLASSIFICATION_UPGRADE").alias("event_type"), F.lit("INFO").alias("severity"))


def section_hits(rows: DataFrame, text: str, sections: tuple = (7, 9, 10)) -> DataFrame:
    """Insolvency sections that a row's text names."""
    test = lambda n: F.upper(col(text)).rlike(rf"\bIBC\s*{n}\b|\bSECTION\s*{n}\b|\bSEC(?:TION)?\.?\s*{n}\b|\bU/S\s*{n}\b")
    return rows.withColumn("sections", F.filter(F.array(*[F.when(test(n), F.lit(n)) for n in sections]), lambda x: x.isNotNull()))


def defaulter_rows(rows: DataFrame, seen: DataFrame, master: DataFrame, directors: DataFrame, slots: int = 4) -> DataFrame:
    """New wilful-defaulter rows: an event for the company and one for each of the director's companies; others unmapped.

    The result grows with the product of a name's borrowers and companies. Names are dealt to all tasks by number, as a task's
    share would else follow the size of its input, and the borrowers of a name to `slots`, each with the name's companies, so that
    tasks are many and alike and no name is one task's alone.
    """
    new = fresh(rows, seen, ["borrower", "director_name"], [F.col("borrower")])
    company = new.join(master.select(F.col("company_name").alias("borrower"), "cin"), "borrower", "left")
    a = company.select("borrower", F.col("cin"), F.when(F.col("cin").isNull(), "UNMAPPED").otherwise("WILFUL_DEFAULT_COMPANY").alias("event_type"), F.when(F.col("cin").isNull(), "INFO").otherwise("CRITICAL").alias("severity"))
    parts = slots * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot, every = F.pmod(F.xxhash64("borrower"), F.lit(slots)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    named = new.filter(present("director_name").isNotNull()).select("borrower", F.lower("director_name").alias("__d"), slot.alias("__slot")).repartition(parts, "__d", "__slot")
    boards = directors.select(F.lower("director_name").alias("__d"), "cin", every.alias("__slot")).repartition(parts, "__d", "__slot")
    b = named.join(boards.hint("merge"), ["__d", "__slot"]).select("borrower", "cin", F.lit("WILFUL_DEFAULT_DIRECTOR").alias("event_type"), F.lit("ALERT").alias("severity"))
    return a.unionByName(b)


def party_events(orders: DataFrame, kind: str, text: str, key: str) -> DataFrame:
    """One event for each company-like party of an order."""
    return orders.select(key, F.explode(parties(text)).alias("party"), first_match(text, *fixed.TEXT_RULES[kind]).alias("hit")).select(key, "party", "hit.event_type", "hit.severity")


def resolved_party_events(orders: DataFrame, kind: str, text: str, key: str, master: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """party_events with the company of each party and how sure that is, by the cascade for scraped names (resolve_light);
    parties of no company stay, without one. Each different party is resolved once. aliases: normalized_alias, cin."""
    found = party_events(orders, kind, text, key)
    if aliases is None:
        aliases = master.limit(0).select(F.col("company_name").alias("normalized_alias"), "cin")
    names = found.select(F.col("party").alias("qid"), F.col("party").alias("raw_name")).distinct()
    who = resolve_light(names, master, aliases).select(F.col("qid").alias("party"), "cin", "confidence")
    return found.join(who, "party", "left").select(key, "party", "cin", "confidence", "event_type", "severity")


def capital_increases(old: DataFrame, new: DataFrame, share: float = 0.5) -> DataFrame:
    """Companies whose paid-up capital has risen by more than the share: the rise among the changes of capital that
    diff_companies reports, which composite rules ask for by this name."""
    both = new.select("cin", whole("paid_up_capital").alias("now")).join(old.select("cin", whole("paid_up_capital").alias("was")), "cin")
    return both.filter((F.col("was") > 0) & ((F.col("now") - F.col("was")).cast("double") / F.col("was") > share)).select("cin", F.lit("CAPITAL_INCREASE").alias("event_type"), F.lit("INFO").alias("severity"))


def not_done(jobs: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Backfill guard: the keys without a completed state."""
    return jobs.join(state.filter("complete").select(key), key, "left_anti")
