"""Sources and sinks (survey 2.A): master file, scraped rows, JSON payloads, upserts, append-only events, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.functions.clean import any_date, cin_ok, director_number, present, whole
from riskloom.sources.shared import kept


def canonical(header: str) -> str:
    """Lower case, anything but letters and digits to one underscore, no byte-order mark."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", header.lstrip("﻿").strip().lower()).strip("_")


def by_alias(df: DataFrame, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Selects target columns by the first header that is an alias; missing ones are null, missing required ones raise."""
    have = {canonical(c): c for c in reversed(df.columns)}
    out, missing = [], []
    for target, names in aliases.items():
        found = next((have[n] for n in names if n in have), None)
        if found is None and target in required:
            missing.append(target)
        out.append((F.col(f"`{found}`").cast("string") if found is not None else F.lit(None).cast("string")).alias(target))
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*out)


def read_company_master(spark: SparkSession, path: str) -> DataFrame:
    return by_alias(spark.read.option("header", True).option("encoding", "UTF-8").csv(path), fixed.HEADER_ALIASES, fixed.REQUIRED_HEADERS)


# Headers of bulk-deal files.
DEAL_ALIASES = {"deal_date": ["date", "deal_date"], "scrip_code": ["scrip_code", "security_code"], "company_name": ["security_name", "company_name"], "client_name": ["client_name"], "deal_type": ["buy_sell", "deal_type"], "quantity": ["quantity"], "price": ["price"], "deal_value_inr": ["value", "deal_value"]}


def bulk_deals(df: DataFrame) -> DataFrame:
    d = by_alias(df, DEAL_ALIASES)
    return d.select(any_date("deal_date").alias("deal_date"), "scrip_code", "company_name", "client_name", "deal_type", *[whole(c).alias(c) for c in ("quantity", "price", "deal_value_inr")])


def reasons(df: DataFrame, as_of: Column | None = None, strict: bool = False) -> DataFrame:
    """Adds the reasons why a master row is bad. strict adds: dates in the future or before 1956, capital above 10,000 crore,
    names of fewer than three characters."""
    bad_date = lambda c: present(c).isNotNull() & any_date(c).isNull()
    bad_number = lambda c: present(c).isNotNull() & whole(c).isNull()
    tests = [(~cin_ok("cin"), "bad cin"), (present("company_name").isNull(), "no name"), (present("status").isNull(), "no status")]
    tests += [(bad_date(c), f"bad {c}") for c in ("date_of_incorporation", "date_of_last_agm")]
    tests += [(bad_number(c), f"bad {c}") for c in ("authorized_capital", "paid_up_capital")]
    if strict:
        day = any_date("date_of_incorporation")
        tests += [((day > as_of.cast("date")) | (day < F.lit("1956-01-01").cast("date")), "date out of range"), (whole("authorized_capital") > 100_000_000_000, "capital too large"), (F.length(present("company_name")) < 3, "short name")]
    return df.withColumn("reasons", F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for t, r in tests]), lambda x: x.isNotNull()))


def validate_master(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with their reasons."""
    checked = reasons(df, **options)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list, null_conflicts: bool = True) -> DataFrame:
    """Last write wins by key: new rows replace old ones; of new rows that share a key, the first by `order` counts.
    Without null_conflicts, rows with a null in the key never replace each other."""
    whole_key = F.lit(True)
    if not null_conflicts:
        for k in key:
            whole_key = whole_key & F.col(k).isNotNull()
    one = new.filter(whole_key).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    keep = old.join(one.select(*key), key, "left_anti").select(*old.columns)
    out = keep.unionByName(one.select(*old.columns))
    return out if null_conflicts else out.unionByName(new.filter(~whole_key).select(*old.columns))


def upsert_governance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Director edges by (din, cin, appointment); rows without a director number go, unknown appointments are appended."""
    ready = new.withColumn("din", director_number("din")).filter("din is not null")
    return upsert(old, ready, ["din", "cin", "date_of_appointment"], [F.col("designation")], null_conflicts=False)


def upsert_cases(old: DataFrame, new: DataFrame, seen_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases by (case_number, source): the table with new statuses, and the cases that were not there. Of new rows that share
    a key the last by seen_at counts, rows without a time before all others; at the same time, and where rows have no order
    (seen_at is None), it is the one with the greatest status."""
    order = [F.col(seen_at).desc_nulls_last()] if seen_at else []
    one = Window.partitionBy("case_number", "source").orderBy(*order, F.col("status").desc_nulls_last())
    new = new.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
    update = new.select("case_number", "source", F.col("status").alias("__s"))
    kept = old.join(update, ["case_number", "source"], "left").withColumn("status", F.coalesce("__s", "status")).select(*old.columns)
    fresh = new.join(old.select("case_number", "source"), ["case_number", "source"], "left_anti")
    return kept.unionByName(fresh.select(*old.columns)), fresh


def cells_to_records(rows: DataFrame, cells: str, positions: dict[str, int], least: int, date: str, since: Column, header: str) -> DataFrame:
    """Scraped table rows to records by position; short rows, the header and old rows go."""
    at = lambda i: F.try_element_at(cells, F.lit(i + 1))
    out = rows.filter((F.size(cells) >= least) & (F.lower(at(0)) != header.lower())).select("*", *[F.trim(at(i)).alias(n) for n, i in positions.items()])
    return out.withColumn(date, any_date(date)).filter(F.col(date).isNull() | (F.col(date) >= since)).drop(cells)


def text_lines_to_records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Director lines of a text: number, name, designation, date; one row for each key and number."""
    line = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    pattern = r"^\s*(\d{6,8})\s+([A-Za-z][A-Za-z .]*?)\s{2,}([A-Za-z ]+?)\s{2,}(\d{2}[/-]\d{2}[/-]\d{4})"
    get = lambda i: F.regexp_extract("line", pattern, i)
    out = line.filter(F.col("line").rlike(pattern)).select(key, "pos", director_number(get(1)).alias("din"), get(2).alias("name"), get(3).alias("designation"), any_date(get(4)).alias("appointed"))
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(key, "din").orderBy("pos"))).filter("__n = 1").drop("__n", "pos")


def json_depth(df: DataFrame, payload: str) -> int:
    """The deepest nesting of a column of JSON texts (0: no object or array), in one pass. Brackets inside strings do not count."""
    marks = F.expr(f"regexp_extract_all({payload}, '\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*+\"|[\\\\[\\\\]{{}}]', 0)")
    step = lambda a, m: F.struct((a["now"] + F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(m.isin("{", "["), 1).otherwise(0)).alias("most"))
    deep = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    return df.agg(F.coalesce(F.max(deep), F.lit(0)).alias("d")).first().d


def _nodes(df: DataFrame, key: str, payload: str, depth: int | None) -> DataFrame:
    """All (key, depth, pos, name, value) of nested JSON, level by level, down to the data's own depth."""
    level = df.select(key, F.try_parse_json(payload).alias("v"), F.array().cast("array<int>").alias("pos")).filter("v is not null")
    out = None
    for d in range(max(1, json_depth(df, payload) if depth is None else depth)):
        step = df.sparkSession.sql(f"SELECT {key}, concat(l.pos, array(e.pos)) AS pos, e.key AS name, e.value AS v FROM {{level}} l, LATERAL variant_explode(l.v) e", level=level)
        rows = step.select(key, F.lit(d).alias("depth"), "pos", "name", "v")
        out = rows if out is None else out.unionByName(rows)
        level = step.filter("schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%'").select(key, "v", "pos")
        if d % 4 == 3:  # the plan of a level holds those of all levels above it
            level = kept(level)
    return out


def json_deep_value(df: DataFrame, key: str, payload: str, tokens: list[str], depth: int | None = None) -> DataFrame:
    """The first value, level by level, whose name holds all tokens. depth: levels to look into; all of them without it."""
    test = F.lit(True)
    for t in tokens:
        test = test & F.contains(F.lower("name"), F.lit(t.lower()))
    return _nodes(df, key, payload, depth).filter(test).groupBy(key).agg(F.min_by(F.col("v").cast("string"), F.struct("depth", "pos")).alias("value"))


def json_records(df: DataFrame, key: str, payload: str, fields: dict[str, list[str]], depth: int | None = None) -> DataFrame:
    """Rows of arrays of objects, wherever they are nested, with fields picked by alias: an exact name first, then one that
    holds an alias. One row for each object that has any of the fields."""
    nodes = _nodes(df, key, payload, depth)
    objects = nodes.filter("name is null and schema_of_variant(v) like 'OBJECT%'").select(key, "pos", "v")
    pairs = df.sparkSession.sql(f"SELECT {key}, o.pos, regexp_replace(lower(e.key), '[^a-z0-9]', '') AS name, CAST(e.value AS STRING) AS value FROM {{objects}} o, LATERAL variant_explode(o.v) e", objects=objects)
    cols = []
    for target, names in fields.items():
        flat = [n.replace("_", "").lower() for n in names]
        rank = F.coalesce(*[F.when(F.col("name") == n, F.lit(i)) for i, n in enumerate(flat)], *[F.when(F.contains(F.col("name"), F.lit(n)), F.lit(100 + i)) for i, n in enumerate(flat)])
        cols.append(F.min_by(F.when(rank.isNotNull(), F.col("value")), rank).alias(target))
    out = pairs.groupBy(key, "pos").agg(*cols)
    some = F.lit(False)
    for target in fields:
        some = some | F.col(target).isNotNull()
    return out.filter(some)


def with_event_id(events: DataFrame) -> DataFrame:
    """Ids and dates of events from their natural key, so that a second run gives the same ones."""
    return events.withColumn("id", F.xxhash64("source", "cin", "event_type", "record_id")).withColumn("event_date", F.col("detected_at").cast("date"))


def append_events(events: DataFrame, path: str) -> None:
    with_event_id(events).write.mode("append").partitionBy("event_date").parquet(path)


def unmapped_rows(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sinks for names without a company, and for names that an operator decides."""
    return resolved.filter("sink = 'unmapped'"), resolved.filter("sink = 'resolution_queue'")


def store_identifiers(old: DataFrame, found: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Adds identifiers that are not there."""
    key = ["identifier_type", "identifier_value", "cin"]
    return old.unionByName(found.select(*key).distinct().join(old, key, "left_anti").withColumn("confidence", F.lit(confidence)))


def fill_identifier(master: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Fills an empty column of the master."""
    new = found.groupBy("cin").agg(F.min(column).alias("__new"))
    return master.join(new, "cin", "left").withColumn(column, F.coalesce(present(column), F.col("__new"))).drop("__new")


def save_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State by source and entity: new values replace old ones."""
    return upsert(old, new, ["source_id", "entity_key"], [F.col("updated_at").desc()])


def monitored(master: DataFrame, identifiers: DataFrame, watched: DataFrame | None, how: str, n: int = 200, below: float = 50, seed: int = 7) -> DataFrame:
    """Companies to check: with a tax number (column or map) while active, amber or red, watched, worst n by score, or n at
    random of those below a score or unscored (by hash, so that a rerun gives the same)."""
    if how == "gstin":
        mapped = identifiers.filter("identifier_type = 'GSTIN'").select("cin").distinct().withColumn("__m", F.lit(True))
        df = master.join(mapped, "cin", "left").filter((F.col("status") == "Active") & (present("gstin").isNotNull() | F.col("__m")))
    elif how == "stressed":
        df = master.filter(F.col("band").isin("AMBER", "RED"))
    elif how == "watched":
        df = master.join(watched.select("cin").distinct(), "cin", "left_semi")
    elif how == "worst":
        df = master.orderBy(F.col("score").asc_nulls_last(), "cin").limit(n)
    else:
        df = master.filter(F.col("score").isNull() | (F.col("score") < below)).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "cin")), "cin").limit(n)
    return df.select("cin")


def gstin_candidates(companies: DataFrame, states: int = 39) -> DataFrame:
    """All tax numbers that a PAN can have, the registered state's first: state code, PAN, entity 1, Z, check digit.
    The table of state codes has 39 rows and is exploded, not joined."""
    code = F.explode(F.transform(F.sequence(F.lit(1), F.lit(states)), lambda i: F.lpad(i.cast("string"), 2, "0")))
    df = companies.select("cin", "pan", "state_code", code.alias("code")).withColumn("body", F.concat("code", "pan", F.lit("1Z")))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    total = F.expr(f"aggregate(sequence(1, 14), 0, (a, i) -> a + int(((instr('{digits}', substring(body, i, 1)) - 1) * if(i % 2 = 1, 1, 2)) div 36) + ((instr('{digits}', substring(body, i, 1)) - 1) * if(i % 2 = 1, 1, 2)) % 36)")
    df = df.withColumn("check", F.substr(F.lit(digits), (36 - total % 36) % 36 + 1, F.lit(1)))
    w = Window.partitionBy("cin").orderBy((F.col("code") != F.col("state_code")).cast("int"), "code")
    return df.select("cin", F.concat("body", "check").alias("gstin"), F.row_number().over(w).alias("rank"))
