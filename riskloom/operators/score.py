"""Health scores, contagion, composite signals, shell companies and sector clusters (survey 2.K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.functions.clean import band

_CLOSED = ["Disposed", "Dismissed", "Withdrawn", "Closed"]


def filing_freshness(master: DataFrame, as_of: Column) -> DataFrame:
    months = F.datediff(as_of, F.col("date_of_last_agm").cast("date")) / 30.44
    score = F.when(months.isNull(), F.when(F.col("status") == "Active", 30.0).otherwise(0.0)).when(months < 12, 100.0).when(months < 18, 70.0).when(months < 24, 40.0).when(months < 36, 15.0).otherwise(0.0)
    return master.select("cin", score.alias("filing_freshness"))


def director_stability(edges: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    since = F.date_sub(as_of.cast("date"), days)
    changed = (F.col("date_of_appointment").cast("date") >= since) | F.coalesce(F.col("cessation_date").cast("date") >= since, F.lit(False))
    n = edges.filter(changed).groupBy("cin").agg(F.count("*").alias("n"))
    return n.select("cin", F.when(F.col("n") == 1, 80.0).when(F.col("n") == 2, 50.0).otherwise(20.0).alias("director_stability"))


def case_counts(cases: DataFrame) -> DataFrame:
    """Open cases per company: all, cheque cases, and whether a priority type is among them. Unknown status is not open."""
    open_ = cases.filter(F.col("status").isNotNull() & ~F.col("status").isin(_CLOSED))
    return open_.groupBy("cin").agg(F.count("*").alias("cases"), F.count_if(F.col("case_type") == "SEC_138").alias("cheque"), F.bool_or(F.col("case_type").isin(fixed.PRIORITY_CASES)).alias("priority"))


def legal_risk(cases: DataFrame) -> DataFrame:
    score = F.when(F.col("priority"), 5.0).when(F.col("cases") >= 3, 20.0).when(F.col("cheque").between(1, 2), 50.0).when((F.col("cases") == 1) & (F.col("cheque") == 0), 80.0).otherwise(100.0)
    return case_counts(cases).select("cin", score.alias("legal_risk"))


def financial_health(snapshots: DataFrame) -> DataFrame:
    """By the latest year's ratio; a latest row without a ratio is neutral."""
    last = snapshots.groupBy("cin").agg(F.max_by(F.struct("debt_to_equity"), "financial_year").alias("s")).select("cin", F.col("s.debt_to_equity").cast("double").alias("d"))
    return last.select("cin", F.when(F.col("d").isNull(), 50.0).when(F.col("d") < 1, 100.0).when(F.col("d") <= 2, 70.0).when(F.col("d") <= 4, 40.0).otherwise(15.0).alias("financial_health"))


def capital_trajectory(master: DataFrame, events: DataFrame) -> DataFrame:
    """Capital now against the one before the latest capital change."""
    last = events.filter("event_type = 'CAPITAL_CHANGE'").groupBy("cin").agg(F.max_by("data_json", F.struct("detected_at", "id")).alias("j"))
    both = master.join(last, "cin", "left").withColumn("was", F.get_json_object("j", "$.previous_capital").try_cast("double")).withColumn("now", F.col("authorized_capital").cast("double"))
    pct = (F.col("now") - F.col("was")) / F.nullif(F.col("was"), F.lit(0.0)) * 100
    return both.withColumn("pct", pct).select("cin", F.when(F.col("pct").isNull(), 50.0).when(F.col("pct") > 5, 100.0).when(F.col("pct") >= -5, 60.0).otherwise(20.0).alias("capital_trajectory"))


def components(master: DataFrame, edges: DataFrame, cases: DataFrame, snapshots: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    out = master.select("cin", "health_score_before", "health_band_before") if "health_score_before" in master.columns else master.select("cin", F.lit(50).alias("health_score_before"), F.lit("AMBER").alias("health_band_before"))
    for part in (filing_freshness(master, as_of), director_stability(edges, as_of), legal_risk(cases), financial_health(snapshots), capital_trajectory(master, events)):
        out = out.join(part, "cin", "left")
    return out.fillna({"filing_freshness": 30.0, "director_stability": 100.0, "legal_risk": 100.0, "financial_health": 50.0, "capital_trajectory": 50.0})


def weigh(parts: DataFrame, penalty: DataFrame | None = None) -> DataFrame:
    """Weighted sum less the penalty, within 0 and 100, rounded to one decimal; the band comes from that, the stored score
    is its whole part."""
    total = sum((F.col(c) * w for c, w in fixed.WEIGHTS.items()), F.lit(0.0))
    df = parts.join(penalty.select("cin", "penalty"), "cin", "left") if penalty is not None else parts.withColumn("penalty", F.lit(0))
    df = df.withColumn("penalty", F.coalesce("penalty", F.lit(0))).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total - F.col("penalty"))), 1))
    return df.withColumn("band", band("score")).withColumn("score_stored", F.col("score").cast("int"))


def active_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("cessation_date is null").select("din", "cin").distinct()


def peers(edges: DataFrame, frontier: DataFrame | None = None, most_boards: int | None = None) -> DataFrame:
    """Pairs (cin, peer) of companies that share an active director. The left side can be limited to some companies, so
    that only their boards are expanded; directors with more than most_boards boards can be left out."""
    a = active_edges(edges)
    if most_boards is not None:
        a = a.join(a.groupBy("din").agg(F.count("*").alias("k")).filter(F.col("k") <= most_boards).select("din"), "din", "left_semi")
    left = a if frontier is None else a.join(frontier.select("cin").distinct(), "cin", "left_semi")
    return left.join(a.withColumnRenamed("cin", "peer"), "din").filter("cin <> peer").select("cin", "peer").distinct()


def contagion_penalty(pairs: DataFrame, bands: DataFrame) -> DataFrame:
    """Penalty of each company with the peers that cause it. bands: cin, band."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.PEER_PENALTY.items() for x in kv]), F.col("band"))
    return pairs.join(bands.select(F.col("cin").alias("peer"), "band"), "peer").filter(F.col("band").isin(list(fixed.PEER_PENALTY))).groupBy("cin").agg(F.sum(w).alias("penalty"), F.count("*").alias("peers"), F.array_sort(F.collect_list("peer")).alias("contributors"))


def propagate(scores: DataFrame, edges: DataFrame, changed: DataFrame, keep, depth: int = 2) -> DataFrame:
    """Contagion from companies whose band changed: their peers are scored anew with a penalty, then the peers of those
    whose band changed by it, `depth` levels deep. All peers of a level see the bands at its start. scores: cin, score
    (without penalty), band. keep: writes a level's table and reads it back, which cuts its lineage.
    Returns cin, depth, origin, chain (companies from the origin to this one; of several the least), penalty, score_before,
    score_after, band_before, band_after."""
    bands, done, out = scores.select("cin", "score", "band"), changed.select("cin").distinct(), None
    frontier = changed.select("cin", F.array("cin").alias("chain"))
    for level in range(1, depth + 1):
        touched = peers(edges, frontier).join(frontier, "cin").groupBy("peer").agg(F.min("chain").alias("chain")).withColumnRenamed("peer", "cin").join(done, "cin", "left_anti")
        touched = touched.select("cin", F.element_at("chain", 1).alias("origin"), F.concat("chain", F.array("cin")).alias("chain"))
        hit = contagion_penalty(peers(edges, touched), bands)
        now = touched.join(bands, "cin").join(hit.select("cin", "penalty"), "cin", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0)))
        now = now.withColumn("after", F.round(F.greatest(F.lit(0.0), F.col("score") - F.col("penalty")), 1)).withColumn("band_after", band("after"))
        now = keep(now.select("cin", F.lit(level).alias("depth"), "origin", "chain", "penalty", F.col("score").alias("score_before"), F.col("after").alias("score_after"), F.col("band").alias("band_before"), "band_after"))
        out = now if out is None else out.unionByName(now)
        bands = bands.join(now.select("cin", F.col("band_after").alias("nb")), "cin", "left").select("cin", "score", F.coalesce("nb", "band").alias("band"))
        done, frontier = done.union(now.select("cin")).distinct(), now.filter("band_after <> band_before").select("cin", "chain")
    return out


def contagion_events(reached: DataFrame, as_of: Column) -> DataFrame:
    """An event for each company that contagion has reached, with origin, depth and chain."""
    chain = F.concat(F.lit('["'), F.array_join("chain", '","'), F.lit('"]'))
    payload = F.concat(F.lit('{"origin_cin":"'), "origin", F.lit('","depth":'), F.col("depth") - 1, F.lit(',"chain":'), chain, F.lit("}"))
    return reached.select("cin", F.lit("CONTAGION_ENGINE").alias("source"), F.lit("CONTAGION_PROPAGATED").alias("event_type"), F.lit("WATCH").alias("severity"), as_of.alias("detected_at"), payload.alias("data_json"))


def apply_scores(events: DataFrame, scored: DataFrame) -> DataFrame:
    """Events with the score before and after, and whether a prediction is due."""
    return events.join(scored.select("cin", F.col("health_score_before"), F.col("score_stored").alias("health_score_after"), F.col("band")), "cin").select("id", "cin", "event_type", "severity", "health_score_before", "health_score_after", "band")


def scored_master(master: DataFrame, scored: DataFrame, as_of: Column) -> DataFrame:
    """The master with score, band and time of the scored companies; the others keep theirs."""
    new = scored.select("cin", F.col("score_stored").alias("__s"), F.col("band").alias("__b"))
    both = master.join(new, "cin", "left")
    have = lambda c, kind: F.col(c) if c in master.columns else F.lit(None).cast(kind)
    return both.withColumn("health_score", F.coalesce("__s", have("health_score", "int"))).withColumn("health_band", F.coalesce("__b", have("health_band", "string"))).withColumn("last_score_computed_at", F.when(F.col("__s").isNotNull(), as_of).otherwise(have("last_score_computed_at", "timestamp"))).drop("__s", "__b")


def predictions_of(events: DataFrame, scored: DataFrame, as_of: Column) -> DataFrame:
    """A prediction for each event of a scored company, with the event's severity and the score at firing."""
    return events.join(scored.select("cin", "score_stored"), "cin").select("cin", F.col("id").alias("event_id"), F.col("score_stored").alias("health_score_at_firing"), "severity", as_of.alias("fired_at"))


def rule_conditions(spark, rules: dict = fixed.COMPOSITES) -> DataFrame:
    rows = [(name, severity, window or 365, len(conditions), i, c if isinstance(c, list) else None, c.get("status") if isinstance(c, dict) else None) for name, (severity, window, conditions) in rules.items() for i, c in enumerate(conditions)]
    return spark.createDataFrame(rows, "rule string, severity string, days int, needed int, condition int, types array<string>, status string")


def combine_signals(events: DataFrame, master: DataFrame, as_of: Column, fired: DataFrame | None = None, aliases: dict | None = fixed.EVENT_ALIASES, rules: dict = fixed.COMPOSITES, cool_days: int = 30, new: DataFrame | None = None, silent_days: int = 365) -> DataFrame:
    """Composite signals per company: every condition of a rule met within the rule's days; newest event of each.

    new: cin, event_type of the events that have just come; with it only rules that name one of the company's new types are
    tried. A rule whose own name is among the company's events of the last silent_days stays silent.

    The rules are a small fixed table and are broadcast; events are joined once on their type, then grouped by company and
    rule. fired: cin, rule, detected_at of earlier composites, which keep the rule silent for cool_days.
    """
    spark = events.sparkSession
    conditions = rule_conditions(spark, rules)
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv]), F.col("event_type")), F.col("event_type"))
    typed = events.filter("cin is not null").select("id", "cin", name.alias("event_type"), "detected_at")
    by_type = F.broadcast(conditions.filter("types is not null").select("rule", "severity", "days", "needed", "condition", F.explode("types").alias("event_type")))
    met = typed.join(by_type, "event_type").filter((F.col("detected_at") <= as_of) & (F.unix_timestamp("detected_at") >= F.unix_timestamp(as_of) - F.col("days") * 86400))
    per = met.groupBy("cin", "rule", "severity", "needed", "condition").agg(F.max_by("id", F.struct("detected_at", "id")).alias("id"))
    by_field = F.broadcast(conditions.filter("status is not null").select("rule", "severity", "needed", "condition", "status"))
    # a company field alone starts no rule
    fields = per.select("cin", "rule").distinct().join(by_field, "rule").join(master.select("cin", "status"), ["cin", "status"]).select("cin", "rule", "severity", "needed", "condition", F.lit(None).cast("long").alias("id"))
    got = per.unionByName(fields).groupBy("cin", "rule", "severity", "needed").agg(F.countDistinct("condition").alias("n"), F.array_sort(F.collect_set("id")).alias("event_ids")).filter("n = needed")
    own = events.filter(F.col("event_type").isin(list(rules)) & (F.unix_timestamp("detected_at") >= F.unix_timestamp(as_of) - silent_days * 86400)).select("cin", F.col("event_type").alias("rule")).distinct()
    got = got.join(own, ["cin", "rule"], "left_anti")
    if new is not None:
        started = new.select("cin", name.alias("event_type")).distinct().join(by_type, "event_type").select("cin", "rule").distinct()
        got = got.join(started, ["cin", "rule"], "left_semi")
    if fired is not None:
        recent = fired.filter(F.unix_timestamp("detected_at") >= F.unix_timestamp(as_of) - cool_days * 86400).select("cin", "rule").distinct()
        got = got.join(recent, ["cin", "rule"], "left_anti")
    return got.select("cin", "rule", "severity", "event_ids")


def shell_companies(master: DataFrame, edges: DataFrame, as_of: Column, boards: int = 5, months: int = 36, capital: int = 1_000_000, fired: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Young companies of small capital without meeting, with a director on many boards; one row each, with the busiest
    director. They have no provident-fund and no tax number, or an event of the last 12 months that took it (delisted;
    cancelled or suspended). Clauses whose column the master lacks are true."""
    has = lambda c: c in master.columns
    young = F.timestamp_diff("MONTH", F.col("date_of_incorporation").cast("timestamp"), as_of) < months
    test = young & F.col("date_of_last_agm").isNull()
    if has("authorized_capital"):
        test = test & (F.col("authorized_capital") <= capital)
    for c, kinds in (("epfo_id", ["EPFO_ESTABLISHMENT_DELISTED"]), ("gstin", ["GST_CANCELLED", "GST_SUSPENDED"])):
        if has(c) and events is not None:
            lost = events.filter(F.col("event_type").isin(kinds) & (F.col("detected_at") > as_of - F.expr("INTERVAL 12 MONTHS")) & (F.col("detected_at") <= as_of)).select("cin").distinct()
            master = master.join(lost.withColumn(f"__{c}", F.lit(True)), "cin", "left")
            test = test & (F.col(c).isNull() | F.coalesce(F.col(f"__{c}"), F.lit(False)))
        elif has(c):
            test = test & F.col(c).isNull()
    a = active_edges(edges)
    busy = a.join(a.groupBy("din").agg(F.count("*").alias("boards")).filter(F.col("boards") >= boards), "din").groupBy("cin").agg(F.max("boards").alias("boards"), F.max_by("din", F.struct("boards", "din")).alias("din"))
    out = master.filter(test).select("cin").join(busy, "cin")
    if fired is not None:
        out = out.join(fired.filter(F.col("detected_at") >= as_of - F.expr("INTERVAL 30 DAYS")).select("cin").distinct(), "cin", "left_anti")
    return out.select("cin", "din", "boards")


def sector_clusters(scored: DataFrame, as_of: Column, least: int = 5, days: int = 30, fired: DataFrame | None = None) -> DataFrame:
    """Groups (state, industry) with many stressed active companies scored lately; a null state or industry is a group."""
    lately = scored.filter(F.col("band").isin("AMBER", "RED") & (F.col("status") == "Active") & (F.col("scored_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    out = lately.groupBy("registered_state", "industrial_class").agg(F.count("*").alias("stressed"), F.array_sort(F.collect_list("cin")).alias("cins")).filter(F.col("stressed") >= least)
    if fired is not None:
        out = out.join(fired.filter(F.col("detected_at") >= as_of - F.expr("INTERVAL 30 DAYS")).select("registered_state", "industrial_class").distinct(), ["registered_state", "industrial_class"], "left_anti")
    return out


def unscored(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Distinct (cin, event_type) of the last hours' events that still lack a score."""
    return events.filter(F.col("cin").isNotNull() & F.col("health_score_after").isNull() & (F.col("detected_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))).select("cin", "event_type").distinct()


def latest(df: DataFrame, key: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key by the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def company_profile(parts: DataFrame, events: DataFrame, cases: DataFrame, edges: DataFrame, n_events: int = 10) -> DataFrame:
    """Nested profile per company: weighted components, newest events, cases and directors."""
    e = latest(events, ["cin"], n_events, F.col("detected_at").desc(), F.col("id").desc()).groupBy("cin").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "event_type", "severity"))).alias("events"))
    c = cases.groupBy("cin").agg(F.array_sort(F.collect_list(F.struct("case_number", "case_type", "status"))).alias("cases"))
    d = edges.groupBy("cin").agg(F.array_sort(F.collect_list(F.struct(F.col("cessation_date").isNotNull().alias("ended"), "din"))).alias("directors"))
    weighted = [F.round(F.col(k) * w, 2).alias(f"{k}_weighted") for k, w in fixed.WEIGHTS.items()]
    return parts.select("cin", *fixed.WEIGHTS, *weighted).join(e, "cin", "left").join(c, "cin", "left").join(d, "cin", "left")
