"""Signals that the survey finds in documents only (2.O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.clean import severity_rank
from riskloom.operators.score import active_edges, latest


def legal_velocity(cases: DataFrame, as_of: Column, days: int = 30, level: float = 0.05) -> DataFrame:
    """Chance of as many cases in 30 days under the company's monthly rate before; only more than usual counts."""
    age = F.datediff(as_of, F.col("filing_date").cast("date"))
    n = cases.filter(age >= 0).groupBy("cin").agg(F.count_if(age < days).alias("k"), F.count_if(age >= days).alias("before"), F.max(age).alias("oldest"))
    months = F.greatest((F.col("oldest") - days) / 30.0, F.lit(1.0))
    n = n.withColumn("rate", F.col("before") / months).filter("rate > 0 and k > rate")
    log_p = F.col("k") * F.log("rate") - F.col("rate") - F.expr("aggregate(sequence(1, k), 0D, (a, i) -> a + ln(cast(i as double)))")
    return n.withColumn("p", F.exp(log_p)).filter(F.col("p") < level).select("cin", "k", "rate", "p", F.lit("CRITICAL").alias("severity"))


def changes(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Adds the value before and the ratio to it."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("was", F.lag(value).over(w)).withColumn("ratio", F.when(F.col("was") != 0, F.col(value) / F.col("was")))


def head_count(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Month-over-month drops and surges of a fifth or more, and companies that fall to none."""
    c = changes(df, ["cin"], "month", "headcount")
    kind = F.when((F.col("was") > 0) & (F.col("headcount") == 0), "EPFO_DELISTED").when(F.col("ratio") <= 1 - share, "EPFO_CONTRIBUTION_DROP").when(F.col("ratio") >= 1 + share, "EPFO_HIRING_SURGE")
    return c.withColumn("event_type", kind).filter("event_type is not null").select("cin", "month", "event_type")


def postings(df: DataFrame, factor: float = 3.0) -> DataFrame:
    c = changes(df, ["cin"], "month", "postings")
    kind = F.when((F.col("was") > 0) & (F.col("postings") == 0), "ALL_POSTINGS_REMOVED").when(F.col("ratio") > factor, "POSTING_SPIKE")
    return c.withColumn("event_type", kind).filter("event_type is not null").select("cin", "month", "event_type")


def reviews(df: DataFrame, factor: float = 3.0, low: float = 3.0) -> DataFrame:
    """Employee reviews: more than `factor` times the month before, and a rating that drops below `low`."""
    c = changes(df, ["cin"], "month", "reviews")
    was = F.lag("rating").over(Window.partitionBy("cin").orderBy("month"))
    c = c.withColumn("kinds", F.filter(F.array(F.when(F.col("ratio") > factor, F.lit("REVIEW_SPIKE")), F.when((F.col("rating") < low) & (was >= low), F.lit("RATING_LOW"))), lambda x: x.isNotNull()))
    return c.select("cin", "month", F.explode("kinds").alias("event_type"))


def financial_change(df: DataFrame) -> DataFrame:
    """Revenue down by a fifth, debt up by half, from year to year."""
    r = changes(df, ["cin"], "financial_year", "revenue").select("cin", "financial_year", F.col("ratio").alias("r"), "debt")
    d = changes(r, ["cin"], "financial_year", "debt")
    e = F.array(F.when(F.col("r") <= 0.8, F.lit("REVENUE_DROP")), F.when(F.col("ratio") >= 1.5, F.lit("DEBT_RISE")))
    return d.select("cin", "financial_year", F.explode(F.filter(e, lambda x: x.isNotNull())).alias("event_type"))


def working_capital(df: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Change of working capital from head count and filing delay, with coefficients per sector."""
    w = Window.partitionBy("cin").orderBy("month")
    d = df.join(coefficients, "industrial_class").withColumn("dh", F.col("headcount") - F.lag("headcount").over(w)).withColumn("dd", F.col("filing_delay") - F.lag("filing_delay").over(w))
    return d.withColumn("delta", F.col("alpha") * F.col("dh") - F.col("beta") * F.col("dd")).filter("delta < 0 and dh <= 0").select("cin", "month", "delta", F.lit("WATCH").alias("severity"))


def centrality(edges: DataFrame, capital: DataFrame, keep, rounds: int = 60, residual: float = 1e-4, steps: int = 5) -> DataFrame:
    """Capital-weighted eigenvector centrality over shared directors: power iteration on company - director - company, which
    never lists pairs of companies. After every `steps` rounds the values are written and compared with the round before: it
    stops when none has moved by `residual` or more, after `rounds` at the latest. Companies that share no director have 0;
    those without capital are left out. keep: writes a table and reads it back."""
    a = active_edges(edges).join(capital.select("cin", F.col("capital").cast("double").alias("w")), "cin").filter("w > 0")
    linked = keep(a.join(a.groupBy("din").agg(F.count("*").alias("k")).filter("k > 1").select("din"), "din", "left_semi").select("din", "cin", "w"))
    v = linked.select("cin").distinct().withColumn("x", F.lit(1.0))
    for _ in range(0, rounds, steps):
        for _ in range(steps):
            mine = linked.join(v.select("cin", "x").hint("merge"), "cin")  # sent in every round, the values would add up on the driver
            y = mine.groupBy("din").agg(F.sum(F.col("x") * F.col("w")).alias("y"))
            v = mine.join(y.hint("merge"), "din").groupBy("cin").agg(F.sum("y").alias("x"), F.max("x").alias("was"))
        v = keep(v)
        top, before = v.agg(F.max("x"), F.max("was")).first()
        if top is None:
            break
        moved = v.agg(F.max(F.abs(F.col("x") / top - F.col("was") / before))).first()[0]
        v = v.select("cin", (F.col("x") / top).alias("x"))
        if moved < residual:
            break
    every = a.select("cin").distinct().join(v.select("cin", "x"), "cin", "left")
    return every.select("cin", F.round(F.coalesce("x", F.lit(0.0)), 4).alias("centrality"))


def sector_stress(scores: DataFrame, least: int = 5, drop: float = 15.0) -> DataFrame:
    """Companies of the groups whose mean drop of score is above the limit."""
    g = scores.groupBy("registered_state", "industrial_class").agg(F.avg(F.col("score_before") - F.col("score_after")).alias("stress"), F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("stress") > drop))
    s, t = scores.alias("s"), g.alias("g")
    return s.join(t, F.expr("s.registered_state <=> g.registered_state and s.industrial_class <=> g.industrial_class")).select("s.cin", "s.registered_state", "s.industrial_class", F.round("g.stress", 4).alias("stress"), F.lit("SECTOR_STRESS").alias("event_type"))


def auto_confirm(predictions: DataFrame, events: DataFrame, as_of: Column, days: int = 180, kinds: tuple = ("CIRP_ADMITTED", "SARFAESI_AUCTION_SCHEDULED", "COMPANY_REMOVED")) -> DataFrame:
    """Predictions that an outcome within the days confirms; old ones without expire."""
    out = events.filter(F.col("event_type").isin(list(kinds))).select("cin", "detected_at")
    hit = predictions.join(out, "cin").filter((F.col("detected_at") >= F.col("fired_at")) & (F.col("detected_at") <= F.col("fired_at") + F.expr(f"INTERVAL {days} DAYS"))).groupBy("prediction_id").agg(F.min("detected_at").alias("confirmed_at"))
    df = predictions.join(hit, "prediction_id", "left")
    return df.select("prediction_id", "cin", F.col("confirmed_at").isNotNull().alias("confirmed"), (F.col("confirmed_at").isNull() & (F.col("fired_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))).alias("expired"))


def recalibrate_weights(weights: DataFrame, results: DataFrame, step: float = 0.05, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """Component weights up where it was more often right than wrong, down otherwise, within bounds. results: component, ok."""
    r = results.groupBy("component").agg((F.sum(F.when(F.col("ok"), 1).otherwise(-1))).alias("net"))
    move = F.signum(F.coalesce(F.col("net"), F.lit(0)).cast("double")) * step
    return weights.join(r, "component", "left").select("component", F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight") + move)), 4).alias("weight"))


def contagious_directors(appointments: DataFrame, edges: DataFrame, bands: DataFrame) -> DataFrame:
    """New appointments of directors who sit on the board of a red company."""
    red = active_edges(edges).join(bands.filter("band = 'RED'").select("cin"), "cin").select("din", F.col("cin").alias("red_cin"))
    return appointments.select("din", "cin").join(red, "din").filter("cin <> red_cin").groupBy("din", "cin").agg(F.min("red_cin").alias("red_cin")).withColumn("event_type", F.lit("CONTAGIOUS_DIRECTOR"))


def freshness(state: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Hours since the last pull against the source's limit."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_pull_at")) / 3600.0
    return state.join(limits, "source_id").select("source_id", F.round(hours, 2).alias("age_hours"), "max_hours", F.coalesce(hours > F.col("max_hours"), F.lit(True)).alias("late"))


def suggestions(contagion: DataFrame, watched: DataFrame) -> DataFrame:
    """Companies that contagion reached from watched ones and that the subscriber does not watch."""
    w = watched.select("subscriber_id", F.col("cin").alias("origin"))
    return contagion.select("cin", "origin").join(w, "origin").select("subscriber_id", "cin").distinct().join(watched.select("subscriber_id", "cin"), ["subscriber_id", "cin"], "left_anti")


def confidence_label(events: DataFrame) -> DataFrame:
    """HIGH from three independent sources, MEDIUM from two, LOW from one."""
    n = events.groupBy("cin").agg(F.countDistinct("source").alias("sources"))
    return n.withColumn("label", F.when(F.col("sources") >= 3, "HIGH").when(F.col("sources") == 2, "MEDIUM").otherwise("LOW"))


def strike_off_spikes(events: DataFrame, master: DataFrame, factor: float = 2.0) -> DataFrame:
    """State, industry and month with at least `factor` times the strike-offs of the month before it in the table."""
    m = events.join(master.select("cin", "registered_state", "industrial_class"), "cin").groupBy("registered_state", "industrial_class", F.date_trunc("month", "detected_at").cast("date").alias("month")).agg(F.count("*").alias("n"))
    c = changes(m, ["registered_state", "industrial_class"], "month", "n")
    return c.filter(F.col("ratio") >= factor).select("registered_state", "industrial_class", "month", "n", "was")


def alert_record(digests: DataFrame, penalties: DataFrame, labels: DataFrame, master: DataFrame, events: DataFrame, late: DataFrame) -> DataFrame:
    """Full alert: digest, company, direction of the score, all kinds of signals that the company has, contagion, confidence,
    and the sources of the company whose data are late. late: source_id, late."""
    per = events.select("cin", "source", "event_type").distinct().join(late.filter("late").select(F.col("source_id").alias("source"), F.lit(True).alias("late")), "source", "left")
    per = per.groupBy("cin").agg(F.array_sort(F.collect_set("event_type")).alias("signals"), F.array_sort(F.collect_set(F.when(F.col("late"), F.col("source")))).alias("late_sources"))
    direction = F.when(F.col("score_after") < F.col("score_before"), "down").when(F.col("score_after") > F.col("score_before"), "up").otherwise("same")
    df = digests.join(master.select("cin", "company_name"), "cin", "left").join(penalties.select("cin", "penalty"), "cin", "left").join(labels.select("cin", "label"), "cin", "left").join(per, "cin", "left")
    return df.select("batch_id", "watchlist_id", "cin", "company_name", "n_events", "max_severity", direction.alias("direction"), F.coalesce("penalty", F.lit(0)).alias("penalty"), F.coalesce("label", F.lit("LOW")).alias("confidence"), severity_rank("max_severity").alias("rank"), "signals", "late_sources")


def latest_auditor(edges: DataFrame) -> DataFrame:
    df = edges.filter(F.contains(F.lower("designation"), F.lit("auditor")))
    return df.groupBy("cin").agg(F.max_by("din", F.struct(F.coalesce(F.col("date_of_appointment").cast("date"), F.lit("1900-01-01").cast("date")), "din")).alias("din"))


def recent_events(events: DataFrame, n: int = 10) -> DataFrame:
    return latest(events, ["cin"], n, F.col("detected_at").desc(), F.col("id").desc()).select("cin", "rank", "id", "event_type")
