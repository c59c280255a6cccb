"""Watchlist matching, batching, digests and delivery bookkeeping (survey 2.L), feedback and operations (2.M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.functions.clean import as_json, lag_hours, severity_rank, source_colour, subscriber_rank
from riskloom.sources.shared import kept

DAY_US = 86_400_000_000


def match_watchlists(events: DataFrame, watchlists: DataFrame, master: DataFrame, most_sent: int = 100_000, slots: int = 256) -> DataFrame:
    """One pending alert for each event and active watchlist that passes all filters (null filters pass).

    Watchlists that name companies join on the company, all others in one join on the state, the industry (either may be
    open) and the severities that they take. Up to `most_sent` of those are sent to every task; more are joined by shuffle
    over `slots` parts of each key. An empty list of companies matches none.
    """
    full = events.join(master.select("cin", "registered_state", "industrial_class"), "cin", "left")
    active = watchlists.filter("is_active")
    named = active.filter("cin_list is not null").select("*", F.explode("cin_list").alias("cin")).dropDuplicates(["watchlist_id", "cin"])
    a = full.join(named.drop("cin_list"), "cin")
    general = active.filter("cin_list is null").drop("cin_list")
    # a row for each severity rank that a list takes (0 stands for unknown ones); an event meets the lists of its four patterns of state and industry, named or open
    level = general.withColumn("takes", F.explode(F.array(*map(F.lit, sorted({0, *fixed.SEVERITY_RANK.values()}))))).filter(F.col("takes") >= severity_rank("severity_min"))
    nothing = F.lit(None).cast("string")
    patterns = [F.struct(state.alias("p_state"), sector.alias("p_sector")) for state in (F.col("registered_state"), nothing) for sector in (F.col("industrial_class"), nothing)]
    met = full.withColumn("pattern", F.explode(F.array_distinct(F.array(*patterns)))).select("*", "pattern.*").drop("pattern")
    on = F.col("p_state").eqNullSafe(F.col("state_filter")) & F.col("p_sector").eqNullSafe(F.col("sector_filter")) & (severity_rank("severity") == F.col("takes"))
    if general.limit(most_sent + 1).count() <= most_sent:
        by_pattern = met.join(F.broadcast(level), on)
    else:
        # most keys are hot: events are dealt into slots, and the lists, which are fewer, are repeated for each slot
        dealt = met.withColumn("e_slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
        by_pattern = dealt.join(level.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), on & (F.col("e_slot") == F.col("slot")))
    both = a.unionByName(by_pattern.select(*a.columns))
    ok = (F.col("state_filter").isNull() | (F.col("state_filter") == F.col("registered_state"))) & (F.col("sector_filter").isNull() | (F.col("sector_filter") == F.col("industrial_class"))) & (severity_rank("severity") >= severity_rank("severity_min")) & (F.col("type_filter").isNull() | F.array_contains("type_filter", F.col("event_type")))
    payload = as_json("cin", "event_type", "severity")
    return both.filter(F.coalesce(ok, F.lit(False))).select(F.col("id").alias("event_id"), "watchlist_id", "cin", "severity", "detected_at", payload.alias("alert_payload"), F.lit("PENDING").alias("delivery_status"))


def due_alerts(alerts: DataFrame, as_of: Column, most_retries: int = 3) -> DataFrame:
    hours = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.BATCH_HOURS.items() for x in kv]), F.col("severity"))
    ripe = (F.col("delivery_status") == "PENDING") & (F.unix_micros(as_of) - F.unix_micros("created_at") >= hours * 3_600_000_000)
    again = (F.col("delivery_status") == "FAILED") & (F.col("severity") == "CRITICAL") & (F.coalesce("retry_count", F.lit(0)) < most_retries)
    return alerts.filter(F.coalesce(ripe | again, F.lit(False)))


def build_digests(alerts: DataFrame) -> DataFrame:
    """One digest per watchlist and company: number of events, highest severity, score before the first and after the last,
    ids, and a batch id that depends on the ids only."""
    at = F.struct("detected_at", "event_id")
    out = alerts.groupBy("watchlist_id", "cin").agg(F.count("*").alias("n_events"), F.max_by("severity", F.struct(severity_rank("severity"), "detected_at", "event_id")).alias("max_severity"), F.min_by("score_before", at).alias("score_before"), F.max_by("score_after", at).alias("score_after"), F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    return out.withColumn("batch_id", F.substring(F.md5(F.array_join(F.transform("alert_ids", lambda x: x.cast("string")), ",")), 1, 16))


def mark_delivery(digests: DataFrame, outcomes: DataFrame, most_retries: int = 3) -> DataFrame:
    """Status after a send: delivered, failed, or permanently failed."""
    df = digests.join(outcomes.select("batch_id", "ok", "retry_count"), "batch_id", "left")
    tries = F.coalesce("retry_count", F.lit(0)) + 1
    status = F.when(F.col("ok").isNull(), "PENDING").when(F.col("ok"), "DELIVERED").when(tries >= most_retries, "PERMANENTLY_FAILED").otherwise("FAILED")
    return df.select("batch_id", "watchlist_id", "cin", channels("max_severity").alias("channels"), status.alias("delivery_status"), F.when(F.col("ok") == F.lit(False), tries).otherwise(F.coalesce("retry_count", F.lit(0))).alias("retry_count"))


def delivery_events(marked: DataFrame, as_of: Column) -> DataFrame:
    """An alert to the operator for each digest that has failed for good."""
    payload = as_json("watchlist_id", "batch_id")
    return marked.filter("delivery_status = 'PERMANENTLY_FAILED'").select("cin", F.lit("routing").alias("source"), F.lit("TELEGRAM_DELIVERY_FAILED").alias("event_type"), F.lit("ALERT").alias("severity"), as_of.alias("detected_at"), payload.alias("data_json"))


def channels(severity) -> Column:
    return F.when(F.col(severity) == "CRITICAL", F.array(F.lit("telegram"), F.lit("email"))).otherwise(F.array(F.lit("email")))


def subscriber_targets(events: DataFrame, subscribers: DataFrame, entries: DataFrame, delivered: DataFrame, hours: int = 24) -> DataFrame:
    """Subscribers that watch the company and take its severity, unless they had the same alert in the last hours."""
    who = entries.join(subscribers.select("subscriber_id", "severity_threshold"), "subscriber_id").select("subscriber_id", "cin", "severity_threshold").distinct()
    hit = events.join(who, "cin").filter(subscriber_rank("severity") >= subscriber_rank("severity_threshold"))
    past = delivered.select("subscriber_id", "cin", "event_type", F.col("delivered_at"))
    cond = [hit.subscriber_id == past.subscriber_id, hit.cin == past.cin, hit.event_type == past.event_type, past.delivered_at <= hit.detected_at, F.unix_micros(hit.detected_at) - F.unix_micros(past.delivered_at) < hours * 3_600_000_000]
    return hit.join(past, cond, "left_anti").select("id", "subscriber_id", "cin", "event_type", "severity", channels("severity").alias("channels"))


def digest_text(digests: DataFrame) -> DataFrame:
    """Three fallback lines, and whether they are well formed."""
    lines = F.concat_ws("\n", F.concat(F.lit("- "), F.col("cin"), F.lit(": "), F.col("n_events").cast("string"), F.lit(" new events")), F.concat(F.lit("- Highest severity: "), F.col("max_severity")), F.concat(F.lit("- Indicative score: "), F.coalesce(F.col("score_after").cast("string"), F.lit("unknown"))))
    return digests.withColumn("summary", lines).withColumn("well_formed", bullets_ok("summary"))


def bullets_ok(text) -> Column:
    rows = F.split(F.trim(text), "\n")
    return (F.size(rows) == 3) & F.forall(rows, lambda r: F.startswith(r, F.lit("- ")))


def alert_feed(delivered: DataFrame, master: DataFrame, events: DataFrame, n: int = 50) -> DataFrame:
    """Newest deliveries with the company's name and its latest event of that type."""
    top = delivered.orderBy(F.col("delivered_at").desc(), "subscriber_id", "cin", "event_type").limit(n)
    last = events.join(F.broadcast(top.select("cin", "event_type").distinct()), ["cin", "event_type"]).groupBy("cin", "event_type").agg(F.max("detected_at").alias("last_event_at"))
    return top.join(master.select("cin", "company_name"), "cin", "left").join(last, ["cin", "event_type"], "left").select("subscriber_id", "cin", F.coalesce("company_name", "cin").alias("company"), "event_type", "delivered_at", "last_event_at")


def subscriber_overview(subscribers: DataFrame, entries: DataFrame, delivered: DataFrame, as_of: Column) -> DataFrame:
    w = entries.groupBy("subscriber_id").agg(F.countDistinct("cin").alias("watching"))
    d = delivered.filter(F.col("delivered_at") >= F.date_trunc("month", as_of)).groupBy("subscriber_id").agg(F.count("*").alias("this_month"))
    return subscribers.join(w, "subscriber_id", "left").join(d, "subscriber_id", "left").select("subscriber_id", "severity_threshold", F.coalesce("watching", F.lit(0)).alias("watching"), F.coalesce("this_month", F.lit(0)).alias("this_month"))


def watchlist_entries(entries: DataFrame, master: DataFrame) -> DataFrame:
    return entries.join(master.select("cin", "company_name", "registered_state"), "cin", "left").select("subscriber_id", "cin", F.coalesce("company_name", "cin").alias("company"), "registered_state")


def _successors(rows: DataFrame, key: list[str], span: int) -> DataFrame:
    """For each row (__r, key, __at) the first row of its key at least `span` later: __r and __next, null where there is none.

    Time is cut into bins of the span. The row sought is in the bin of __at + span, or else the first of the next bin that has
    rows: so a window holds one bin of a key with what looks for rows in it, and another one bin each of a key.
    """
    bin_ = lambda c: F.floor(c / span)
    at = F.struct("__at", "id", "__r")
    there = rows.select(*key, "__r", bin_(F.col("__at")).alias("__bin"), F.col("__at").alias("__t"), F.lit(1).alias("__real"), at.alias("__it"))
    sought = rows.select(*key, "__r", bin_(F.col("__at") + span).alias("__bin"), (F.col("__at") + span).alias("__t"), F.lit(0).alias("__real"), F.lit(None).cast(there.schema["__it"].dataType).alias("__it"))
    # from the last to the first, so that the row last seen is the next one in time
    after = Window.partitionBy(*key, "__bin").orderBy(F.desc("__t"), F.desc("__real"), F.desc("__it")).rowsBetween(Window.unboundedPreceding, 0)
    found = there.unionByName(sought).withColumn("__in", F.last("__it", ignorenulls=True).over(after)).filter("__real = 0")
    first = there.groupBy(*key, "__bin").agg(F.min("__it").alias("__first"))
    bins = first.unionByName(found.filter("__in is null").select(*key, "__bin").distinct().withColumn("__first", F.lit(None).cast(there.schema["__it"].dataType)))
    bins = bins.groupBy(*key, "__bin").agg(F.max("__first").alias("__first"))
    later = Window.partitionBy(*key).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__later", F.last("__first", ignorenulls=True).over(later))
    same = F.col("f.__bin") == F.col("b.__bin")
    for k in key:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"b.{k}"))
    return found.alias("f").join(bins.alias("b"), same, "left").select("f.__r", F.coalesce("f.__in", "b.__later")["__r"].alias("__next"))


def cool_down(events: DataFrame, days: int = 30, key: tuple[str, ...] = ("cin", "event_type")) -> DataFrame:
    """Events of a key that fire: the first, and each at least `days` after the last one that fired; events in between do not
    prolong the silence. Rows without a time fire. Of rows with the same time the one with the smallest id comes first.

    What fires next after a row that fires is the first row of its key at least `days` later. The rows on the way from each
    key's first one are found by doubling: with steps of 1, 2, 4 and so on such rows at once, so that as many rounds are
    needed as the longest way has binary digits. Rows are joined by number, and no key is gathered.
    """
    span = days * DAY_US
    rows = kept(events.withColumn("__at", F.unix_micros("detected_at")).withColumn("__r", F.monotonically_increasing_id()))
    timed = rows.filter("__at is not null").select(*key, "id", "__at", "__r")
    step = kept(_successors(timed, list(key), span).filter("__next is not null"))
    fires = kept(timed.groupBy(*key).agg(F.min(F.struct("__at", "id", "__r")).alias("f")).select("f.__r"))
    while step.limit(1).count():
        fires = kept(fires.unionByName(fires.join(step, "__r").select(F.col("__next").alias("__r"))))
        step = kept(step.alias("a").join(step.alias("b"), F.col("a.__next") == F.col("b.__r")).select("a.__r", "b.__next"))
    return rows.join(fires, "__r", "left_semi").select(*events.columns).unionByName(rows.filter("__at is null").select(*events.columns))


# ---- feedback and operations -----------------------------------------------------------------


def accuracy(predictions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = predictions.filter(F.col("fired_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    out = recent.agg(F.count("*").alias("alerts"), F.count_if(F.col("confirmed")).alias("confirmed"), F.count_if(F.col("false_positive")).alias("false_positives"), F.count_if(F.col("expired")).alias("expired"))
    judged = F.col("confirmed") + F.col("false_positives")
    return out.withColumn("accuracy", F.when(judged > 0, F.round(F.col("confirmed") * 100.0 / judged, 1)).otherwise(0.0).cast("double"))


def top_reasons(predictions: DataFrame, n: int = 5) -> DataFrame:
    """Event types that most false positives hold."""
    return predictions.filter("false_positive").select(F.explode("event_combination").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(n)


def within(left: DataFrame, right: DataFrame, key: list[str], t: str, u: str, seconds: int) -> DataFrame:
    """Interval join on a key: |t - u| up to some seconds, to the microsecond. Times are cut into bins of that length; a left
    row meets its own bin and the two next to it, so no key is joined with all of its rows."""
    span = seconds * 1_000_000
    bin_ = lambda c: F.floor(F.unix_micros(c) / span)
    a = left.withColumn("__bin", F.explode(F.array(bin_(t) - 1, bin_(t), bin_(t) + 1)))
    return a.join(right.withColumn("__bin", bin_(u)), [*key, "__bin"]).filter(F.abs(F.unix_micros(t) - F.unix_micros(u)) <= span).drop("__bin")


def apply_feedback(feedback: DataFrame, predictions: DataFrame, seconds: int = 3600) -> DataFrame:
    """Feedback on deliveries goes to the latest prediction within the hour."""
    met = within(feedback.select("cin", "delivered_at", "verdict"), predictions.select("cin", "prediction_id", "fired_at"), ["cin"], "delivered_at", "fired_at", seconds)
    last = met.groupBy("cin", "delivered_at", "verdict").agg(F.max_by("prediction_id", F.struct("fired_at", "prediction_id")).alias("prediction_id"))
    return last.select("prediction_id", "cin", (F.col("verdict") == "confirmed").alias("confirmed"), (F.col("verdict") == "false_positive").alias("false_positive"))


def expire(predictions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    open_ = F.col("confirmed").isNull() & F.col("false_positive").isNull()
    return predictions.withColumn("expired", F.coalesce("expired", F.lit(False)) | F.coalesce(open_ & (F.col("fired_at") < as_of - F.expr(f"INTERVAL {days} DAYS")), F.lit(False)))


def recalibrate(predictions: DataFrame, events: DataFrame, as_of: Column, days: int = 90, least: int = 5) -> DataFrame:
    """Decisions per source and severity from predictions near their events."""
    recent = predictions.filter(F.col("fired_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    met = within(recent, events.select("cin", "severity", "source", "detected_at"), ["cin", "severity"], "fired_at", "detected_at", 7200)
    per = met.groupBy("source", "severity").agg(F.count("*").alias("samples"), F.count_if(F.col("false_positive")).alias("fp"), F.count_if(F.col("confirmed")).alias("ok")).filter(F.col("samples") >= least)
    fp, ok = F.col("fp") / F.col("samples"), F.col("ok") / F.col("samples")
    action = F.when(fp > 0.2, "raise").when((ok > 0.95) & (F.col("samples") >= 10), "lower").otherwise("keep")
    return per.select("source", "severity", "samples", F.round(fp, 4).alias("fp_rate"), action.alias("action"))


def cost_summary(costs: DataFrame, threshold: float = 500.0) -> DataFrame:
    by = costs.groupBy("log_date", "service", "operation").agg(F.sum("cost_inr").alias("cost"), F.sum("units").alias("units"))
    day = F.sum("cost").over(Window.partitionBy("log_date"))
    return by.withColumn("day_total", day).withColumn("breached", F.col("day_total") > threshold)


def call_budget(costs: DataFrame, as_of: Column, service: str, cap: int = 500) -> DataFrame:
    used = costs.filter((F.col("service") == service) & (F.col("log_date") >= F.date_trunc("month", as_of).cast("date"))).agg(F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("used"))
    return used.withColumn("left", F.greatest(F.lit(cap) - F.col("used"), F.lit(0)).cast("long"))


def source_status(state: DataFrame, as_of: Column) -> DataFrame:
    """Sources, problems first, with lag and colour."""
    order = F.when(F.col("last_pull_at").isNull(), 3).when(F.col("status") == "UNREACHABLE", 2).when(F.col("consecutive_failures") > 0, 1).otherwise(0)
    return state.select("source_id", "status", "consecutive_failures", lag_hours("next_pull_at", as_of).alias("lag"), source_colour("status", "consecutive_failures", "last_pull_at").alias("colour"), order.alias("problem")).orderBy(F.desc("problem"), "source_id")


def failure_ladder(pulls: DataFrame, unreachable: int = 4) -> DataFrame:
    """Failures in a row up to each pull of a source, and the state that they give."""
    w = Window.partitionBy("source_id").orderBy("pull_at", "id")
    df = pulls.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(Window.partitionBy("source_id", "island").orderBy("pull_at", "id"))
    df = df.withColumn("failures", run)
    return df.withColumn("state", F.when(F.col("failures") >= unreachable, "UNREACHABLE").when(F.col("failures") > 0, "DEGRADED").otherwise("OK")).withColumn("operator_event", F.col("failures") == unreachable)


def top_events(events: DataFrame, as_of: Column, n: int = 5, hours: int = 24) -> DataFrame:
    recent = events.filter((F.col("detected_at") <= as_of) & (F.col("detected_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    return recent.orderBy(severity_rank("severity").desc(), F.col("detected_at").desc(), F.col("id").desc()).limit(n)


def mode(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(1)


def past_due(state: DataFrame, as_of: Column) -> DataFrame:
    """Sources whose next pull is past due, the latest first, with the hours since then."""
    hours = F.round((F.unix_timestamp(as_of) - F.unix_timestamp("next_pull_at")) / 3600.0, 2)
    return state.filter(F.col("next_pull_at") < as_of).select("source_id", "next_pull_at", "status", hours.alias("lag_hours")).orderBy(F.desc("lag_hours"), "source_id")


def expired_rows(rows: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    """Cached rows whose time is over; those without a time never expire."""
    return rows.filter(F.col(column) < as_of)


def daily_digest(events: DataFrame, master: DataFrame, state: DataFrame, costs: DataFrame, predictions: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """The operator's daily digest as rows (section, place, label, value): the five top events, the sources by colour,
    today's costs by service and operation, accuracy of critical predictions, the commonest reason of false ones, and the
    number of open names."""
    row = lambda df, section, place, label, value: df.select(F.lit(section).alias("section"), place.cast("int").alias("place"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    zero = F.lit(0)
    top = top_events(events, as_of).join(master.select("cin", "company_name"), "cin", "left")
    order = F.row_number().over(Window.orderBy(severity_rank("severity").desc(), F.col("detected_at").desc(), F.col("id").desc()))
    out = row(top, "top event", order, F.concat_ws(" ", F.coalesce("company_name", "cin", F.lit("Unknown")), "event_type", "severity"), F.col("id"))
    colour = F.when(F.col("last_pull_at").isNull(), "grey").when((F.lower("status") == "blocked") | (F.col("consecutive_failures") >= 3), "red").when(F.col("consecutive_failures") >= 1, "amber").otherwise("green")
    out = out.unionByName(row(state.groupBy(colour.alias("colour")).agg(F.count("*").alias("n")), "sources", zero, F.col("colour"), F.col("n")))
    today = costs.filter(F.col("log_date") == as_of.cast("date")).groupBy("service", "operation").agg(F.sum("cost_inr").alias("total"))
    out = out.unionByName(row(today, "costs", zero, F.concat_ws(" ", "service", "operation"), F.round("total", 4)))
    red = predictions.filter((F.col("severity") == "CRITICAL") & (F.col("fired_at") >= as_of - F.expr("INTERVAL 30 DAYS")))
    right = red.agg(F.count("*").alias("n"), F.count_if(F.col("confirmed")).alias("ok"))
    out = out.unionByName(row(right, "critical predictions", zero, F.lit("all"), F.col("n"))).unionByName(row(right, "critical predictions", zero, F.lit("confirmed"), F.col("ok")))
    out = out.unionByName(row(right, "critical predictions", zero, F.lit("per cent"), F.when(F.col("n") > 0, F.round(F.col("ok") * 100.0 / F.col("n"), 1)).otherwise(0.0)))
    wrong = predictions.filter(F.col("false_positive") & F.col("false_positive_reason").isNotNull() & (F.col("fired_at") >= as_of - F.expr("INTERVAL 30 DAYS")))
    out = out.unionByName(row(mode(wrong, "false_positive_reason"), "commonest false reason", zero, F.col("false_positive_reason"), F.col("n")))
    return out.unionByName(row(queue.filter("not resolved").agg(F.count("*").alias("n")), "open names", zero, F.lit("unresolved"), F.col("n")))
