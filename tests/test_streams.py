"""Streams over replayed rows equal their batch forms; odd orders, restarts and repeated batches have defined results."""

import datetime as dt
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskloom.streaming import monitor, replay, streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_state_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    replay.with_state(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def drained(stream, mode="append"):
    return replay.drained(stream, mode, seconds=100)


def in_batches(spark, schema, *batches):
    """A stream with a micro-batch for each list of rows."""
    path = replay.shared(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return replay.part_stream(spark, path, spark.createDataFrame([], schema).schema)


EVENTS = "key string, ts timestamp, id long, status string"


def events(spark):
    rows = [(str(i % 3), T0 + dt.timedelta(hours=i), i, ["active", "cancelled"][i // 3 % 2]) for i in range(30)]
    return spark.createDataFrame(rows + rows[:5], EVENTS), in_batches(spark, EVENTS, rows[:11], rows[11:] + rows[:5])


def test_repeats_go(spark):
    df, stream = events(spark)
    assert drained(streams.deduplicated(stream, ["id"], delay="10 days")).count() == df.select("id").distinct().count()


def test_windows(spark):
    df, stream = events(spark)
    got = {(r.window_start, r.key): r.n for r in drained(streams.rolling_counts(stream, ["key"], length="6 hours", step="6 hours", delay="10 days"), "complete").collect()}
    want = {(r.w, r.key): r.n for r in df.groupBy(F.window("ts", "6 hours").start.alias("w"), "key").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_status_changes_and_pulls_out_of_order(spark):
    """A pull before the last one of its key changes nothing; no time or no status leaves a pull out; others are in order."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    first = [("a", at(5), 5, "x"), ("a", at(3), 3, "y"), ("b", at(4), 1, "x"), ("a", None, 9, "z"), ("a", at(6), 6, None)]
    second = [("a", at(4), 4, "late"), ("a", at(8), 8, "y"), ("a", at(8), 7, "w"), ("b", at(9), 2, "x")]
    got = drained(streams.status_changes(in_batches(spark, EVENTS, first, second), delay="10 days"))
    assert sorted((r.key, r.id, r.was, r.status) for r in got.collect()) == [("a", 5, "y", "x"), ("a", 7, "x", "w"), ("a", 8, "w", "y")]
    assert {r.id: r.ts for r in got.collect()}[8] == at(8)


def test_states_go_by_event_time(spark):
    """After three days of silence a key of two days' memory starts anew; the timer goes by the watermark."""
    at = lambda d: T0 + dt.timedelta(days=d)
    stream = in_batches(spark, EVENTS, [("a", at(0), 0, "x")], [("b", at(9), 1, "x")], [("b", at(9.5), 2, "x")], [("a", at(10), 3, "y"), ("b", at(10), 4, "y")])
    got = drained(streams.status_changes(stream, days=2))
    assert [(r.key, r.id) for r in got.collect()] == [("b", 4)]


def test_cool_down_of_a_stream(spark):
    """Days 0, 20, 40 and 60 give two events: the suppressed one does not prolong the silence."""
    rows = [("U1", "A", T0 + dt.timedelta(days=d), d) for d in (0, 20, 40, 60)] + [("U1", "B", T0 + dt.timedelta(days=5), 5)]
    stream = in_batches(spark, "cin string, event_type string, ts timestamp, id long", rows[:1] + rows[4:], rows[1:3], rows[3:4])
    assert sorted(r.id for r in drained(streams.cooled(stream, delay="90 days")).collect()) == [0, 5, 40]


# ---- held alerts -----------------------------------------------------------------------------


class _List:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.timers, self.state = [], _List()

    def getListState(self, name, schema):
        return self.state

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    def __init__(self, hours=0):
        self.now = 1000 + hours * 3_600_000

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_held_alerts():
    """Each alert waits for its own severity's time: the ALERT's timer lets neither the WATCH nor the INFO out."""
    p, h = streams.HeldAlerts(), _Handle()
    p.init(h)
    rows = [Row(alert_id=i, severity=s, at=i, score_before=10 * i, score_after=i) for i, s in enumerate(["WATCH", "CRITICAL", "ALERT", "INFO", "ALERT"], 1)]
    now = list(p.handleInputRows((7, "U1"), iter(rows), _Clock()))
    assert [tuple(r) for r in now] == [(7, "U1", 1, "CRITICAL", 20, 2, [2])]
    assert sorted(h.timers) == [1000 + x * 3_600_000 for x in (4, 24, 168)]
    out = lambda hours: [tuple(r)[2:] for r in p.handleExpiredTimer((7, "U1"), _Clock(hours), None)]
    assert out(3) == [] and out(4) == [(2, "ALERT", 30, 5, [3, 5])]
    assert out(24) == [(1, "WATCH", 10, 1, [1])] and out(25) == [] and out(168) == [(1, "INFO", 40, 4, [4])] and out(200) == []


def test_held_alerts_through_a_restart(spark):
    """What was held when the stream stopped comes out after it starts again, once."""
    schema = "watchlist_id int, cin string, alert_id long, severity string, detected_at timestamp, score_before long, score_after long"
    row = lambda i, s: (1, "U1", i, s, T0 + dt.timedelta(hours=i), i, i)
    path, files = replay.shared(spark), replay.shared(spark)
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(files)
    writer = lambda: replay.into(streams.held_digests(replay.part_stream(spark, files, spark.createDataFrame([], schema).schema), 20), path)
    out = lambda: [i for r in spark.read.schema(streams.DIGEST).parquet(f"{path}/rows").collect() for i in r.alert_ids]
    put(row(1, "INFO"), row(2, "CRITICAL"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/batch=0/_SUCCESS")
    replay.run_until(writer(), lambda: folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder), 60)
    put(row(3, "INFO"), row(4, "WATCH"))
    replay.run_until(writer(), lambda: len(out()) >= 4, 60)
    assert sorted(out()) == [1, 2, 3, 4]


# ---- keys that last --------------------------------------------------------------------------


def test_durable_keys(spark, tmp_path):
    """Repeated keys go, null keys are equal, a batch that is run again writes the same; new keys alone read no key."""
    path = f"file://{tmp_path}"
    run = streams.append_unseen(path, ["key"], buckets=4)
    batch = lambda *keys: spark.createDataFrame([(k, "x") for k in keys], "key long, v string")
    rows = lambda: sorted((r.batch, -1 if r.key is None else r.key) for r in spark.read.parquet(f"{path}/rows").collect())
    for again in (1, 2):
        run(batch(1, 2, 2, None), 0)
    run(batch(2, 3, None), 1)
    run(batch(2, 3, None), 1)
    run(batch(), 2)
    assert rows() == [(0, -1), (0, 1), (0, 2), (1, 3)]
    read = []
    whole, streams.seen_keys = streams.seen_keys, lambda *a: read.append((a[4], df := whole(*a))) or df
    try:
        run(batch(*range(1000, 1100)), 3)
        run(batch(1), 4)
    finally:
        streams.seen_keys = whole
    assert read[0][0] == [] and "LocalTableScan <empty>" in read[0][1]._jdf.queryExecution().toString()
    buckets, old = read[1]
    assert len(buckets) == 1 and set(re.findall(r"bucket=(\d+)", " ".join(old.inputFiles()))) <= {str(b) for b in range(4)}
    assert re.search(rf"PartitionFilters: \[.*bucket.*{buckets[0]}", old._jdf.queryExecution().toString())


# ---- the chain of a micro-batch --------------------------------------------------------------


def test_chain_is_idempotent(spark):
    """A batch that is run again replaces its own results, and a later one sees each event once."""
    master = spark.createDataFrame([(f"U{i}", "Active", "S", "I", 4_000_000, None) for i in range(4)], "cin string, status string, registered_state string, industrial_class string, authorized_capital long, date_of_last_agm string")
    edges = spark.createDataFrame([("d1", "U0", None, None), ("d1", "U1", None, None), ("d2", "U1", None, None), ("d2", "U2", None, None)], "din string, cin string, date_of_appointment string, cessation_date string")
    cases = spark.createDataFrame([("U0", "SEC_138", "Pending")], "cin string, case_type string, status string")
    snapshots = spark.createDataFrame([("U0", 2020, 5.0)], "cin string, financial_year int, debt_to_equity double")
    lists = spark.createDataFrame([(1, None, None, "WATCH", None, None, True)], "watchlist_id int, state_filter string, sector_filter string, severity_min string, type_filter array<string>, cin_list array<string>, is_active boolean")
    event = lambda i, cin, kind, previous: (i, cin, kind, "ALERT", T0 + dt.timedelta(days=i), f'{{"previous_capital":{previous}}}')
    schema = "id long, cin string, event_type string, severity string, detected_at timestamp, data_json string"
    m = monitor.Monitor(replay.shared(spark), master, edges, cases, snapshots, lists, F.lit("2024-02-01").cast("timestamp"))
    m.start(spark.createDataFrame([], schema))
    one = spark.createDataFrame([event(1, "U0", "GST_CANCELLED", 0), event(2, "U0", "CAPITAL_CHANGE", 1_000_000), event(3, "U1", "CAPITAL_CHANGE", 9_000_000)], schema)
    two = spark.createDataFrame([event(4, "U2", "GST_CANCELLED", 0), event(5, "U0", "GST_CANCELLED", 0)], schema)
    state = lambda: {n: sorted(map(repr, m.table(n).collect())) for n in ("scores", "events", "contagion", "composites", "alerts")}
    m.run(one, 0)
    m.run(two, 1)
    before = state()
    m.run(one, 0)
    m.run(two, 1)
    assert state() == before
    assert len(before["alerts"]) == 5 and len(before["events"]) == 5
    fired = [(r.cin, r.rule, r.batch) for r in m.table("composites").collect()]
    assert sorted(fired) == [("U0", "ZOMBIE_COMPANY", 0), ("U2", "ZOMBIE_COMPANY", 1)]
    assert m.scores().count() == 4
