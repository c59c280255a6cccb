"""Findings of the third round, each on a small input that shows it."""

from collections import Counter
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.operators import detect, resolve, route, similar
from riskloom.streaming import replay, streams

DAY = datetime(2024, 1, 10)


def _at(seconds: float) -> datetime:
    return DAY + timedelta(seconds=seconds)


def test_intervals_count_fractions_of_a_second(spark):
    """7,200.9 seconds are more than two hours, and 3,600.8 more than one."""
    p = spark.createDataFrame([("A", "ALERT", _at(0.0), True)], "cin string, severity string, fired_at timestamp, false_positive boolean").selectExpr("*", "false as confirmed", "1L as prediction_id")
    rows = [("A", "ALERT", "s1", _at(x)) for x in (1.0, 2.0, 3.0, 4.0, 7200.0, 7200.9, -7200.9)]
    e = spark.createDataFrame(rows, "cin string, severity string, source string, detected_at timestamp")
    assert [r.samples for r in route.recalibrate(p, e, F.lit(DAY)).collect()] == [5]
    f = spark.createDataFrame([("A", _at(x), "confirmed") for x in (3600.0, 3600.8)], "cin string, delivered_at timestamp, verdict string")
    assert route.apply_feedback(f, p).count() == 1


NAMES = [(k, "ab"[k % 2], f"{['apex', 'bharat', 'crystal'][k % 3]} {['steel', 'chemical works'][k // 3 % 2]} {k}") for k in range(300, 360)]


def _pairs(above, state=False):
    sets = [({f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)}, k, s) for k, s, name in NAMES]
    return {(k, f"U{j}"): len(x & y) / len(x | y) for x, k, s in sets for y, j, r in sets if len(x & y) / len(x | y) > above and (s == r or not state)}


def test_similar_names_in_parts(spark, monkeypatch):
    """Trigrams whose rows are dealt into parts, large and small blocks, with and without an equal column; nothing exploded is sent."""
    q = spark.createDataFrame(NAMES, "qid int, state string, name string")
    m = q.select(F.concat(F.lit("U"), "qid").alias("cin"), "state", "name")
    got = lambda *a: {(r.qid, r.cin): r.sim for r in resolve.similar_names(q, m, *a).collect()}
    assert got(0.45) == _pairs(0.45)
    monkeypatch.setattr(similar, "PART", 7)
    monkeypatch.setattr(similar, "LARGE", 9)
    assert got(0.45) == _pairs(0.45)
    assert got(0.6, ("state",)) == _pairs(0.6, state=True)
    assert "Broadcast" not in resolve.similar_names(q, m, 0.45)._jdf.queryExecution().toString()


def test_transitions_of_all_sources_in_one_window(spark):
    """One window and one shuffle for seven sources."""
    p = spark.createDataFrame([(1, _at(i), s) for i, s in enumerate(("active", "cancelled", "active"))], "key int, pull_ts timestamp, status string")
    got = detect.all_transitions(p, list(fixed.TRANSITIONS), ["key"])
    assert ("gst", "GST_RESTORED") in {(r.source, r.event_type) for r in got.collect()} and got.count() == 9
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_sources_are_repeated_after_the_window(spark):
    """Records of several sources, of one, stored ones and repeated ones."""
    r = spark.createDataFrame([(1, "A", "R1", ["nclt", "ibbi"], "x"), (2, "A", "R1", ["nclt"], "x"), (3, "A", "R2", ["ibbi", "other"], "x"), (4, "A", None, ["nclt"], "x")], "id int, cin string, record_id string, sources array<string>, text string")
    names = [s for s in fixed.SOURCE_RULES if s != "sarfaesi"][:2]
    r = r.withColumn("sources", F.transform("sources", lambda s: F.when(s == "nclt", names[0]).when(s == "ibbi", names[1]).otherwise(s)))
    seen = spark.createDataFrame([("A", "R1", [names[1]])], "cin string, record_id string, sources array<string>")
    want = {("A", names[0], "R1"), ("A", names[1], "R2")}
    got = lambda a, b: sorted((x.cin, x.source, x.record_id) for x in detect.detect_sources(a, b, names, "id").collect())
    one = lambda df: df.withColumn("source", F.explode("sources")).drop("sources")
    assert got(r, seen) == got(one(r), one(seen)) == sorted(want)


def test_resolution_broadcasts_nothing(spark, monkeypatch):
    """No side of a cascade, or of the pairs that are judged by Jaro-Winkler, is sent to the driver, however small its estimate."""
    q = spark.createDataFrame([(1, "Apex Steel 1 Pvt Ltd", "a", "x", None, None), (2, "Apex Steal 2 Ltd", "a", "x", None, None)], "qid int, raw_name string, state string, industry string, cin string, pan string").limit(9)
    m = spark.createDataFrame([(f"U{k}", f"Apex Steel {k}", "a", "xy"[k % 2], None) for k in range(3)], "cin string, company_name string, registered_state string, industrial_class string, pan string").limit(9)
    a = m.select(F.concat(F.lit("alias "), "cin").alias("normalized_alias"), "cin")
    assert {(r.qid, r.cin, r.method) for r in resolve.resolve_strict(q, m).collect()} == {(1, "U1", "normalized_exact"), (2, "U2", "jaro_winkler")}
    monkeypatch.setattr(resolve, "kept", lambda df: df)
    names, near = m.select("cin", F.col("company_name").alias("name")), q.select("qid", F.concat(F.lit("U"), "qid").alias("cin"), F.lit(0.9).alias("sim"))
    for df in (resolve.resolve_strict(q, m), resolve.resolve_light(q.select("qid", "raw_name"), m, a), resolve.judged(near, q.withColumnRenamed("raw_name", "name"), names)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


class _Store:
    """A list state and its handle, which count their calls."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], Counter(), []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        self.calls["get"] += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls["put"] += 1
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def test_cool_down_calls_the_state_for_a_bucket(spark):
    """Calls are as many as there are buckets and batches, not keys; what has passed goes at the timer, the rest waits on."""
    hour, store = 3_600_000_000, _Store()
    cool = streams.CoolDown(("cin",), 48 * hour, "cin string")
    cool.init(store)
    batch = lambda *hours: [Row(cin=f"U{k}", at=h * hour + k, id=h) for h in hours for k in range(200)]
    fired = [[r.id for r in cool.handleInputRows((1,), iter(batch(*hours)), None) if r.cin == "U7"] for hours in ((30, 0, 47), (48, 60), (95, 96))]
    assert fired == [[0], [48], [96]] and store.calls == {"get": 3, "put": 3} and store.timers == [48 * hour // 1000 + 1]
    store.rows = [("A", 0, 1), ("B", 10 * hour, 2)]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 50 * 3_600_000)
    assert list(cool.handleExpiredTimer((1,), clock, None)) == [] and store.rows == [("B", 10 * hour, 2)] and store.timers[-1] == 58 * 3_600_000 + 1
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 58 * 3_600_000 + 1)
    assert list(cool.handleExpiredTimer((1,), clock, None)) == [] and store.rows == []


def test_cool_down_keys_share_a_bucket(spark):
    """One bucket for all keys, null keys too, gives what many give; the state goes and comes between micro-batches."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    replay.with_state(spark)
    rows = [[(c, t, _at(h * 3600.0), h) for c in ("A", "B", None) for t in ("x", "y")] for h in (0, 47, 48, 95, 200)]
    path = replay.shared(spark)
    for part in rows:
        spark.createDataFrame(part, "cin string, event_type string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(path)
    got = []
    for buckets in (1, 64):
        stream = replay.part_stream(spark, path, spark.read.parquet(path).schema)
        out = replay.drained(streams.cooled(stream, hours=48, buckets=buckets), seconds=100)
        got.append(sorted((str(r.cin), r.event_type, r.id) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] == sorted((str(c), t, h) for c in ("A", "B", None) for t in ("x", "y") for h in (0, 48, 200))


def test_defaulters_of_a_name_are_dealt_to_all_tasks(spark):
    """However small the input, the rows of different names come from several tasks and no side is broadcast; no row is lost."""
    rows = spark.createDataFrame([(f"X{k}", f"NAME {k % 20}") for k in range(60)] + [("Y", None)], "borrower string, director_name string")
    boards = spark.createDataFrame([(f"Name {k % 20}", f"U{k}") for k in range(80)], "director_name string, cin string")
    got = detect.defaulter_rows(rows, rows.limit(0), boards.limit(0).select(F.col("director_name").alias("company_name"), "cin"), boards).filter("event_type = 'WILFUL_DEFAULT_DIRECTOR'")
    assert {(r.borrower, r.cin) for r in got.collect()} == {(f"X{k}", f"U{j}") for k in range(60) for j in range(80) if k % 20 == j % 20} and got.count() == 240
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
