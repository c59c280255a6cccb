"""Structured Streaming forms (survey 2.N). The stateless cores are those of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.functions import fixed
from riskloom.sources.shared import kept

DAY_US = 86_400_000_000


def deduplicated(stream: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Records of a stream once per key, as long as repeats come within the delay. What must last longer is checked per
    micro-batch against the table (see append_unseen)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def rolling_counts(stream: DataFrame, keys: list[str], ts: str = "ts", length: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events in sliding windows, by some keys."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, length, step), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


class _Expiring(StatefulProcessor):
    """A value per key that goes when the watermark has passed its last time by `span` microseconds."""

    span: int

    def _kept_for(self, handle: StatefulProcessorHandle, schema: str) -> None:
        self.handle, self.last = handle, handle.getValueState("last", f"at long, {schema}")

    def _set(self, was: tuple | None, now: tuple) -> None:
        self.last.update(now)
        if was is None:  # else a timer is pending, which looks at the value when it comes
            self.handle.registerTimer((now[0] + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            due = (self.last.get()[0] + self.span) // 1000 + 1
            if due <= timerValues.getCurrentWatermarkInMs():
                self.last.clear()
            else:
                self.handle.registerTimer(due)
        yield from ()

    def close(self) -> None:
        pass


class StatusChange(_Expiring):
    """Keeps each key's last status, for `days` of silence at most, and tells what follows what."""

    def __init__(self, days: int = 400):
        self.span = days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept_for(handle, "id long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = first = tuple(self.last.get()) if self.last.exists() else None
        for at, i, status in sorted((r.at, r.id, r.status) for r in rows if r.at is not None and r.status is not None):
            if was is not None and (at, i) < was[:2]:
                continue
            if was is not None and status != was[2]:
                yield Row(key=key[0], at=at, id=i, was=was[2], status=status)
            was = (at, i, status)
        if was != first:
            self._set(first, was)


def status_changes(stream: DataFrame, days: int = 400, delay: str = "1 hour") -> DataFrame:
    """Changes of status per key from a stream of (key, ts, id, status): key, ts, id, was, status.

    Within a micro-batch pulls are taken by time and id. A pull that is older than the last one of its key, or than the
    watermark, is out of order: it changes nothing and gives no change. Pulls without a time or a status are left out.
    A key that is silent for `days` is forgotten, by event time.
    """
    rows = stream.withWatermark("ts", delay).select("key", "ts", F.unix_micros("ts").alias("at"), "id", "status")
    kind = dict(stream.dtypes)["key"]
    out = rows.groupBy("key").transformWithState(StatusChange(days), f"key {kind}, at long, id long, was string, status string", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("at").alias("ts"), "id", "was", "status")


#: Groups that the keys of a cool-down are dealt into; a checkpoint holds only for the number that it began with.
BUCKETS = 4096


class CoolDown(StatefulProcessor):
    """Lets a key's event through if none has passed for `span` microseconds. The state of a bucket of keys is one list with the
    last event of each key that did, which is read and written in one call: the calls to the state store are as many as there
    are buckets, not keys. What can suppress nothing any more goes when the watermark has passed it."""

    def __init__(self, keys: tuple[str, ...], span: int, kinds: str):
        self.keys, self.span, self.kinds = keys, span, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getListState("last", f"{self.kinds}, at long, id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[tuple, list[tuple]] = {}
        for r in rows:
            if r.at is not None:
                found.setdefault(tuple(r[k] for k in self.keys), []).append((r.at, r.id))
        if not found:
            return
        fired = {tuple(x[:-2]): tuple(x[-2:]) for x in self.last.get()}
        fresh, changed = not fired, False
        for own, events in found.items():
            last = fired.get(own)
            for at, i in sorted(events):
                if last is None or at - last[0] >= self.span:
                    last = fired[own] = (at, i)
                    changed = True
                    yield Row(**dict(zip(self.keys, own, strict=True)), at=at, id=i)
        if changed:
            self.last.put([(*k, *v) for k, v in fired.items()])
        if fresh:  # else a timer is pending, which looks at the list when it comes
            self._wait(at for at, _ in fired.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), [tuple(x) for x in self.last.get()]
        rest = [x for x in held if self._due(x[-2]) > now]
        if not rest:
            self.last.clear()
        else:
            if len(rest) < len(held):
                self.last.put(rest)
            self._wait(x[-2] for x in rest)
        yield from ()

    def _due(self, at: int) -> int:
        return (at + self.span) // 1000 + 1

    def _wait(self, times: Iterator[int]) -> None:
        self.handle.registerTimer(self._due(min(times)))

    def close(self) -> None:
        pass


def cooled(stream: DataFrame, keys: tuple[str, ...] = ("cin", "event_type"), hours: int = 24 * 30, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Events (keys, ts, id) that fire under a cool-down of `hours`: the first of a key, and each at least so long after the
    last one that fired. Within a micro-batch they are taken by time and id; an event before the last one that fired is
    out of order and stays silent. The state goes by event time, once it can suppress nothing any more. Keys are texts, whole
    numbers or days; they are dealt into `buckets`, which share their state and are processed at once."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("__bucket")
    rows = stream.withWatermark("ts", delay).select(bucket, *keys, "ts", F.unix_micros("ts").alias("at"), "id")
    listed = dict(stream.dtypes)
    kinds = ", ".join(f"{k} {listed[k]}" for k in keys)
    out = rows.groupBy("__bucket").transformWithState(CoolDown(tuple(keys), hours * 3_600_000_000, kinds), f"{kinds}, at long, id long", "Append", "EventTime")
    return out.select(*keys, F.timestamp_micros("at").alias("ts"), "id")


#: Alerts that one text of the held ones has at most.
PIECE = 10_000


class HeldAlerts(StatefulProcessor):
    """Holds alerts of a watchlist and company until their own severity's delay has passed, by processing-time timers. Of a
    micro-batch the state keeps, for each due time, the alerts of all of a bucket's `keys` as one text of JSON, or several of PIECE
    alerts each: the state store is called for texts, not for alerts. Without keys a bucket is one watchlist and company."""

    def __init__(self, hour_ms: int = 3_600_000, keys: tuple[str, ...] = ()):
        self.keys, self.waits = keys, {s: int(h * hour_ms) for s, h in fixed.BATCH_HOURS.items()}
        self.longest = int(168 * hour_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "due long, alerts string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, n = timerValues.getCurrentProcessingTimeInMs(), len(self.keys)
        pick = itemgetter(*self.keys, "at", "alert_id", "severity", "score_before", "score_after")
        urgent: dict[tuple, list[tuple]] = {}
        waiting: dict[int, dict[tuple, list[tuple]]] = {}
        size: dict[int, int] = {}
        for r in rows:
            values = pick(r)
            own, alert = values[:n] or tuple(key), values[n:]
            wait = self.waits.get(alert[2], self.longest)
            if wait == 0:
                urgent.setdefault(own, []).append(alert)
                continue
            waiting.setdefault(wait, {}).setdefault(own, []).append(alert)
            size[wait] = size.get(wait, 0) + 1
            if size[wait] % PIECE == 0:
                self._hold(now + wait, waiting.pop(wait))
        for wait, groups in waiting.items():
            self._hold(now + wait, groups)
        for wait in size:
            self.handle.registerTimer(now + wait)
        yield from self._digests(urgent)

    def _hold(self, due: int, groups: dict[tuple, list[tuple]]) -> None:
        self.held.appendValue((due, json.dumps(list(groups.items()), separators=(",", ":"))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), [tuple(x) for x in self.held.get()]
        rest = [x for x in held if x[0] > now]
        if len(rest) < len(held):
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
            groups: dict[tuple, list[tuple]] = {}
            for due, text in held:
                if due <= now:
                    for own, alerts in json.loads(text):
                        groups.setdefault(tuple(own), []).extend(alerts)
            yield from self._digests(groups)

    @staticmethod
    def _digests(groups: dict[tuple, list[tuple]]) -> Iterator[Row]:
        for own, alerts in groups.items():
            alerts = sorted(alerts, key=itemgetter(0, 1))
            worst = max(reversed(alerts), key=lambda a: fixed.SEVERITY_RANK.get(a[2], 0))  # the last one of the highest rank
            yield Row(watchlist_id=own[0], cin=own[1], n_events=len(alerts), max_severity=worst[2], score_before=alerts[0][3], score_after=alerts[-1][4], alert_ids=[a[1] for a in alerts])

    def close(self) -> None:
        pass


class HeldInBlocks(HeldAlerts):
    """The same with alerts as texts of JSON (alert) in blocks: Spark takes some 20 microseconds to hand over a row by itself."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = (alert for block in rows for alert in json.loads(f"[{','.join(block['alert'])}]"))
        yield from self._block(super().handleInputRows(key, alerts, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._block(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    @staticmethod
    def _block(digests: Iterator[Row]) -> Iterator[pd.DataFrame]:
        found = list(digests)
        if found:
            yield pd.DataFrame([tuple(r) for r in found], columns=found[0].__fields__, dtype=object)


DIGEST = "watchlist_id int, cin string, n_events long, max_severity string, score_before long, score_after long, alert_ids array<long>"


def held_digests(stream: DataFrame, hour_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """Digests from a stream of alerts (watchlist_id, cin, alert_id, severity, detected_at, score_before, score_after).

    An alert waits for its severity's hours from its micro-batch on, critical ones not at all; what falls due together for a
    watchlist and company is one digest. The alerts and their timers are state: a restart from the checkpoint keeps them.
    Watchlists and companies are dealt into `buckets`, which share their state and timers. hour_ms: length of an hour, for replays.
    """
    cast = [F.col(c).cast(k).alias(c) for c, k in (("watchlist_id", "int"), ("cin", "string"), ("alert_id", "long"), ("severity", "string"), ("score_before", "long"), ("score_after", "long"))]
    rows = stream.select(*cast, F.coalesce(F.unix_micros("detected_at"), F.lit(0)).alias("at"))
    own = ("watchlist_id", "cin")
    bucket = F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int").alias("__bucket")
    texts = rows.select(bucket, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("alert"))
    return texts.groupBy("__bucket").transformWithStateInPandas(HeldInBlocks(hour_ms, own), DIGEST, "Append", "ProcessingTime")


# ---- keys that last --------------------------------------------------------------------------


def _stored(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What earlier batches have written to a table with a folder for each batch."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).filter(F.col("batch") < batch)


def append_unseen(path: str, key: list[str], buckets: int = 16, bits: int = 1 << 23, probes: int = 4) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows of a micro-batch whose key no earlier batch has brought, so that a key counts once
    however late it comes again. Rows are in path/rows, a folder for each batch.

    The keys lie in buckets by their hash, and each bucket has a Bloom filter of `bits` bits, as words that every batch adds
    to. A batch reads the filters' words in the buckets of its own keys; only keys that a filter may hold are compared,
    and only with the buckets that they fall into. New keys alone read no key at all. A batch that is run again with the
    same number writes the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, kinds = batch.sparkSession, dict(batch.dtypes)
        columns = ", ".join(f"`{k}` {kinds[k]}" for k in key)
        h = F.xxhash64(*key)
        one = kept(batch.dropDuplicates(key).withColumn("__h", h).withColumn("bucket", F.pmod("__h", F.lit(buckets)).cast("int")))
        bit = lambda i: F.pmod(F.xxhash64("__h", F.lit(i)), F.lit(bits))
        each = one.select("__h", "bucket", F.explode(F.array(*[bit(i) for i in range(probes)])).alias("bit"))
        each = each.select("__h", "bucket", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
        mine = [r.bucket for r in one.select("bucket").distinct().collect()]  # as many as there are buckets at most
        words = _stored(spark, f"{path}/filters", "word int, mask long, bucket int", number).filter(F.col("bucket").isin(mine))
        words = words.groupBy("bucket", "word").agg(F.bit_or("mask").alias("held"))
        hit = each.join(words, ["bucket", "word"], "left").groupBy("__h", "bucket").agg(F.bool_and((F.coalesce("held", F.lit(0)).bitwiseAND(F.col("mask"))) != 0).alias("maybe"))
        maybe = kept(hit.filter("maybe").select("__h", "bucket"))
        wanted = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        old = seen_keys(spark, path, columns, number, wanted)
        same = F.lit(True)
        for k in key:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        again = one.alias("n").join(maybe.select(F.col("__h").alias("__m")), F.col("__h") == F.col("__m"), "left_semi").join(old.alias("o"), (F.col("n.__h") == F.col("o.__h")) & same, "left_semi").select("__h", *key)
        again = again.select(*[F.col(c).alias(f"__x{i}") for i, c in enumerate(["__h", *key])])
        gone = F.col("__h") == F.col("__x0")
        for i, k in enumerate(key):
            gone = gone & F.col(k).eqNullSafe(F.col(f"__x{i + 1}"))
        new = kept(one.join(again, gone, "left_anti"))
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        new.select(*key, "__h", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={number}")
        fresh = each.join(new.select("__h"), "__h", "left_semi").groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/filters/batch={number}")

    return run


def seen_keys(spark: SparkSession, path: str, columns: str, batch: int, buckets: list[int]) -> DataFrame:
    """The keys of earlier batches in some buckets; no other file is read."""
    return _stored(spark, f"{path}/keys", f"{columns}, `__h` long, bucket int", batch).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
