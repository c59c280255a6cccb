"""Shared helpers of the corpus operators: temporary tables, word patterns, batch slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of all contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
#: The same six characters, for trim() and translate().
WS_CHARS = " \t\n\u000b\u000c\r"

_temporary: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of this machine is
    made only if Spark runs in one process; on a cluster other executors could not read it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("riskloom.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-riskloom-")
        spark.conf.set("riskloom.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/riskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _temporary:
        atexit.register(release)
    _temporary.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the temporary tables that stored() has written."""
    while _temporary:
        spark, path = _temporary.pop()
        try:
            jvm = spark.sparkContext._jvm
            jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)
        except Exception:  # noqa: BLE001  the session has ended
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(df: DataFrame, order: list, **values: str) -> DataFrame:
    """Adds running totals in a global order: for each name, the sum of a column up to and with the row. Rows are dealt by
    ranges of the order and sorted within; the ranges' own totals, one row each, are summed and added. No window holds more
    than one range, so no task holds all rows."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    per = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in values.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = per.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__range")
    return out.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"__{n}")).alias(n) for n, c in values.items()])


def word_count(text):
    """Words of a text column; null counts as empty."""
    return F.expr(f"regexp_count(coalesce({text}, ''), r'{WORD}')").cast("long") if isinstance(text, str) else F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---- Arrow batches as flat bytes -------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, bytes of other characters unchanged."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _IS_WS[data]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about `most` bytes of `column`, texts or lists of 32-bit numbers (a longer row
    stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        size = np.diff(np.asarray(values.offsets)) * 4 if pa.types.is_list(values.type) else np.diff(flat(values)[1])
        total, begin = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def with_columns(batch: pa.RecordBatch, drop, more) -> pa.RecordBatch:
    """A batch without some columns and with more of them, as (name, array)."""
    kept, more = [n for n in batch.schema.names if n not in drop], list(more)
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(a for _, a in more)], names=[*kept, *(n for n, _ in more)])


def ranges(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True, cut at the offsets of texts: start, end and text of each."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[at] = True
    start = np.flatnonzero(mask & (cut[:-1] | ~np.concatenate([[False], mask[:-1]])))
    end = np.flatnonzero(mask & (cut[1:] | ~np.concatenate([mask[1:], [False]]))) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def distinct_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """The same number for the same bytes, for ranges in order that do not overlap, and how many numbers there are."""
    code, kinds = encoded(data, start, end)
    return code, len(kinds)


def encoded(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind=None) -> tuple[np.ndarray, pa.Array]:
    """Ranges in order that do not overlap as places in an array of all different ones, which also holds what is between."""
    kind = kind or pa.large_binary()
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], kind)
    bounds = np.stack([start, end], 1).astype(np.int64).ravel()
    each = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    both = each.dictionary_encode()
    return np.asarray(both.indices)[::2].astype(np.int64), both.dictionary


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of ranges (start, size), one after the other."""
    total = np.cumsum(size)
    return values[np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)]


# ---- hashes of byte ranges -------------------------------------------------------------------

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        back = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, back, np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, by prefix sums of a polynomial modulo 2**64. Fast, but ranges of many
    hundred bytes can be made to collide for every base; where equal hashes have to mean equal bytes, PrimeHash decides."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


#: A Mersenne prime, and the bases of two polynomials modulo it.
PRIME, PRIME_BASES = (1 << 31) - 1, (1580030173, 1271343253)
_STEP = 1 << 16


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    p, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> bits)
    x = (x & p) + (x >> bits)
    return x - (x >= p) * p


def _powers_of(base: int, n: int) -> np.ndarray:
    x = np.ones(1, np.uint64)
    while len(x) < n:
        x = np.concatenate([x, _reduced(x * np.uint64(pow(base, len(x), PRIME)))])
    return x[:n]


_steps = {b: (_powers_of(b, _STEP), _powers_of(pow(b, -1, PRIME), _STEP)) for b in PRIME_BASES}


class PrimeHash:
    """62-bit hashes of any byte ranges of one buffer, by prefix sums of two polynomials modulo a prime: of another kind than
    RangeHash, so that both together are 126 bits. Sums are made in steps, with small tables of powers."""

    def __init__(self, data: np.ndarray):
        self.sums, self.down = [], []
        for base, (up, _) in _steps.items():
            sums, carry, factor = np.zeros(len(data) + 1, np.uint32), np.uint64(0), 1
            for at in range(0, len(data), _STEP):
                part = data[at : at + _STEP].astype(np.uint64) + np.uint64(1)
                part = _reduced(np.cumsum(part * up[: len(part)]))
                part = _reduced(part * np.uint64(factor) + carry)
                sums[at + 1 : at + 1 + len(part)] = part
                carry, factor = part[-1], factor * pow(base, _STEP, PRIME) % PRIME
            self.sums.append(sums)
            self.down.append(_powers_of(pow(base, -_STEP, PRIME), len(data) // _STEP + 1))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high, out = start & (_STEP - 1), start >> 16, []
        for sums, down, (_, near) in zip(self.sums, self.down, _steps.values(), strict=True):
            shift = _reduced(near[low] * down[high])
            out.append(_reduced(_reduced(sums[end].astype(np.uint64) + np.uint64(PRIME) - sums[start].astype(np.uint64)) * shift))
        return mixed((out[0] << np.uint64(31) | out[1]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
