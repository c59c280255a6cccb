"""Operator 11: periodic runs of words by the branching-tandem test on an enhanced suffix array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, distinct_ranges, flat, gathered, is_space, pieces, ranges, table, with_columns

#: A run repeats its period this often at least, and has so many words at least.
EXPONENT, SHORTEST = 4, 6
#: Rounds of hopping to nearest smaller values before the plain pass takes over.
HOPS = 64

RUN = "start: bigint, length: bigint, period: bigint"


def doubled_ranks(ids: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ids by prefix doubling, and the ranks after each round: two places have the same rank in levels[k] if
    and only if 2**k ids from them on are the same. Ids found fewer than `least` times count as different from all."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    by = ids[sa]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    slot, alone = np.arange(n), np.repeat(size < max(least, 2), size)
    rank = np.empty(n, np.int64)
    rank[sa] = np.where(alone, slot, np.repeat(first, size))
    levels, open_, step = [rank.astype(np.int32)], slot[~alone], 1
    while len(open_):
        at = sa[open_]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        key = rank[at] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate([head, [len(key)]]))
        rank[at] = np.repeat(open_[head], count)
        levels.append(rank.astype(np.int32))
        open_ = open_[np.repeat(count > 1, count)]
        step *= 2
    return sa, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many ids are the same from a and b on, or before them, by the levels from the longest down."""
    n, got = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - got - (1 << k), b - got - (1 << k)) if back else (a + got, b + got)
        inside = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        got += (inside & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return got


def _nearest(value: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one in the direction of step with a value not above its own; places with value 0 stay."""
    n = len(value)
    to = np.where(value > 0, np.arange(n) + step, np.arange(n))
    open_ = np.flatnonzero(value > 0)
    for _ in range(HOPS):
        open_ = open_[value[to[open_]] > value[open_]]
        if not len(open_):
            return to
        to[open_] = to[to[open_]]
    held, values = [0 if step > 0 else n - 1], value.tolist()
    for i in range(n) if step < 0 else range(n - 1, -1, -1):
        v = values[i]
        if v == 0:
            held = [i]
        else:
            while values[held[-1]] > v:
                held.pop()
            to[i] = held[-1]
            held.append(i)
    return to


def find_runs(ids: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of a sequence of ids, by start and period.

    The longest common prefixes of neighbours in the suffix array form intervals; an interval of depth d holds the suffixes
    that share d ids. A square of period d which the next id breaks has its two halves in different children of such an
    interval, so it is found from the suffixes of all but the largest child: i + d or i - d is in the interval too (by
    its place in the suffix array). That makes O(n log n) tests. Each square is then rotated to the left as far as it
    holds, which gives the whole run; runs found with multiples of their period are merged into the one of the smallest.
    """
    nothing = np.zeros(0, np.int64)
    n = len(ids)
    if n < shortest:
        return nothing, nothing, nothing
    sa, levels = doubled_ranks(ids, exponent)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    if not len(near):
        return nothing, nothing, nothing
    lcp[near] = _common(levels, sa[near - 1], sa[near], False)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before, after = _nearest(lcp, -1), _nearest(lcp, 1)
    # an interval is known by the first of the boundaries between its children, and ends at the first smaller value
    head, last, inner = np.where(lcp[before] < lcp, np.arange(n + 1), before), after.copy(), lcp > 0
    while not np.array_equal(head[head], head):
        head = head[head]
    while (same := inner & (lcp[last] == lcp)).any():
        last = np.where(same, last[last], last)
    first = near[head[near] == near]
    # children: from each boundary to the next one, and what stands before the first boundary
    begin, size, of = np.concatenate([near, before[first]]), np.concatenate([after[near] - near, first - before[first]]), np.concatenate([head[near], first])
    order = np.lexsort((size, of))
    largest = np.concatenate([of[order][1:] != of[order][:-1], [True]])
    small = order[~largest]
    begin, size, of = begin[small], size[small], of[small]
    at = sa[gathered(np.arange(n), begin, size)]
    depth, low, high = (np.repeat(x, size) for x in (lcp[of], before[of], last[of]))
    squares = []
    for other, square in ((at + depth, at), (at - depth, at - depth)):
        ok = (other >= 0) & (other < n)
        found = np.where(ok, place[np.where(ok, other, 0)], -1)
        ok &= (found >= low) & (found < high)
        squares.append(square[ok] * (n + 1) + depth[ok])
    start, period = np.divmod(np.unique(np.concatenate(squares)), n + 1)
    end = start + 2 * period
    inside = end < n
    broken = ~inside | (levels[0][np.where(inside, end, 0)] != levels[0][np.where(inside, end - period, 0)])
    start, period, end = start[broken], period[broken], end[broken]
    start = start - _common(levels, start, start + period, True)
    long = end - start >= np.maximum(shortest, exponent * period)
    start, period, length = start[long], period[long], (end - start)[long]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[once], period[once], length[once]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _judged(column, exponent: int, shortest: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text of an Arrow column."""
    data, at = flat(column)
    start, end, row = ranges(~is_space(data), at)
    code, kinds = distinct_ranges(data, start, end)
    # ids of different texts differ, so that all texts are judged in one suffix array and no run leaves its text
    s, length, period = find_runs(row * (kinds + 1) + code, exponent, shortest)
    words = np.searchsorted(row, np.arange(len(at)))
    owner = row[s] if len(s) else s
    runs = pa.StructArray.from_arrays([pa.array(s - words[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(at))), pa.int32()), runs)
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, s + period, 1)
    np.add.at(cover, s + length, -1)
    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    size = end[keep] - start[keep]
    # each kept word and a blank after it, but for the last of a text
    final = np.concatenate([row[keep][1:] != row[keep][:-1], [True]]) if len(keep) else np.zeros(0, bool)
    wide = size + ~final
    out = np.full(int(wide.sum()), 32, np.uint8)
    where = np.cumsum(wide) - wide
    out[gathered(np.arange(len(out)), where, size)] = gathered(data, start[keep], size)
    sums = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(row[keep], np.arange(len(at)))]
    return listed, pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(out))


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """Adds to docs (with text) the runs of words of each text, as start, length and period by start and period, and
    `collapsed`: the words that no run holds after its first period, joined by one blank.

    A run is a stretch of consecutive words with smallest period q, of max(shortest, exponent * q) words at least, that no
    neighbouring word extends; exponent is 2 or more. Texts are whole and of any length; a text is judged by one task, in
    memory of some hundred bytes a word. Null, empty and blank texts have no runs and collapse to nothing. Repeated rows give
    repeated results, an empty table an empty one. Columns named runs and collapsed are replaced.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")

    def run(batches):
        for batch in pieces(batches, "text"):
            yield with_columns(batch, (), zip(("runs", "collapsed"), _judged(batch.column("text"), exponent, shortest), strict=True))

    docs = docs.drop("runs", "collapsed")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"runs array<struct<{RUN}>>", "collapsed string"])
    return docs.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """The texts of the contract: every tenth document, by a checksum of its id, repeats its own words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    repeated = F.expr(f"""element_at(transform(array(named_struct('w', regexp_extract_all(text, r'{WORD}', 0), 'g', crc32(cast(doc_id as string)) div 10)),
        x -> if(size(x.w) = 0, '', element_at(transform(array(named_struct('a', cast(x.g % size(x.w) as int), 'p', cast(1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8) as int))),
        y -> array_join(transform(sequence(0, size(x.w) - 1), i -> x.w[if(i >= y.a, y.a + (i - y.a) % y.p, i)]), ' ')), 1))), 1)""")
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return out.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
