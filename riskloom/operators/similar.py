"""Similarity join of sets of trigrams: Spark deals the prefixes by trigram, numpy compares the parts in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams are made of a space, a-z and 0-9, so a number tells each of them apart and a table of all of them has a fixed size.
LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"
ALL = len(LETTERS) ** 3
_VALUE = np.zeros(128, np.int64)
_VALUE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
#: Rows of a trigram that meet at once, of either side; more are dealt into parts. Pairs that are listed at once, pairs whose bits
#: are compared at once (so many stay in a core's cache), and pairs whose sets are.
PART, PAIRS, TILE, SETS = 1 << 15, 1 << 20, 1 << 16, 1 << 14
#: Fills up the rows of sets; no trigram has this rank.
NONE = 65535
#: Pairs of one key from which on they are compared as a block.
LARGE = 1 << 16


def _codes(grams: pa.Array) -> np.ndarray:
    text = np.frombuffer("".join(grams.to_pylist()).encode("ascii"), np.uint8).reshape(-1, 3)
    return _VALUE[text] @ np.array([len(LETTERS) ** 2, len(LETTERS), 1])


def _prefixes(rank: np.ndarray, parts: np.ndarray, others: np.ndarray, above: float, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (h, id, same..., grams) to one row for each of a name's rarest trigrams: also g (rank of the trigram), part, n (size
    of the set), r (place of the trigram in it) and ranks (the whole set by rarity). parts, others: into how many parts the
    rows of a trigram are dealt on this side and on the other one, where 0 is none at all; a row meets every part of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("grams").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ranks, row = rank[_codes(batch.column("grams").flatten())], np.repeat(np.arange(len(n)), n)
            ranks, start = ranks[np.lexsort((ranks, row))], np.cumsum(n) - n
            place = np.arange(len(row)) - start[row]
            at = np.nonzero((place <= (n - np.floor(above * n))[row]) & (others[ranks] > 0))[0]
            at = np.repeat(at, others[ranks[at]])  # neighbours, one for each part of the other side
            other = np.arange(len(at)) - np.searchsorted(at, at)
            own = (batch.column("h").to_numpy()[row[at]] % parts[ranks[at]].astype(np.int64)) if len(at) else other
            part = own << 31 | other if first else other << 31 | own
            data, names = ranks.astype("<u2").tobytes(), pa.array(row[at])
            sets = pa.array([data[2 * a : 2 * (a + k)] for a, k in zip(start, n, strict=True)], pa.binary()).take(names)
            kept = {c: batch.column(c).take(names) for c in batch.schema.names if c not in ("h", "grams")}
            kept |= {"g": pa.array(ranks[at].astype(np.int32)), "part": pa.array(part), "n": pa.array(n[row[at]].astype(np.int32)), "r": pa.array((place[at] + 1).astype(np.int32)), "ranks": sets}
            yield pa.RecordBatch.from_pydict(kept)

    return run


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, places, sets as rows of a matrix, and the parity of each set's members over 128 and over 512 bits."""
    n, r = table.column("n").to_numpy().astype(np.int64), table.column("r").to_numpy().astype(np.int64)
    members = np.frombuffer(b"".join(table.column("ranks").to_pylist()), "<u2")
    sets = np.full((len(n), int(n.max(initial=1))), NONE, np.uint16)
    sets[np.arange(sets.shape[1]) < n[:, None]] = members
    bit = (members.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)
    wide = np.zeros(len(n) * 8, np.uint64)
    np.bitwise_xor.at(wide, np.repeat(np.arange(0, len(wide), 8), n) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return n, r, sets, np.bitwise_xor.reduce(wide.reshape(-1, 4, 2), 1).T.copy(), wide.reshape(-1, 8)


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many members the sets of each row share, and the rarest of those."""
    both = np.sort(np.concatenate([a, b], 1), 1)  # what both have stands side by side
    mark = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
    return mark.sum(1), both[np.arange(len(both)), mark.argmax(1)]


def _similar(above: float, schema: pa.Schema, keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of a bucket, each at the first trigram that both have, so that none comes twice. Pairs are ruled out by the sizes
    and places, then by 128 and by 512 bits (sets differ at least as much as their bits do); the rest is counted exactly."""
    large_from = LARGE
    share, apart = above / (1 + above) - 1e-9, (1 - above) / (1 + above) + 1e-9

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        (n, r, a, x, wide), (m, s, b, y, other_wide) = _side(left), _side(right)
        at_left = left.column("g").to_numpy()
        # the same number for equal keys of both sides
        both = pa.concat_tables([left.select(keys), right.select(keys)])
        number = np.zeros(len(both), np.int64)
        for k in keys:
            code = both.column(k).combine_chunks().dictionary_encode()
            number = np.unique(number * (len(code.dictionary) + 1) + code.indices.to_numpy(), return_inverse=True)[1]
        p, q = np.argsort(number[: len(left)], kind="stable"), np.argsort(number[len(left) :], kind="stable")
        mine, yours = number[: len(left)][p], number[len(left) :][q]
        low, high = np.searchsorted(yours, mine), np.searchsorted(yours, mine, "right")
        found = []

        def check(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), SETS):
                u, v = i[at : at + SETS], j[at : at + SETS]
                bits = np.bitwise_count(wide.take(u, 0) ^ other_wide.take(v, 0)).view(np.uint64)[:, 0]
                bits = bits * np.uint64(0x0101010101010101) >> np.uint64(56)  # all eight counts; above 255 it is less, which lets a pair through
                ok = bits <= apart * (n.take(u) + m.take(v))
                u, v = u[ok], v[ok]
                if not len(u):
                    continue
                shared, rarest = _shared(a[u], b[v])
                sim = shared / (n[u] + m[v] - shared)
                ok = (sim > above) & (rarest == at_left[u])
                found.append((u[ok], v[ok], sim[ok]))

        def near(i: np.ndarray, j: np.ndarray) -> None:
            """Pairs of rows, one by one."""
            total = n[i] + m[j]
            ok = np.minimum(n[i] - r[i], m[j] - s[j]) + 1 >= share * total
            i, j, total = i[ok], j[ok], total[ok]
            ok = np.bitwise_count(x[0][i] ^ y[0][j]) + np.bitwise_count(x[1][i] ^ y[1][j]) <= apart * total
            check(i[ok], j[ok])

        def block(i: np.ndarray, j: np.ndarray) -> None:
            """All pairs of rows of one key: each size and place of the first side with the rows of the other that may fit."""
            (kind, which), (theirs, yours) = (np.unique(size[rows] << 16 | place[rows], return_inverse=True) for size, place, rows in ((n, r, i), (m, s, j)))
            j, rows = j[np.argsort(yours, kind="stable")], np.bincount(yours)
            sizes, places = theirs >> 16, theirs & 65535
            for c, code in enumerate(kind):
                size, place, mine = int(code) >> 16, int(code) & 65535, i[which == c]
                total = size + sizes
                fit = np.minimum(size - place, sizes - places) + 1 >= share * total
                if not fit.any():
                    continue
                other, most = j[np.repeat(fit, rows)], np.repeat(np.floor(apart * total[fit]).clip(0, 255).astype(np.uint8), rows[fit])
                step, u, v = max(1, TILE // len(other)), [], []
                low_bits, high_bits = y[0][other], y[1][other]
                for at in range(0, len(mine), step):
                    part = mine[at : at + step, None]
                    bits = np.bitwise_count(x[0][part] ^ low_bits)
                    bits += np.bitwise_count(x[1][part] ^ high_bits)
                    hit = np.flatnonzero(bits <= most)
                    u.append(mine[at + hit // len(other)])
                    v.append(other[hit % len(other)])
                check(np.concatenate(u), np.concatenate(v))

        _, starts, sizes = np.unique(mine, return_index=True, return_counts=True)
        large = sizes * (high - low)[starts] > large_from
        for at, k in zip(starts[large], sizes[large], strict=True):
            block(p[at : at + k], q[low[at] : high[at]])
        few = ~np.repeat(large, sizes)
        p, low, width = p[few], low[few], (high - low)[few]
        ends, at = np.cumsum(width), 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            w = width[at:to]
            i = np.repeat(np.arange(at, to), w)
            near(p[i], q[low[i] + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)])
            at = to
        u, v, sim = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_arrays([left.column(schema.names[0]).take(pa.array(u)), right.column(schema.names[1]).take(pa.array(v)), pa.array(sim)], schema=schema)

    return run


def similar_sets(left: DataFrame, right: DataFrame, above: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows (key, *same, grams) of two tables, by the names of their first columns, whose sets of trigrams are more
    similar than the limit (sim): shared as a part of all. Rows without a key, a set or a value of `same` meet nothing.

    The table of trigrams, which has a fixed size, is counted and sent to all tasks; nothing else is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lk, rk = left.columns[0], right.columns[0]
    left, right = (df.filter(F.size("grams") > 0).dropna(subset=[df.columns[0], *same]) for df in (left, right))
    each = left.select(F.explode("grams").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(F.explode("grams").alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    table = each.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("b", "t").collect()
    rank, parts = np.zeros(ALL, np.int64), [np.array([-(-row[side] // PART) for row in table], np.int64) for side in ("a", "b")]
    rank[_codes(pa.array([row.t for row in table], pa.string()))] = np.arange(len(table))
    buckets = 1 + sum(row.a + row.b for row in table) // 100_000

    def dealt(df: DataFrame, own: int) -> DataFrame:
        rows = df.select(F.pmod(F.xxhash64(df.columns[0]), F.lit(1 << 31)).alias("h"), df.columns[0], *same, "grams")
        kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c not in ("h", "grams"))
        out = rows.mapInArrow(_prefixes(rank, parts[own], parts[1 - own], above, own == 0), f"{kinds}, g int, part long, n int, r int, ranks binary")
        return out.withColumn("bucket", F.pmod(F.xxhash64("g", "part", *same), F.lit(buckets)))

    out = left.select(lk).schema.add(right.schema[rk]).add("sim", "double")
    return dealt(left, 0).groupBy("bucket").cogroup(dealt(right, 1).groupBy("bucket")).applyInArrow(_similar(above, to_arrow_schema(out), ["g", "part", *same]), out)
