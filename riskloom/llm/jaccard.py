"""Operator 9: n-gram Jaccard join by universe partition and pigeonhole, and classes of near duplicates.

Two sets of sizes s and t with a Jaccard similarity of at least 0.8 differ in at most H = (s + t) / 9 elements. Elements
are dealt into segments by hash; a segment in which the sets differ by more than its threshold (0: equal contents, 1: one
deletion at most) uses up threshold + 1 of H. With a total weight W = sum(threshold + 1) above H, some segment agrees, so
the contents of segments (and, for threshold 1, all contents with one element deleted) are the signatures to join on.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import BASES, PrimeHash, RangeHash, flat, is_space, lowered, mixed, pieces, stored, table
from riskloom.llm.components import connected
from riskloom.llm.statistics import _bounds

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
ABOVE, OF = 80, 100
#: Buckets up to this size give all their pairs; in larger ones a segment may count as agreeing by chance.
SMALL = 16
#: Documents of a block when the members of large buckets are compared.
BLOCK = 256
#: Ids of candidate documents up to this number go to every task; more are joined by shuffle.
MOST_SENT = 1 << 19
#: Rows of a signature and task that go the way of all rows; further ones are known to be shared and are salted.
HOT = 32
#: Bytes of text that a Python task looks at together.
PIECE = 1 << 19


# ---- sets ------------------------------------------------------------------------------------


def shingle_sets(column, k: int = SHINGLE, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and two hashes (of different kinds, 126 bits) of each distinct k-word shingle, sorted by row and first hash. A
    text of fewer words, but not none, has one shingle. Without `both` the first hash alone tells shingles apart."""
    data, at = flat(column)
    rows = len(at) - 1
    space = is_space(data)
    # one blank for each run of white space; texts are kept apart by their offsets
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    keep = ~space | ~(np.concatenate([[True], space[:-1]]) | edge[:-1])
    low = lowered(data[keep])
    low[space[keep]] = 32
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    start, end = _bounds(low != 32, at)
    row = np.searchsorted(at, start, side="right") - 1
    words = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    last = np.arange(len(start)) + k - 1
    full = np.flatnonzero((last < len(start)) & (row == row[np.minimum(last, len(start) - 1)])) if len(start) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < k))
    owner = np.concatenate([row[full], short])
    begin, stop = np.concatenate([start[full], start[first[short]]]), np.concatenate([end[full + k - 1], end[first[short] + words[short] - 1]])
    h = RangeHash(low)(begin, stop)
    g = PrimeHash(low)(begin, stop) if both else h
    order = np.lexsort((h, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1])
    if (same & (g[order][1:] != g[order][:-1])).any():  # different shingles with equal first hashes
        order = np.lexsort((g, h, owner))
        same = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    new = np.concatenate([np.ones(min(1, len(h)), bool), ~same])
    return owner[order][new], h[order][new], g[order][new]


def _sizes(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owner, minlength=rows) if len(owner) else np.zeros(rows, np.int64)


def _set_names(owner: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set, for signatures: sets of equal names may differ, so ids() decides."""
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, owner, mixed(h ^ np.uint64(BASES[0])))
    return mixed(total + size.astype(np.uint64)).view(np.int64)


def _set_ids(owner: np.ndarray, h: np.ndarray, g: np.ndarray, rows: int) -> list[bytes]:
    """128-bit digest of each row's set, from both hashes of all its elements."""
    cut = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    both = np.stack([h, g], 1).tobytes()
    return [hashlib.blake2b(both[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _sketches(owner: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bitmaps: each element flips one of 2 to 4 bits per element of its set (a power of two, 64 at least). Bits in
    which two bitmaps differ are at most the elements in which the sets differ, so a larger number rules a pair out."""
    words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2 / 64)).astype(np.int64).clip(0))
    begin = np.concatenate([[0], np.cumsum(words)])
    spot = (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    bits = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(bits, begin[owner] + (spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
    raw = bits.tobytes()
    return [raw[a * 8 : b * 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _apart(x: bytes, y: bytes, sizes: int) -> bool:
    """Whether bitmaps (the larger folded to the smaller) differ in more bits than similar sets can differ in elements."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) > sizes // 9


# ---- signatures ------------------------------------------------------------------------------


@lru_cache
def levels(most: int = 1 << 24) -> tuple[tuple[int, int, int], ...]:
    """(largest H, segments of threshold 1, segments of threshold 0) of each size band. A band's weight is H + 1 and a
    quarter of H more. The allocation has the least cost: signatures of a set, and what segments without contents (or
    with one element, for threshold 1) cost because they agree by chance."""
    out, h = [], 1
    while h < most:
        weight, size, best = h + 1 + h // 4, 4.5 * h, None
        for a in sorted({round(weight / 2 * i / 8) for i in range(9)}):
            b = max(0, weight - 2 * a)
            g = size / (a + b)
            cost = b + a * (1 + g) + 20 * (b * np.exp(-g) + a * np.exp(-g) * (1 + g))
            if best is None or cost < best[0]:
                best = (cost, a, b)
        out.append((h, best[1], best[2]))
        h = max(h + 1, int(h * 1.5))
    return tuple(out)


def _level_of(total: np.ndarray) -> np.ndarray:
    """Band of pairs of sets with so many elements together; -1 where only equal sets are similar enough."""
    caps = np.array([x[0] for x in levels()])
    h = total // 9
    return np.where(h < 1, -1, np.searchsorted(caps, h))


def signatures(owner: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature (its last 6 bits: band) and spare weight for all sets. A set is in the bands of all sizes that its
    partners can have. Segments without contents are left out while their weight is to spare."""
    low, high = _level_of(size + (size * 4 + 4) // 5), _level_of(size + size * 5 // 4)
    rows_out, sig_out, spare_out = [], [], []
    for j in range(max(0, int(low.min(initial=0))), int(high.max(initial=-1)) + 1):
        inside = (low <= j) & (j <= high) & (size > 0)
        if not inside.any():
            continue
        cap, a, b = levels()[j]
        m, weight = a + b, 2 * a + b
        pick = inside[owner]
        o, t = owner[pick], h[pick]
        local = np.cumsum(inside) - 1
        n = int(inside.sum())
        seg = ((mixed(t + np.uint64(j + 1)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        key = local[o] * m + seg.astype(np.int64)
        value = mixed(t ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total = np.zeros(n * m, np.uint64)
        np.add.at(total, key, value)
        count = np.bincount(key, minlength=n * m)
        kind = np.tile(np.arange(m), n)
        bare = count <= np.where(kind < a, 1, 0)
        most = np.minimum(cap, size[inside] * 9 // 36)
        slack = weight - most - 1
        lost = (bare * np.where(kind < a, 2, 1)).reshape(n, m).sum(1)
        short = lost > slack
        spare = np.where(short, slack, slack - lost)
        which = np.flatnonzero(inside)
        name = lambda s, k, j=j: (mixed(s + mixed(k.astype(np.uint64) * np.uint64(64) + np.uint64(j))) & ~np.uint64(63)) | np.uint64(j)
        full = np.flatnonzero(~bare | short[np.arange(n * m) // m])
        rows_out.append(which[full // m])
        sig_out.append(name(total[full], full % m))
        spare_out.append(spare[full // m])
        if a:
            d = np.flatnonzero((seg.astype(np.int64) < a) & (~bare[key] | short[local[o]]))
            rows_out.append(o[d])
            sig_out.append(name(total[key[d]] - value[d], key[d] % m))
            spare_out.append(spare[local[o[d]]])
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(sig_out), np.concatenate(spare_out)


# ---- Spark stages ----------------------------------------------------------------------------


def _describe(batches):
    for batch in pieces(batches, "text", PIECE):
        owner, h, g = shingle_sets(batch.column("text"))
        size = _sizes(owner, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(size.astype(np.int64)), pa.array(_set_names(owner, h, size)), pa.array(_set_ids(owner, h, g, batch.num_rows), pa.binary()), pa.array(_sketches(owner, h, size), pa.binary())], names=["doc_id", "th", "n_shingles", "h", "id", "sketch"])


def _sign(batches):
    seen: set[int] = set()  # sets of this task; equal ones sign once
    hot = np.zeros(0, np.uint64)
    for batch in pieces(batches, "text", PIECE):
        owner, h, _ = shingle_sets(batch.column("text"), both=False)
        size = _sizes(owner, batch.num_rows)
        name = _set_names(owner, h, size)
        fresh = np.zeros(batch.num_rows, bool)
        for i, x in enumerate(name.tolist()):
            if x not in seen:
                seen.add(x)
                fresh[i] = True
        use = fresh[owner]
        row, sig, spare = signatures(owner[use], h[use], np.where(fresh, size, 0))
        if not len(row):
            continue
        # a signature of more than HOT sets is known to be shared: HOT rows of it go the way of all rows, the others (and
        # those of this task's later texts) are dealt to `salt` 1 and above, so that no task gets them all
        order = np.argsort(sig, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], sig[order][1:] != sig[order][:-1]]))
        count = np.diff(np.concatenate([first, [len(sig)]]))
        nth = np.empty(len(sig), np.int64)
        nth[order] = np.arange(len(sig)) - np.repeat(first, count)
        beyond = np.isin(sig, hot) if len(hot) else np.zeros(len(sig), bool)
        hot = np.union1d(hot, sig[order][first[count > HOT]])
        salt = np.where(beyond | (nth >= HOT), 1 + (name[row].view(np.uint64) >> np.uint64(50)).astype(np.int64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt.astype(np.int16)), pa.array(name[row]), pa.array(np.minimum(spare, 32767).astype(np.int16))], names=["sig", "salt", "h", "spare"])


def _shared(batches):
    """From rows sorted by signature, salt and set: those of signatures that more than one set has, each once. A row waits
    until the next one tells whether it is alone; rows with a salt are of shared signatures anyway."""
    last = None  # sig, salt, h, spare of the row before, and whether it is out already

    def out(cols, pick):
        return pa.RecordBatch.from_arrays([pa.array(cols[k][pick]) for k in (0, 2, 3)], names=["sig", "h", "spare"])

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([[v], c]).astype(c.dtype) for v, c in zip(last[:4], cols, strict=True)]
        sig, salt, h, _ = cols
        same = (sig[1:] == sig[:-1]) & (salt[1:] == salt[:-1])
        new = np.concatenate([[True], ~(same & (h[1:] == h[:-1]))])  # not the same set again
        more = same & (h[1:] != h[:-1])
        # whether a signature's run holds two sets: by run, as copies of one set may stand between
        run = np.cumsum(np.concatenate([[True], ~same])) - 1
        several = np.bincount(run[1:][more], minlength=run[-1] + 1) > 0
        if last is not None and last[4]:
            several[0] = True
        keep = new & (several[run] | (salt > 0))
        if last is not None and (last[4] or last[1] > 0):
            keep[0] = False
        tail = run == run[-1]
        lone = not several[run[-1]] and salt[-1] == 0  # one set so far: waits
        if lone:
            keep[tail] = False
        if keep.any():
            yield out(cols, keep)
        last = (*(c[-1] for c in cols), not lone)


def _with_sets(batches):
    for batch in pieces(batches, "text", PIECE):
        owner, h, g = shingle_sets(batch.column("text"))
        cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
        a, b = h.tobytes(), g.tobytes()
        right = pa.array([x == y for x, y in zip(_set_ids(owner, h, g, batch.num_rows), batch.column("id").to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([a[x * 8 : y * 8] + b[x * 8 : y * 8] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "items"]).filter(right)


def _linked(n: int, a: int, b: int) -> bool:
    return OF * n >= ABOVE * (a + b - n)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sets share; x and y hold the sorted first hashes and then the second ones."""
    n, m = len(x) // 2, len(y) // 2
    if not n or not m:
        return 0
    at = np.minimum(np.searchsorted(x[:n], y[:m]), n - 1)
    return int(((x[:n][at] == y[:m]) & (x[n:][at] == y[m:])).sum())


def _verify(batches):
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if _linked(_common(x, y), len(x) // 2, len(y) // 2):
                keep.append(i)
        if keep:
            yield batch.select(["a", "b"]).take(pa.array(keep))


def _close(batches):
    for batch in batches:
        keep = [i for i, (x, y, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "sizes")), strict=True)) if not _apart(x, y, n)]
        if keep:
            yield batch.select(["a", "b"]).take(pa.array(keep))


def _block_links(pdf):
    """Links between a block's documents that lack a link to the main class (part 0) and another block's documents."""
    import pandas as pd

    x, y = pdf[pdf.part == 0], pdf[pdf.part == 1]
    found = []
    if len(x) and len(y):
        xs, ys = ([np.frombuffer(b, np.uint64).reshape(2, -1) for b in side["items"]] for side in (x, y))
        # both hashes of an element as one value
        mark = np.dtype([("h", np.uint64), ("g", np.uint64)])
        xs, ys = ([np.ascontiguousarray(s.T).view(mark).ravel() for s in side] for side in (xs, ys))
        vocabulary = np.unique(np.concatenate(xs))
        ny, nx = np.array([len(s) for s in ys]), np.array([len(s) for s in xs])
        for at in range(0, len(vocabulary), 1 << 14):
            part = vocabulary[at : at + (1 << 14)]

            def matrix(sets, part=part):
                out = np.zeros((len(sets), len(part)), np.float32)
                for i, s in enumerate(sets):
                    k = np.searchsorted(part, s)
                    out[i, k[(k < len(part)) & (part[np.minimum(k, len(part) - 1)] == s)]] = 1
                return out

            more = matrix(xs) @ matrix(ys).T
            both = more if at == 0 else both + more  # noqa: F821
        n = np.rint(both).astype(np.int64)
        cx, cy = x["c"].tolist(), y["c"].tolist()
        name = {c: i for i, c in enumerate({*cx, *cy})}
        kx, ky = np.array([name[c] for c in cx]), np.array([name[c] for c in cy])
        ok = (OF * n >= ABOVE * (nx[:, None] + ny[None, :] - n)) & (kx[:, None] != ky[None, :])
        # links that join nothing new within the two blocks are left out
        parent: dict[int, int] = {}

        def root(c):
            while c in parent:
                c = parent[c]
            return c

        for i, j in zip(*(k.tolist() for k in np.nonzero(ok)), strict=True):
            a, b = root(kx[i]), root(ky[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((cx[i], cy[j]))
    return pd.DataFrame(found, columns=["a", "b"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, name, id and sketch of the set of each document; sets are equal if and only if their ids are."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_describe, "doc_id long, th long, n_shingles long, h long, id binary, sketch binary")


def set_classes(docs: DataFrame, described: DataFrame, small: int = SMALL, most_sent: int = MOST_SENT) -> DataFrame:
    """Classes of linked sets: v (id of a set) and c (the least id of its class), for all sets with a link.

    A signature of many sets is dropped for a set whose spare weight covers it (some other segment still agrees). What is
    left of large buckets are sets whose segments are mostly common, that is, large groups of near copies: each set meets
    its bucket's most central one first. From then on only sets of different classes are compared, and links are kept
    between classes, so that a group of any size makes no more links than it has members: in buckets of up to `small` sets
    every such pair, in larger ones the sets outside of the group's main class with all others, block against block.
    """
    rows = docs.select("text").mapInArrow(_sign, "sig long, salt short, h long, spare short")
    shared = stored(rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "h").mapInArrow(_shared, "sig long, h long, spare short"))
    heavy = F.element_at(F.array(*[F.lit(2 if a else 1) for _, a, _ in levels()]), (F.col("sig").bitwiseAND(63) + 1).cast("int"))
    band = F.col("sig").bitwiseAND(63).alias("band")
    many = shared.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > small)
    marked = shared.join(many, "sig", "left").select("sig", "h", "spare", "n", band)
    bad = marked.filter("n is not null").groupBy("h", "band").agg(F.sum(heavy).alias("weight"))
    kept = marked.join(bad, ["h", "band"], "left").filter("n is null or weight > spare").select("sig", "h")
    # the buckets as they are without what was dropped
    n = kept.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(kept.join(n, "sig"))
    sets = described.filter("n_shingles > 0").groupBy("id").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.max("n_shingles").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("h").alias("h"))
    sets = stored(sets.join(buckets.select("h").distinct(), "h", "left_semi").select("h", "id", "d.doc_id", "d.th", "size", "sketch"))
    buckets = stored(buckets.join(sets.select("h", "id"), "h").select("sig", "id", (F.col("n") <= small).alias("little")).distinct())

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that neither sizes nor sketches rule out."""
        side = lambda x: sets.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{OF} * least(size_a, size_b) >= {ABOVE} * greatest(size_a, size_b)")
        return stored(both.select("a", "b", "sketch_a", "sketch_b", (F.col("size_a") + F.col("size_b")).alias("sizes")).mapInArrow(_close, "a binary, b binary"))

    def items_of(ids: DataFrame) -> DataFrame:
        """The elements of some sets, from the text of one document each."""
        wanted = stored(sets.select("id", "doc_id", "th").join(ids.distinct(), "id", "left_semi"))
        few = wanted.limit(most_sent + 1).count() <= most_sent
        side = (F.broadcast(wanted) if few else wanted).alias("w")
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).alias("d").join(side, F.expr("d.th = w.th and d.doc_id <=> w.doc_id")).select("w.id", "d.text")
        return stored(texts.mapInArrow(_with_sets, "id binary, items binary").dropDuplicates(["id"]))

    def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
        full = pairs.join(items.toDF("a", "items_a"), "a").join(items.toDF("b", "items_b"), "b").select("a", "b", "items_a", "items_b")
        return full.mapInArrow(_verify, "a binary, b binary")

    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    large, little = buckets.filter("not little").select("sig", "id"), buckets.filter("little").select("sig", "id")
    crowded = large.limit(1).count() > 0
    if crowded:
        # the most central set of a bucket: the one in most large buckets
        central = large.groupBy("id").agg(F.count("*").alias("times"))
        pivot = large.join(central, "id").groupBy("sig").agg(F.max_by("id", F.struct("times", "id")).alias("pivot"))
        stars = stored(large.join(pivot, "sig").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).filter("a <> b").distinct())
        items = items_of(large.select("id"))
        classes = connected(verified(close(stars), items))
        little = little.join(classes.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    else:
        little = little.withColumn("c", F.col("id"))
    pairs = little.alias("x").join(little.alias("y"), F.expr("x.sig = y.sig and x.id < y.id and x.c <> y.c")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    near = close(pairs.distinct())
    found = verified(near, items_of(ends(near)))
    if not crowded:
        return connected(found)
    classes = connected(classes.toDF("a", "b").union(_between(found, classes)))
    groups = connected(stars).toDF("id", "g")
    members = groups.join(classes.toDF("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    main = members.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("k"))
    members = stored(members.join(main, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / BLOCK).cast("long"))))
    loose = members.filter("c <> main")
    if loose.limit(1).count() == 0:
        return classes
    loose_blocks, blocks = loose.select("g", F.col("block").alias("i")).distinct(), members.select("g", F.col("block").alias("j")).distinct()
    meet = loose_blocks.join(blocks, "g")
    left = loose.withColumnRenamed("block", "i").join(meet, ["g", "i"]).select("g", "i", "j", F.lit(0).alias("part"), "id", "c")
    right = members.withColumnRenamed("block", "j").join(meet, ["g", "j"]).select("g", "i", "j", F.lit(1).alias("part"), "id", "c")
    more = left.union(right).join(items, "id").groupBy("g", "i", "j").applyInPandas(_block_links, "a binary, b binary")
    return connected(classes.toDF("a", "b").union(more.distinct()))


def _between(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links as links between classes, each once."""
    side = lambda x: classes.toDF(x, f"c_{x}")
    both = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    return both.filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, small: int = SMALL, most_sent: int = MOST_SENT) -> DataFrame:
    """Per row of documents: doc_id, th (hash of the text), n_shingles, class (a digest; null without shingles) and
    component_id (the smallest doc_id reachable by links).

    A document's set holds its distinct five-word shingles, A-Z lower-cased; a text of fewer words is one shingle; null,
    empty and blank texts have none and are linked with nothing, not with each other either. Documents of equal sets are
    linked and are one class from the start, so groups of copies cost nothing. Rows that repeat a doc_id give a row each,
    of one class if their texts are linked. A row without doc_id has the smallest doc_id that it is linked with, or none.
    An empty table gives an empty table; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    described = stored(describe(docs))
    classes = set_classes(docs, described, small, most_sent)
    ids = described.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # one row for each class, then one for each set with copies or links; documents meet those last
    held = classes.toDF("id", "c").join(ids, "id")
    linked = held.join(held.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("id", "c", "component_id")
    known = ids.join(linked, "id", "left").filter("copies > 1 or c is not null").select("id", "c", F.coalesce("component_id", "least").alias("component_id"))
    out = described.join(known, "id", "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("c", "id")).alias("class"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
