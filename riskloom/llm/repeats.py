"""Operator 8: removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Strings that may repeat are found first,
without loss: of the K-byte grams in each window of LENGTH bytes the one of the least hash is the window's anchor, so
equal windows have equal anchors at the same place. Windows whose anchor occurs once in the corpus occur once. The texts
around the other anchors are grouped by anchor, equal ones once; a group's texts are dealt into shards, each shard's
suffixes are sorted once, and the shards' transforms are merged by refining their interleave, which also gives the common
prefixes and so the intervals of equal LENGTH-byte strings. Symbols of the transforms are blocks of BLOCK bytes (as
hashes), so that a merge settles in LENGTH / BLOCK rounds.

An anchor with very many different texts around it (a passage of a third of all documents) is split without loss before
it is merged: of its windows, those with the anchor in one half of the places share a longer string around it, those with
it in the other half another one, and these strings are the new keys. A group that is still too large is halved again, at
most nine times, after which windows of one key are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import RangeHash, flat, pieces, stored, table

LENGTH, K, BLOCK = 400, 120, 100
WINDOW = LENGTH - K + 1
#: Shards of a work unit, and bytes of text from which on a unit is closed (at the next anchor).
SHARDS, UNIT = 2, 1 << 19
#: A key with more bytes of different texts is split.
PART = 1 << 21
#: Anchors, or documents with repeats, up to this number are sent to every task; more are joined by shuffle.
MOST_SENT = 1 << 20
PIECE = 1 << 20
#: Rows of an anchor and task that go the way of all rows; further ones are known to repeat and are salted.
HOT = 32
#: Low bits of a packed hash that hold a position, and window starts of a long text that are looked at together.
_PLACE, CHUNK = np.uint64((1 << 28) - 1), 1 << 22


def _sliding(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    cut = full.reshape(-1, w)
    ahead = np.minimum.accumulate(cut, 1).ravel()
    back = np.minimum.accumulate(cut[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """Row, hash, position, first and last window start (all from the text's start) of the anchors of texts in one buffer.
    A long text is looked at in chunks of window starts; an anchor may then come twice, with other windows each time."""
    if len(data) < 2 * chunk + LENGTH:
        return _anchors(data, at)
    found = []
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for begin in range(a, max(a, b - LENGTH) + 1, chunk):
            part = data[begin : min(b, begin + chunk + LENGTH - 1)]
            r, h, place, first, last = _anchors(part, np.array([0, len(part)]))
            found.append((r + row, h, place + begin - a, first + begin - a, last + begin - a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(data) < LENGTH:
        return none
    grams = np.arange(len(data) - K + 1)
    g = RangeHash(data)(grams, grams + K)
    least = _sliding((g & ~_PLACE) | grams.astype(np.uint64), WINDOW)
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0)
    start = np.arange(len(row)) - first[row] + at[row]
    if not len(start):
        return none
    place = (least[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    end = np.concatenate([new[1:], [len(place)]]) - 1
    r = row[new]
    return r, g[place[new]], place[new] - at[r], start[new] - at[r], start[end] - at[r]


class Shard:
    """Sorted suffixes of some texts with, for each, the block before it (0: none) and the block that it starts with (0:
    shorter than a block). `text` and `place` say where a suffix stands."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        size = np.array([len(t) + 1 for t in texts], np.int64)  # with the empty suffix
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(texts)), size)
        spot = np.arange(len(data)) - begin[owner]
        left = size[owner] - 1 - spot
        hashes, p = RangeHash(data), np.arange(len(data))
        block = np.zeros(len(data) + LENGTH + BLOCK, np.uint64)
        ok = np.flatnonzero(left >= BLOCK)
        block[ok] = hashes(p[ok], p[ok] + BLOCK) | np.uint64(1)
        keys = [np.where(left >= d + BLOCK, block[d : d + len(data)], np.uint64(0)) for d in range(0, LENGTH, BLOCK)]
        order = np.lexsort(keys[::-1])
        self.first = block[order]
        self.before = np.where(spot[order] >= BLOCK, block[np.maximum(order - BLOCK, 0)], np.uint64(0))
        self.text, self.place, self.left = ids[owner[order]], spot[order], left[order]
        self.group: np.ndarray | None = None


def merge(a: Shard, b: Shard) -> Shard:
    """Merges two shards. `take` is the interleave: which shard gives each next suffix. A round scans the interleave and
    deals the suffixes to the sections of the blocks before them; after r rounds it is right for the first r blocks. Two
    neighbours stay in one group as long as their blocks and the groups of what follows are equal, so the groups after
    LENGTH / BLOCK rounds are the intervals with common prefixes of LENGTH bytes or more."""
    na, nb = len(a.first), len(b.first)
    codes = np.unique(np.concatenate([a.before, b.before]), return_inverse=True)[1]
    code_a, code_b = codes[:na], codes[na:]
    short_a, short_b = int((a.first == 0).sum()), int((b.first == 0).sum())
    short = np.concatenate([np.zeros(short_a, bool), np.ones(short_b, bool)])
    take = np.concatenate([np.zeros(na, bool), np.ones(nb, bool)])
    group = np.zeros(na + nb, np.int64)
    bare = bool((a.before == 0).any() or (b.before == 0).any())  # then 0 is the code of "no block"
    for _ in range(LENGTH // BLOCK):
        code = np.empty(na + nb, codes.dtype)
        code[~take], code[take] = code_a, code_b
        has = code > 0 if bare else np.ones(len(code), bool)
        order = np.flatnonzero(has)
        order = order[np.argsort(code[order], kind="stable")]
        c, g = code[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        take = np.concatenate([short, take[order]])
        group = np.concatenate([np.zeros(len(short), np.int64), np.cumsum(new)])
    out = Shard.__new__(Shard)
    for name in ("first", "before", "text", "place", "left"):
        x, y = getattr(a, name), getattr(b, name)
        both = np.empty(na + nb, x.dtype)
        both[~take], both[take] = x, y
        setattr(out, name, both)
    out.group = group
    return out


def repeated(texts: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every LENGTH-byte string that starts more than once in the texts."""
    ids = np.arange(len(texts))
    parts = [Shard([texts[i] for i in ids[k::shards]], ids[k::shards]) for k in range(shards) if len(ids[k::shards])]
    if len(parts) == 1:
        parts.append(Shard([], ids[:0]))
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    whole = parts[0]
    full = whole.left >= LENGTH
    group, text, place = whole.group[full], whole.text[full], whole.place[full]
    again = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    again[1:] |= same
    again[:-1] |= same
    return text[again], place[again]


# ---- Spark stages ----------------------------------------------------------------------------


def _digests(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits for each text; texts are equal if and only if these are."""
    raw, cut = data.tobytes(), at.tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _describe(batches):
    for batch in pieces(batches, "text"):
        data, at = flat(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.diff(at)), pa.array(_digests(data, at), pa.binary())], names=["doc_id", "th", "n_bytes", "c"])


def _anchor_rows(batches):
    seen: set[bytes] = set()  # texts of this task; equal ones give anchors once
    hot = np.zeros(0, np.uint64)
    for batch in pieces(batches, "text", PIECE):
        data, at = flat(batch.column("text"))
        c = _digests(data, at)
        fresh = np.array([not (x in seen or seen.add(x)) for x in c], bool)
        row, h, place, _, _ = anchors(data, at)
        k = np.flatnonzero(fresh[row])
        if not len(k):
            continue
        row, h, place = row[k], h[k], place[k]
        # rows of an anchor that this task has often: HOT of them go to the anchor's task, the others are dealt out
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.diff(np.concatenate([first, [len(h)]]))
        nth = np.empty(len(h), np.int64)
        nth[order] = np.arange(len(h)) - np.repeat(first, count)
        beyond = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
        hot = np.union1d(hot, h[order][first[count > HOT]])
        by_text = np.array([int.from_bytes(x[:2], "little") >> 2 for x in c], np.int64)[row]
        salt = np.where(beyond | (nth >= HOT), 1 + by_text, 0).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array([c[i] for i in row.tolist()], pa.binary()), pa.array(place)], names=["anchor", "salt", "c", "place"])


def _again(batches):
    """From rows sorted by anchor, salt, text and place: those of anchors with more than one place, each once. A row waits
    until the next one tells whether it is alone; rows with a salt are of such anchors anyway."""
    last = None  # anchor, salt, text, place of the row before, and whether it is out already
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, salt, c, place = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.array(batch.column(2).to_pylist(), object), np.asarray(batch.column(3)))
        if last is not None:
            anchor, salt, place = (np.concatenate([[v], x]).astype(x.dtype) for v, x in ((last[0], anchor), (last[1], salt), (last[3], place)))
            c = np.concatenate([np.array([last[2]], object), c])
        same = (anchor[1:] == anchor[:-1]) & (salt[1:] == salt[:-1])
        copy = same & (place[1:] == place[:-1]) & (c[1:] == c[:-1])
        run = np.cumsum(np.concatenate([[True], ~same])) - 1
        several = np.bincount(run[1:][same & ~copy], minlength=run[-1] + 1) > 0
        if last is not None and last[4]:
            several[0] = True
        keep = np.concatenate([[True], ~copy]) & (several[run] | (salt > 0))
        if last is not None and (last[4] or last[1] > 0):
            keep[0] = False
        lone = not several[run[-1]] and salt[-1] == 0
        if lone:
            keep[run == run[-1]] = False
        k = np.flatnonzero(keep)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(list(c[k]), pa.binary()), pa.array(place[k])], names=["c", "place"])
        last = (anchor[-1], salt[-1], c[-1], place[-1], not lone)


_CONTEXT = "key long, k binary, c binary, start long, at int, low int, width int, context binary"


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    """key, c, start, at, low, width and context of texts around an anchor, with a digest k of the text."""
    key, c, start, at, low, width, context = zip(*rows, strict=True)
    k = [hashlib.blake2b(x, digest_size=16).digest() for x in context]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary()), pa.array(start, pa.int64()), *(pa.array(x, pa.int32()) for x in (at, low, width)), pa.array(context, pa.binary())], names=["key", "k", "c", "start", "at", "low", "width", "context"])


def _contexts(batches):
    """The text around each wanted anchor of a document: from its first window's start to its last window's end; `at` is the
    anchor's place in it, and its windows have the anchor `low` to `low + width - 1` bytes from their start."""
    for batch in pieces(batches, "text", PIECE):
        data, at = flat(batch.column("text"))
        raw, c = data.tobytes(), batch.column("c").to_pylist()
        row, h, place, first, last = anchors(data, at)
        wanted = batch.column("places").to_pylist()
        keys = np.concatenate([np.array(w, np.int64) + (i << 36) for i, w in enumerate(wanted)])
        k = np.flatnonzero(np.isin(place + (row << 36), keys))
        lo, hi = at[row[k]] + first[k], at[row[k]] + last[k] + LENGTH
        texts = [c[i] for i in row[k].tolist()]
        each = list(zip(h[k].view(np.int64).tolist(), texts, first[k].tolist(), (place[k] - first[k]).tolist(), [0] * len(k), [WINDOW] * len(k), [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], strict=True))
        for s in range(0, len(each), 8192):
            yield _rows_of(each[s : s + 8192])


def _halves(key: int, c: bytes, start: int, at: int, low: int, width: int, context: bytes) -> list[tuple]:
    """A context's windows in two parts, by the anchor's place in them. All windows of a part share a string around the
    anchor, which is its key; equal windows are in one part and have one key."""
    out, half, most = [], (width + 1) // 2, len(context) - LENGTH  # `most`: the last window's start
    for p, q in ((low, low + half), (low + half, low + width)):
        near, far = max(p, at - most), min(q - 1, at)
        if near <= far:
            core = context[at - p : at - q + 1 + LENGTH]
            name = hashlib.blake2b(core, digest_size=8, salt=p.to_bytes(2, "little")).digest()
            out.append((int.from_bytes(name, "little", signed=True), c, start + at - far, far, p, q - p, context[at - far : at - near + LENGTH]))
    return out


def _split(batches):
    for batch in batches:
        rows = [x for row in zip(*(batch.column(n).to_pylist() for n in ("key", "c", "start", "at", "low", "width", "context")), strict=True) for x in _halves(*row)]
        if rows:
            yield _rows_of(rows)


def _units(batches):
    """Work units from different contexts sorted by key: the stretches (from, to) of each that repeat. A unit ends at a new
    key, whose contexts have PART bytes at most. A context that stands at several places repeats as a whole."""
    held: list[tuple[int, bytes, int, bytes]] = []
    size, last = 0, None

    def done():
        out = [(key, k, 0, len(context)) for key, k, copies, context in held if copies > 1]
        keys = np.array([h[0] for h in held])
        some = np.flatnonzero(np.concatenate([[False], keys[1:] == keys[:-1]]) | np.concatenate([keys[1:] == keys[:-1], [False]]))
        if len(some):
            text, place = repeated([held[i][3] for i in some.tolist()])
            order = np.lexsort((place, text))
            text, place = text[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])) if len(text) else np.zeros(0, np.int64)
            stop = np.concatenate([new[1:], [len(text)]]) - 1 if len(text) else new
            for i, x, y in zip(some[text[new]].tolist(), place[new].tolist(), place[stop].tolist(), strict=True):
                out.append((held[i][0], held[i][1], x, y + LENGTH))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["key", "k", "from", "to"])

    for batch in batches:
        for key, k, copies, context in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if size >= UNIT and key != last:
                yield done()
                held, size = [], 0
            held.append((key, k, copies, context))
            size += len(context)
            last = key
    if held:
        yield done()


def _apply(batches):
    for batch in pieces(batches, "text", PIECE):
        data, at = flat(batch.column("text"))
        n, spans, kept = [], [], []
        for i, found in enumerate(batch.column("spans").to_pylist()):
            text, gone, runs, end = data[at[i] : at[i + 1]], 0, 0, -1
            parts, last = [], 0
            for s in sorted((x["start"], x["end"]) for x in found or ()):
                if s[0] > end:  # a new run; touching runs are one
                    parts.append(text[last : s[0]])
                    runs += 1
                    gone, end = gone + s[1] - s[0], s[1]
                elif s[1] > end:
                    gone, end = gone + s[1] - end, s[1]
                last = end
            parts.append(text[last:])
            n.append(gone)
            spans.append(runs)
            kept.append(b"".join(p.tobytes() for p in parts))
        names = [x for x in batch.schema.names if x != "spans"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(np.diff(at)), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=[*names, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def _few(df: DataFrame, most_sent: int) -> bool:
    return df.limit(most_sent + 1).count() <= most_sent


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _merged(contexts: DataFrame, part: int, most_sent: int) -> DataFrame:
    """c, start, end of the repeated stretches of the texts around anchors. Keys with more than `part` bytes of different
    texts are split and their parts looked at in the next round; all others are merged, a key in one task."""
    done = None
    for _ in range(WINDOW.bit_length() + 1):
        contexts = stored(contexts)
        different = stored(contexts.groupBy("key", "k").agg(F.count("*").alias("copies"), F.any_value("context").alias("context")))
        big = stored(different.groupBy("key").agg(F.sum(F.octet_length("context")).alias("size"), F.count("*").alias("n")).filter((F.col("size") > part) & (F.col("n") > 1)).select("key"))
        some = big.limit(1).count() > 0
        side = F.broadcast(big) if _few(big, most_sent) else big
        mine = different.join(side, "key", "left_anti") if some else different
        found = mine.repartition("key").sortWithinPartitions("key", "k").select("key", "k", "copies", "context").mapInArrow(_units, "key long, k binary, `from` long, `to` long")
        spans = contexts.join(found, ["key", "k"]).select("c", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
        done = spans if done is None else done.union(spans)
        if not some:
            break
        contexts = contexts.join(side, "key", "left_semi").mapInArrow(_split, _CONTEXT)
    return done.distinct()


def repeated_spans(docs: DataFrame, described: DataFrame, most_sent: int = MOST_SENT, part: int = PART) -> DataFrame:
    """c, spans: for each text (by digest) the stretches of bytes that go, as an array of (start, end) which may overlap.

    Texts that several documents share go whole and give anchors once. Anchors of one corpus place are dropped by a sort
    of (anchor, text, position) rows, about one for 140 bytes, in which the rows of a very common anchor are dealt to many
    tasks; only texts around the others are shuffled.
    """
    rows = docs.select("text").mapInArrow(_anchor_rows, "anchor long, salt short, c binary, place long")
    again = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "c", "place").mapInArrow(_again, "c binary, place long")
    wanted = again.groupBy("c").agg(F.collect_set("place").alias("places"))
    first = described.filter(F.col("n_bytes") >= LENGTH).groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    wanted = stored(wanted.join(first, "c").select("d.doc_id", "d.th", "c", "places"))
    near = _hashed(docs)
    hashes = wanted.select("th").distinct()
    if _few(hashes, most_sent):  # only their texts are shuffled then
        near = near.join(F.broadcast(hashes), "th", "left_semi")
    texts = near.alias("d").join(wanted.alias("w"), F.expr("d.th = w.th and d.doc_id <=> w.doc_id")).select("w.c", "w.places", "d.text")
    parts = _merged(texts.mapInArrow(_contexts, _CONTEXT), part, most_sent)
    whole = first.filter("copies > 1").select("c", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    return parts.union(whole).groupBy("c").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, most_sent: int = MOST_SENT, part: int = PART) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 to documents (doc_id, text, any other columns).

    Texts are UTF-8 bytes; matches do not cross texts; all is judged on the input. Null, empty and short texts stay whole.
    Rows that repeat a text, with the same doc_id or not, are copies of each other and go whole if long enough. Rows
    without a doc_id are judged like all others. A kept text may end within a character, so it is binary. An empty table gives an empty table; columns
    of the five names, and spans, are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans")
    described = stored(_hashed(docs).mapInArrow(_describe, "doc_id long, th long, n_bytes long, c binary"))
    spans = stored(repeated_spans(docs, described, most_sent, part))
    own = stored(described.join(spans, "c").select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"]))
    hashes = own.select("th").distinct()
    with_hash = docs.withColumn("__th", F.xxhash64("text"))
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
    mine, others = with_hash, None
    if _few(hashes, most_sent):  # texts that stay whole are not shuffled
        side = F.broadcast(hashes.withColumnRenamed("th", "__th"))
        mine, others = with_hash.join(side, "__th", "left_semi"), with_hash.join(side, "__th", "left_anti").select(*docs.columns, none.alias("spans"))
    joined = mine.alias("d").join(own.alias("o"), F.expr("d.__th = o.th and d.doc_id <=> o.doc_id"), "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], "o.spans")
    joined = joined if others is None else joined.unionByName(others)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"])
    return joined.mapInArrow(_apply, schema)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
