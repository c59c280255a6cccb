"""Operator 10: line dedup with two Bloom filters, for once-seen and twice-seen lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import PrimeHash, RangeHash, flat, is_space, lowered, pieces, stored, table

#: Shorter keys (code points) are never dropped.
MIN_CHARS = 40
#: Keys in so many documents lose their lines.
MIN_DOCS = 5
#: log2 of the bits of each filter: eight or more for each line that can be long enough, within these bounds (1 MB to 64 MB).
#: The upper one is what every task can hold; beyond some 10 GB of text the filters fill up and let more lines through to
#: the exact step, which shuffles them; the result stays the same.
LEAST_BITS, MOST_BITS = 23, 29
#: Confirmed keys up to this number go to every task (24 bytes each); more are joined by document.
MOST_SENT = 1 << 20
_BLOCK = 16


class Lines:
    """The lines of all texts of an Arrow column as byte ranges: row, start, end, and the key's range (stripped)."""

    def __init__(self, column):
        self.data, at = flat(column)
        breaks = np.flatnonzero(self.data == 10).astype(np.int64)
        # a text's end comes before a line feed at the same position, which is the next text's first byte
        marks = np.sort(np.concatenate([breaks * 2 + 1, at[1:] * 2]), kind="stable")
        is_break, self.end = (marks & 1).astype(bool), marks >> 1
        self.start = np.concatenate([[0], (self.end + is_break)[:-1]]).astype(np.int64) if len(marks) else marks
        self.row = np.cumsum(~is_break) - ~is_break
        self.low = lowered(self.data)
        solid = np.flatnonzero(~is_space(self.data)).astype(np.int64)
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        full = b > a
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[full], self.key_end[full] = solid[a[full]], solid[b[full] - 1] + 1
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.chars = chars[self.key_end] - chars[self.key_start]

    def first(self, pick: np.ndarray) -> np.ndarray:
        """64 bits for each of the picked lines' keys, for filters."""
        return RangeHash(self.low)(self.key_start[pick], self.key_end[pick])

    def hashes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """126 bits, of two kinds of hashes, for each of the picked lines' keys."""
        return self.first(pick), PrimeHash(self.low)(self.key_start[pick], self.key_end[pick])


def filter_bits(docs: DataFrame, min_chars: int) -> int:
    """Bits of the filters, from the most lines of min_chars that the texts can have."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, (8 * (size // (min_chars + 1)) + 1).bit_length()))


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and which of them are missing."""
    missing = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)), missing


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each hash, at most 32 bits each."""
    return np.concatenate([h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)])


def _blocks(once: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted bit positions of both filters, cut into blocks of 2**16 bits."""
    ids = np.unique(np.concatenate([once, twice]) >> np.uint64(_BLOCK))
    cut = lambda x: np.searchsorted(x, np.concatenate([ids, ids[-1:] + np.uint64(1)]) << np.uint64(_BLOCK)) if len(ids) else []
    a, b = cut(once), cut(twice)
    o, t = once.astype("<u2"), twice.astype("<u2")
    for i, k in enumerate(ids.tolist()):
        yield k, o[a[i] : a[i + 1]].tobytes(), t[b[i] : b[i + 1]].tobytes()


def _local_filters(min_chars: int, bits: int):
    def run(batches):
        found = []
        for batch in pieces(batches, "text"):
            lines = Lines(batch.column("text"))
            pick = np.flatnonzero(lines.chars >= min_chars)
            h = lines.first(pick)
            found.append(np.unique(np.stack([h, lines.row[pick].astype(np.uint64) + np.uint64(len(found)) * np.uint64(1 << 32)], 1), axis=0)[:, 0] if len(h) else h)
        if not found:
            return
        h, n = np.unique(np.concatenate(found), return_counts=True)
        rows = list(_blocks(np.unique(_probes(h, bits)), np.unique(_probes(h[n > 1], bits))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "once", "twice"])

    return run


def _merged(batches):
    """Filters of one block from all tasks (rows sorted by block): a bit is in `twice` if two tasks have it in `once`.
    Rows of a block follow each other, so only one block's 2 x 8 KB are held."""
    block, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.flatnonzero(twice).astype("<u2").tobytes()], pa.binary())], names=["block", "twice"])

    for batch in batches:
        for k, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != block:
                if block is not None and twice.any():
                    yield done()
                block, once, twice = k, np.zeros(1 << _BLOCK, bool), np.zeros(1 << _BLOCK, bool)
            o, t = np.frombuffer(o, "<u2"), np.frombuffer(t, "<u2")
            twice[o[once[o]]] = True
            twice[t] = True
            once[o] = True
    if block is not None and twice.any():
        yield done()


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The twice-seen filter: bytes of 2**bits bits. Each task fills both filters for its documents, blocks of them are
    merged by block, and the merged twice-seen filter, of fixed size, comes to the driver to be sent to all tasks."""
    return _gathered(docs.select("text").mapInArrow(_local_filters(min_chars, bits), "block long, once binary, twice binary"), bits)


def _of_hashes(bits: int):
    def run(batches):
        for batch in batches:
            for k, _, t in _blocks(np.zeros(0, np.uint64), np.unique(_probes(np.asarray(batch.column(0)).view(np.uint64), bits))):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b""], pa.binary()), pa.array([t], pa.binary())], names=["block", "once", "twice"])

    return run


def _gathered(local: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter from blocks of all tasks."""
    merged = local.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, twice binary")
    out = np.zeros(1 << bits >> 3, np.uint8)
    for block, t in merged.toLocalIterator() if bits > 27 else merged.collect():
        at = (np.uint64(block) << np.uint64(_BLOCK)) + np.frombuffer(t, "<u2").astype(np.uint64)
        np.bitwise_or.at(out, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return out


def _suspects(sent, min_chars: int, bits: int):
    def run(batches):
        twice = np.frombuffer(sent.value, np.uint8)
        for batch in pieces(batches, "text"):
            ids, missing = _ids(batch.column("doc_id"))
            lines = Lines(batch.column("text"))
            pick = np.flatnonzero(lines.chars >= min_chars)
            h1, h2 = lines.hashes(pick)
            at = _probes(h1, bits)
            hit = (twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            hit = np.flatnonzero(hit[: len(h1)] & hit[len(h1) :])
            if not len(hit):
                continue
            # a key once per document of this piece
            _, first = np.unique(np.stack([lines.row[pick[hit]].astype(np.uint64), h1[hit], h2[hit]], 1), axis=0, return_index=True)
            hit = hit[first]
            low = lines.low.tobytes()
            keys = [low[a:b] for a, b in zip(lines.key_start[pick[hit]].tolist(), lines.key_end[pick[hit]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lines.row[pick[hit]]], pa.int64(), mask=missing[lines.row[pick[hit]]]), pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64)), pa.array(keys, pa.binary())], names=["doc_id", "h1", "h2", "key"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, bits: int) -> DataFrame:
    """Line keys in at least min_docs documents: h1, h2, keeper (the largest doc_id that holds the key). Only lines that
    pass the twice-seen filter are shuffled; they are grouped by the key itself, so the filter's errors do no harm."""
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, min_chars, bits).tobytes())
    suspects = docs.select("doc_id", "text").mapInArrow(_suspects(sent, min_chars, bits), "doc_id long, h1 long, h2 long, key binary")
    # document ids may repeat: a key's documents are counted once each, by hashed doc_id first so that no hot key meets in one task
    per = suspects.groupBy("key", "h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    found = per.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    return found.select("h1", "h2", "keeper")


def _kept_text(lines: Lines, drop: np.ndarray, rows: int) -> list[bytes]:
    """Per row the lines that stay, joined by line feeds."""
    stay = ~drop
    raw, first = lines.data.tobytes(), np.searchsorted(lines.row, np.arange(rows + 1))
    cut = np.concatenate([[0], np.cumsum(drop)])[first]
    start, end = lines.start, lines.end
    out = []
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if cut[i + 1] == cut[i]:
            out.append(raw[start[a] : end[b - 1]])
        else:
            out.append(b"\n".join(raw[x:y] for x, y in zip(start[a:b][stay[a:b]].tolist(), end[a:b][stay[a:b]].tolist(), strict=True)))
    return out


_OUT = "n_lines long, n_dropped long, kept_text string"


def _apply(keys, min_chars: int, with_list: bool):
    """Drops lines. keys: sorted h1, and h2 and keeper in that order; or None, then each row has its own list `gone`."""

    def run(batches):
        g1, g2, keeper = (np.frombuffer(x, np.int64) for x in keys.value) if keys is not None else (None,) * 3
        for batch in pieces(batches, "text"):
            ids, missing = _ids(batch.column("doc_id"))
            lines = Lines(batch.column("text"))
            drop = np.zeros(len(lines.start), bool)
            pick = np.flatnonzero(lines.chars >= min_chars)
            if len(pick):
                h1, h2 = (h.view(np.int64) for h in lines.hashes(pick))
                if keys is not None:
                    if len(g1):
                        # all entries of an equal h1 are looked at, however many there are
                        at, stop, row = np.searchsorted(g1, h1), np.searchsorted(g1, h1, side="right"), lines.row[pick]
                        for step in range(int((stop - at).max(initial=0))):
                            k = np.minimum(at + step, len(g1) - 1)
                            drop[pick] |= (at + step < stop) & (g2[k] == h2) & ((keeper[k] != ids[row]) | missing[row])
                else:
                    gone = batch.column("gone")
                    own = {(i, x["h1"], x["h2"]) for i, g in enumerate(gone.to_pylist()) for x in g or ()}
                    if own:
                        drop[pick] = [x in own for x in zip(lines.row[pick].tolist(), h1.tolist(), h2.tolist(), strict=True)]
            n = np.bincount(lines.row, minlength=batch.num_rows)
            gone_n = np.bincount(lines.row[drop], minlength=batch.num_rows)
            kept = pa.array(_kept_text(lines, drop, batch.num_rows), pa.binary()).cast(pa.string())
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "gone" and not (name == "text" and not with_list)]
            names = [name for name in batch.schema.names if name != "gone" and not (name == "text" and not with_list)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n.astype(np.int64)), pa.array(gone_n.astype(np.int64)), kept], names=[*names, "n_lines", "n_dropped", "kept_text"])

    return run


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to documents (doc_id, text and any other columns).

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least min_chars code points in
    at least min_docs documents lose all lines except those of the largest doc_id that holds them. Null and empty texts
    are one empty line. Rows that repeat a doc_id count as one document. An empty table gives an empty table; other
    columns stay (n_lines, n_dropped, kept_text and gone are replaced). doc_id is a whole number; rows without one count as
    one document together, which is never the one that keeps a line.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "gone").withColumn("doc_id", F.col("doc_id").cast("long"))
    bits = filter_bits(docs, min_chars) if bits is None else bits
    found = stored(repeated_lines(docs, min_chars, min_docs, bits))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), _OUT])
    if found.limit(most_sent + 1).count() <= most_sent:
        rows = found.toArrow()
        cols = [np.asarray(rows.column(i).combine_chunks()) for i in range(3)]
        order = np.lexsort((cols[1], cols[0]))
        keys = tuple(c[order].tobytes() for c in cols)
        return docs.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(keys), min_chars, True), schema)
    # a filter of the confirmed keys alone, so that only their lines are shuffled
    sent = docs.sparkSession.sparkContext.broadcast(_gathered(found.select("h1").mapInArrow(_of_hashes(bits), "block long, once binary, twice binary"), bits).tobytes())
    held = docs.select("doc_id", "text").mapInArrow(_suspects(sent, min_chars, bits), "doc_id long, h1 long, h2 long, key binary").drop("key")
    gone = held.join(found, ["h1", "h2"]).filter("doc_id is null or doc_id <> keeper").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    joined = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id"), "left").select("d.*", "g.gone")
    return joined.mapInArrow(_apply(None, min_chars, True), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
