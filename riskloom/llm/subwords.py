"""Operator 12: SentencePiece encoding, by a table of distinct chunks, and decoding."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from riskloom.llm.common import encoded, flat, gathered, pieces, table, with_columns

#: The white-space marker of pieces.
MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
#: Bytes of text that share a chunk table, and chunks that the library is given as one text.
SLICE, TOGETHER = 1 << 22, 256

_loaded: dict[bytes, Model] = {}


class Model:
    """A loaded model and what has to be known of its pieces."""

    def __init__(self, proto: bytes):
        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        normal, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        of = lambda t: np.array([p.type == t for p in spec.pieces], bool)
        self.marked = np.array([p.piece.startswith(MARK) for p in spec.pieces], bool)
        self.control, self.unknown, byte = of(kind.CONTROL), of(kind.UNKNOWN), of(kind.BYTE)
        as_is = normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
        #: Whether texts can be cut before markers: one marker goes before each text, nothing else changes, no piece crosses.
        self.cuts = as_is and not of(kind.USER_DEFINED).any() and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces) and any(p.piece == MARK for p in spec.pieces)
        surface = [bytes([int(p.piece[1:-1], 16)]) if b else b"" if c else p.piece.replace(MARK, " ").encode() for p, b, c in zip(spec.pieces, byte, self.control, strict=True)]
        self.surfaces, self.offsets = flat(pa.array(surface, pa.large_binary()))

    def segmented(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, each without its first marker, one after the other, and how many each has. Chunks without
        a further marker are given to the library together, with blanks between: each then starts at a piece with a marker."""
        if not self.cuts:
            found = self.sp.encode(chunks.to_pylist(), num_threads=1)
            return _flat_ids(found), np.array([len(x) for x in found], np.int64)
        odd = np.asarray(pc.or_(pc.or_(pc.match_substring(chunks, " "), pc.match_substring(chunks, MARK)), pc.equal(pc.binary_length(chunks), 0)))
        easy = chunks.filter(pa.array(~odd))
        cuts = np.append(np.arange(0, len(easy), TOGETHER), len(easy))
        one = _flat_ids(self.sp.encode(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), easy.cast(pa.string())), " ").to_pylist(), num_threads=1)) if len(easy) else np.zeros(0, np.int32)
        heads = np.flatnonzero(self.marked[one])
        other = [self.sp.encode(c) if c else [self.sp.piece_to_id(MARK)] for c in chunks.filter(pa.array(odd)).to_pylist()]
        size = np.empty(len(chunks), np.int64)
        size[~odd], size[odd] = np.diff(np.append(heads, len(one))), [len(x) for x in other]
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for which, ids in ((~odd, one), (odd, _flat_ids(other))):
            out[gathered(np.arange(len(out)), begin[which], size[which])] = ids
        return out, size


def _flat_ids(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))


def _model(proto: bytes) -> Model:
    if proto not in _loaded:
        _loaded.clear()
        _loaded[proto] = Model(proto)
    return _loaded[proto]


def _used(code: np.ndarray, table_: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes over only those entries of a table that they name."""
    seen = np.zeros(len(table_), bool)
    seen[code] = True
    return (np.cumsum(seen) - 1)[code], table_.take(pa.array(np.flatnonzero(seen)))


def _sums(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def encode_column(column, model: Model, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow column, one after the other, and the offsets of texts."""
    data, at = flat(column)
    rows = len(at) - 1
    full = np.flatnonzero(at[1:] > at[:-1])
    mark = data == 32
    if len(data) > 2:
        wide = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2]))
        for i in range(3):
            mark[wide + i] = True
    if model.cuts:
        opens = mark & ~np.concatenate([[False], mark[:-1]])
    else:
        opens = np.zeros(len(data), bool)
    opens[at[full]] = True
    start = np.flatnonzero(opens)
    stop = np.concatenate([start[1:], [len(data)]])
    row = np.searchsorted(at, start, "right") - 1
    # the marker before a text is put there by the model; the others open their chunks
    key = start + np.where(start == at[row], 0, np.where(data[start] == 32, 1, 3)) if len(start) else start
    code, kinds = encoded(data, key, stop, pa.large_string())
    code, kinds = _used(code, kinds)
    ids, size = model.segmented(kinds)
    out = gathered(ids, (_sums(size)[:-1])[code], size[code])
    sums = _sums(size[code])[np.searchsorted(row, np.arange(rows + 1))]
    if not end:
        return out, sums
    offsets = sums + np.arange(rows + 1)
    both = np.full(int(offsets[-1]), model.sp.eos_id(), np.int32)
    both[gathered(np.arange(len(both)), offsets[:-1], np.diff(sums))] = out
    return both, offsets


def decode_column(column, model: Model) -> pa.Array:
    """Texts of lists of ids: the pieces' own texts one after the other, without the first marker. Lists with control ids
    before their end, with unknown ids or with bytes that are no characters are left to the library."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.fill_null([]) if column.null_count else column
    at = np.asarray(lists.offsets).astype(np.int64)
    ids = np.asarray(lists.values.slice(at[0], at[-1] - at[0])).astype(np.int32)
    at = at - at[0]
    rows = len(at) - 1
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model.marked)):
        raise ValueError("an id is outside of the vocabulary")
    # control ids at the ends have no text
    words = np.concatenate([[-1], np.maximum.accumulate(np.where(~model.control[ids], np.arange(len(ids)), -1))]).astype(np.int64)
    stop = np.maximum(at[:-1], words[at[1:]] + 1)
    odd = _sums(model.control[ids] | model.unknown[ids])
    plain = (odd[stop] == odd[at[:-1]]) & model.cuts
    size = np.diff(model.offsets)[ids]
    text, ends = gathered(model.surfaces, model.offsets[ids], size), _sums(size)
    begin = ends[at[:-1]] + ((stop > at[:-1]) & model.marked[ids[np.minimum(at[:-1], len(ids) - 1)]] if len(ids) else 0)
    length = np.where(plain, ends[at[1:]] - begin, 0)
    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(_sums(length)), pa.py_buffer(gathered(text, begin, length))])
    try:
        got = got.cast(pa.large_string())
        if plain.all():
            return got
        result = got.to_pylist()
    except pa.ArrowInvalid:
        result = got.to_pylist()
        for r, t in enumerate(result):
            try:
                result[r] = t.decode()
            except UnicodeDecodeError:
                plain[r] = False
    for r in np.flatnonzero(~plain).tolist():
        result[r] = model.sp.decode(ids[at[r] : at[r + 1]].tolist())
    return pa.array(result, pa.large_string())


def _proto(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model_path: str, end: bool = True) -> DataFrame:
    """Adds to docs (with text) `ids`, the ids that the library's encode gives for each whole text, with the end id last.

    Pieces do not cross white-space markers, so a text is cut before each run of markers. The different chunks of a slice
    of texts form a table, each is segmented once, and its ids are joined back by the chunks' positions; no
    chunk leaves its task, as shuffling all positions would cost more than segmenting. With a model for which that does not hold (other normalisation, pieces across markers) whole texts are the chunks.

    Null and empty texts have the end id only. Repeated rows give repeated results, an empty table an empty one. A column
    named ids is replaced. The model file is read on the driver, and its bytes go to the tasks.
    """
    proto = _proto(model_path)

    def run(batches):
        model = _model(proto)
        for batch in pieces(batches, "text", SLICE):
            ids, at = encode_column(batch.column("text"), model, end)
            yield with_columns(batch, (), [("ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))])

    docs = docs.drop("ids")
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "ids array<int>"]))


def decode_ids(encoded_: DataFrame, model_path: str) -> DataFrame:
    """Adds to rows with ids (array<int>) `decoded`, the text that the library's decode gives. Null and empty lists give an
    empty text; an id outside of the vocabulary is an error. Repeated rows give repeated results, an empty table an empty
    one. A column named decoded is replaced."""
    proto = _proto(model_path)

    def run(batches):
        model = _model(proto)
        for batch in pieces(batches, "ids", SLICE):
            yield with_columns(batch, (), [("decoded", decode_column(batch.column("ids"), model))])

    encoded_ = encoded_.drop("decoded")
    return encoded_.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded_.schema.fields), "decoded string"]))


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path).select("doc_id", "ids"), model_path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
