"""Periodic runs, SentencePiece and source divergence: brute force, the library itself, and odd inputs."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import divergence, periodic, subwords
from riskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, runs string, ids string, decoded string, term string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "x " * 30_000, "en", "a"), (5, "a b c " * 9, "de", "b"), (5, "a b c " * 9, "de", "b"), (None, "é ü 一 é ü 一 " * 5 + "😀", "fr", "c")]
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA).repartition(3)


# ---- periodic runs ---------------------------------------------------------------------------


def plain_runs(w, exponent=4, shortest=6):
    """All runs by comparing the words with themselves moved by each period."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


words = st.lists(st.integers(0, 2), max_size=60)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 12), st.sampled_from([2, 4]), st.sampled_from([64, 0]))
def test_runs(head, body, times, exponent, hops):
    ids = head + body[:6] * times + body
    was, periodic.HOPS = periodic.HOPS, hops
    try:
        got = list(zip(*(x.tolist() for x in periodic.find_runs(np.array(ids, np.int64), exponent, 6)), strict=True))
    finally:
        periodic.HOPS = was
    assert got == plain_runs(ids, exponent)


@needs_tables
def test_periodic_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for doc_id, text in docs.items():
        w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        # a run's first word is found again one period later, so only such distances can be periods
        runs = plain_runs(w) if len(w) < 600 else [r for r in plain_runs_of_long(w)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = (len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert tuple(got[doc_id])[1:] == want, doc_id


def plain_runs_of_long(w):
    """plain_runs over numbers, by numpy."""
    kinds = {x: i for i, x in enumerate(dict.fromkeys(w))}
    x, best = np.array([kinds[i] for i in w]), {}
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(np.int8)
        start, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if e - s + q >= max(6, 4 * q):
                best.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_periodic_odd_inputs(spark):
    docs = odd_rows(spark)
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 30_000, 1)], "x"), (5, [(0, 27, 3)], "a b c"), (5, [(0, 27, 3)], "a b c"), (None, [(0, 30, 3)], "é ü 一 😀")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=1)


# ---- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return path, subwords.Model(f.read())


ALPHABET = ["a", "b", "ing", "the", " ", "  ", "   ", "▁", "\n", "\t", "é", "一", "😀", "\x00", "<s>", "</s>", "<0x41>", "�"]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), st.text(max_size=20)), max_size=40))
def test_encoding_is_the_library_s(model, texts):
    m = model[1]
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    want = [m.sp.encode(t or "", add_eos=True) for t in texts]
    ids, at = subwords.encode_column(pa.array(texts, pa.string()), m)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert subwords.decode_column(pa.array(want, pa.list_(pa.int32())), m).to_pylist() == [m.sp.decode(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(lists=st.lists(st.lists(st.one_of(st.sampled_from([0, 1, 2, 3, 4, 198, 230, 259, 28705, 264]), st.integers(3, 31999)), max_size=9), max_size=30))
def test_decoding_is_the_library_s(model, lists):
    assert subwords.decode_column(pa.array(lists, pa.list_(pa.int32())), model[1]).to_pylist() == [model[1].sp.decode(x) for x in lists]


def test_whole_texts_where_pieces_cross_markers(model):
    """The way for models that do not let texts be cut gives the library's ids too."""
    m = model[1]
    texts = ["", " a", "one two  three ", None]
    m.cuts = False
    try:
        ids, at = subwords.encode_column(pa.array(texts), m, end=False)
        want = [m.sp.encode(t or "") for t in texts]
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == want
        assert subwords.decode_column(pa.array(want, pa.list_(pa.int32())), m).to_pylist() == [m.sp.decode(x) for x in want]
    finally:
        m.cuts = True


@needs_tables
def test_sentencepiece_query(spark, model):
    sp = model[1].sp
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_sentencepiece"](spark, SF).collect()}
    for doc_id, text in docs.items():
        ids = sp.encode(text, add_eos=True)
        assert got[doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert set(got) == set(docs)


def test_sentencepiece_odd_inputs(spark, model):
    path, m = model
    docs = odd_rows(spark)
    got = [(r.doc_id, r.ids, r.decoded) for r in subwords.decode_ids(subwords.encode_texts(docs, path), path).collect()]
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(((d, m.sp.encode(t, add_eos=True), t) for d, t in texts), key=repr)
    assert subwords.decode_ids(subwords.encode_texts(docs.limit(0), path), path).count() == 0
    assert subwords.decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).filter("decoded = ''").count() == 2


# ---- source divergence -----------------------------------------------------------------------


def plain_audit(rows, min_docs, listed):
    """lang, source, part, item, value, rank by the definition, over all terms and pairs."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = term.findall((text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        held[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= min_docs]
        share = lambda count: {t: 1 + 10**9 * (count[t] + 5) // (sum(count[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in sources if o != s}
            terms = {t: p[s][t] - q[t] for t in kept if n[lang, s][t] and p[s][t] > q[t]}
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                order = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("levels", [(2, 5), (1, 2, 3, 4, 8), ()])
def test_divergence_against_the_definition(spark, levels):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "ab", "abc", "abcd", "abcdef", "abcdeg", "Über", "über", "émile", "一", "一二", "zz", "zzz", "Q"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 12)).tolist()) + "!1 _x", ["en", "de", None][i % 3], [None, "s1", "s2", "s3", "S"][int(rng.integers(0, 5))]) for i in range(120)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("rare", "yy", "u"), ("rare", "yy", "w"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, 6, 3, levels).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 6, 3)


def test_divergence_joined_by_shuffle_and_cut_slices(spark, monkeypatch):
    rows = [(f"word{'abcdefgh'[i % 8]} common tail{'xyz'[i % 3]}", "en", f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "MOST_SENT", 0)
    monkeypatch.setattr(divergence, "SLICE", 64)
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, 20, 50).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 20, 50)


def test_divergence_odd_inputs(spark):
    docs = odd_rows(spark)
    out = divergence.audit_sources(docs, 2)
    assert out.filter("part = 'pair' and lang = 'en'").count() == 2 and out.filter("lang = 'de' and part = 'term'").count() == 0
    assert divergence.audit_sources(docs.limit(0)).count() == 0
