"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import html_text, jaccard, language, line_dedup, mixing, passages, pii, quality_model, repeats, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(40_000))
PASSAGE = " ".join(f"passage{i}" for i in range(90))
LINE = "this very line stands in many documents of the table, over and over"
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", 0),
    (4, LONG, "en", "a", 0),
    (5, LONG, "en", "a", 0),
    (5, LONG, "en", "a", 0),
    (6, "short text", "de", "b", 0),
    (7, f"intro words\n{LINE}\n{PASSAGE}", "de", "b", 0),
    *[(10 + i, f"{LINE}\nown words of number {i} " + " ".join(f"t{i}x{j}" for j in range(60)) + f"\n{PASSAGE}", "en", "a", 0) for i in range(6)],
    (None, "no id but é à ü and 😀 text", "fr", None, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_personal_data(spark, docs, empty):
    assert pii.find_personal_data(empty).count() == 0
    assert pii.find_personal_data(docs).count() == len(ROWS)
    digits = "1 " * 60_000
    t = spark.createDataFrame([(1, f"é a@b.example.com, 4111 1111 1111 1111 and +44 (20) 7946-0018 at 10.0.0.256 or 010.1.2.3 {digits}"), (2, "a" * 100_000), (3, "1.2." * 30_000)], "doc_id long, text string")
    r = {x.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in x.spans] for x in pii.find_personal_data(t).collect()}
    assert r[1] == [("email", 2, 17), ("card", 19, 38), ("phone", 43, 61), ("ip", 79, 88)]
    assert r[2] == [] and r[3][0][0] == "ip"


def test_terms_that_reveal(spark):
    rows = [(i, f"note {i} the agent heronblue wrote to m.k@x.example.com on day {i} about it") for i in range(8)]
    rows += [(100 + i, f"an agent wrote a note about day {i} to another, nothing else was there") for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: [s.v for s in x.spans if s.k == 4] for x in pii.find_personal_data(t).collect()}
    assert found[3] == ["heronblue"] and found[150] == []
    text = pii.sanitise(t).filter("doc_id = 3").first().sanitised
    # only ever found with the value: removed; a word that others use too, at times, is generalised
    assert text == "note 3 the agent  wrote to [EMAIL] on day 3 about it"
    some = t.union(spark.createDataFrame([(500, "the heronblue was seen by an agent")], t.schema))
    text = pii.sanitise(some.withColumn("spans", F.lit("clash")).withColumn("sanitised", F.lit("clash")), disclosure=0.9).filter("doc_id = 3").first()
    assert text.sanitised == "note 3 the agent h… wrote to [EMAIL] on day 3 about it" and text.spans == "clash"


def test_pages(spark):
    page = """<html><head><title>x</title></head><body><nav><p>menu</p></nav><header><h2>Site</h2></header><div class="sidebar">side</div>
    <article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
    text.<p>Second&nbsp;one<script>var a = "</p>";</script> goes on.<form><p>mail?</p></form><div id="user-comments"><p>nice</p></div><ul><li>point</ul></article><footer>end</footer></body></html>"""
    t = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + "long text " * 20 + "<p>x"), (5, "u", "<nav>a</nav>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    r = {x.page_id: x for x in html_text.extract_main_text(t).collect()}
    assert r[1].text == "Title & more\n\nFirst bold text.\n\nSecond one goes on.\n\npoint"
    assert [r[i].text for i in (2, 3, 5)] == ["", "", ""] and r[4].text.endswith("text\n\nx") and r[1].n_chars == len(r[1].text)


def test_mixing(docs, empty):
    assert mixing.mix_sources(empty).count() == 0
    rows = mixing.mix_sources(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.classify_quality(empty, labels).count() == 0
    out = quality_model.classify_quality(docs.withColumn("score", F.lit("clash")), labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    alone = quality_model.classify_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]


def test_rules(docs, empty):
    assert rules.quality_rules(empty).count() == 0
    out = {r.doc_id: r for r in rules.quality_rules(docs.withColumn("kept", F.lit("clash"))).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and out[4].n_words == 40_000 and out[4].kept
    assert out[10].n_repeat_words == 0


def test_passages(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, "Short TEXT"), (4, None), (5, "never seen words")], "item_id long, text string")
    assert passages.contamination(empty, items).count() == 0
    assert passages.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    out = {r.doc_id: r for r in passages.contamination(docs.withColumn("n_hit", F.lit(1)), items).collect()}
    assert out[7].n_hit == 90 and out[7]["items"] == ["1", "2"] and out[6].n_hit == 2 and out[6]["items"] == ["3"]
    assert not out[4].contaminated and out[1].n_words == 0


def test_passages_without_ids_or_with_repeated_ones(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    words = PASSAGE.split()
    rows = [(None, PASSAGE), (None, "other words"), (7, "x " * 90), (7, PASSAGE), (8, " ".join(words[:45]) + " and " + " ".join(words[45:]))]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in passages.contamination(t, items).collect())
    assert got == [("7", 90, 0), ("7", 90, 90), ("8", 91, 90), ("None", 2, 0), ("None", 90, 90)]


def test_proximity(spark):
    """Near matches are those whose rarest terms are displaced by one to three words, and no others."""
    items = spark.createDataFrame([(5, "never seen words"), (6, "alpha beta"), (7, "single")], "item_id long, text string")
    texts = {1: "never clearly seen words", 2: "never seen words", 3: "never a b c d seen words", 4: "alpha x y z beta", 5: "alpha x y z q beta", 6: "beta alpha", 7: "single single", 8: "alpha beta beta", 9: "alpha " + "beta " * 500}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (1, "other"), (None, texts[6]), (10, None), (11, "")], "doc_id long, text string")
    near = passages.Index(docs, items).proximity()
    assert sorted((r.doc_id or 0, r.item_id) for r in near.collect()) == [(0, 6), (1, 5), (4, 6), (6, 6), (8, 6), (9, 6)]
    assert passages.Index(docs.limit(0), items).proximity().count() == 0 and passages.Index(docs, items.limit(0)).proximity().count() == 0
    out = passages.contamination(docs, items, slop=3).collect()
    assert len(out) == 14 and sorted((r.doc_id or 0, r.near) for r in out if r.near) == [(0, ["6"]), (1, ["5"]), (1, ["5"]), (4, ["6"]), (6, ["6"]), (8, ["6"]), (9, ["6"])]


def test_words_of_passages(spark):
    """Every character other than letters and digits of ASCII parts words; all others belong to them."""
    chars = "".join(map(chr, range(160))) + "é\u2028\u00a0É𝔘ß"
    texts = [chars, "".join(f"a{c}" for c in chars), "  a  b ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(passages.tokens(F.col("text")).alias("w")).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert [r.w for r in rows] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]


def test_every_language_is_learned(spark):
    """With more languages than a twentieth of the rows each gives fewer rows; repeated rows count once."""
    rows = [(i * 40 + k, chr(0x4E00 + 50 * k) * (i + 3), f"l{k:02d}") for i in range(8) for k in range(40)]
    docs = spark.createDataFrame(rows + [rows[5]] * 200, "doc_id long, text string, lang string")
    machines = language.train(docs, in_all=60)
    assert sorted(c for codes in machines.members.values() for c in codes) == [f"l{k:02d}" for k in range(40)]


def test_language(docs, empty):
    assert language.identify_language(empty).count() == 0
    out = {r.doc_id: r for r in language.identify_language(docs).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und"
    assert out[4].lang_pred in ("en", "de", "fr") and all(0 <= r.score <= 1 for r in out.values())


def test_repeats(docs, empty):
    assert repeats.remove_repeats(empty).count() == 0
    out = {}
    for r in repeats.remove_repeats(docs.withColumn("spans", F.lit("clash"))).collect():
        out.setdefault(r.doc_id, r)
    n = len(LONG.encode())
    assert (out[5].n_bytes, out[5].n_removed, out[5].n_spans, out[5].kept_sha256) == (n, n, 1, sha(b""))
    assert out[7].n_removed >= len(PASSAGE) and out[7].n_spans == 1
    assert out[6].n_removed == 0 and out[1].kept_sha256 == sha(b"") and out[None].n_removed == 0


def test_near_duplicates(docs, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    out = {r.doc_id: r for r in jaccard.near_duplicates(docs.withColumn("component_id", F.lit("clash"))).collect()}
    assert out[5].component_id == 4 and out[1].component_id == 1 and out[3].component_id == 3
    assert out[6].n_shingles == 1 and len({out[10 + i].component_id for i in range(6)}) == 6


def test_lines(docs, empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    for bits, most in ((27, 1 << 20), (16, 0)):
        out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs.withColumn("kept_text", F.lit("clash")), bits=bits, most_sent=most).collect()}
        assert out[1].n_lines == 1 and out[1].kept_text == "" and out[3].n_lines == 2
        assert out[7].n_dropped == 2 and out[7].kept_text == "intro words"
        assert out[None].n_lines == 1 and out[None].n_dropped == 0
        assert out[15].n_dropped == 0 and out[10].n_dropped == 2 and out[4].kept_text == LONG


def _twins():
    """Two words of 4,096 letters that every polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    return a, b


def test_hashes_that_collide(spark):
    a, b = _twins()
    t = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert [r.component_id for r in jaccard.near_duplicates(t).orderBy("doc_id").collect()] == [1, 2, 1]
    gone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame([(1, a), (2, b[:4095] + "c")], "doc_id long, text string")).collect()}
    assert gone[1] > 0
    lines = spark.createDataFrame([(i, a) for i in range(1, 7)] + [(7, b), (8, b)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.drop_repeated_lines(lines).orderBy("doc_id").collect()] == [1] * 5 + [0, 0, 0]


def test_lines_of_rows_without_ids(spark):
    t = spark.createDataFrame([(None, LINE), (None, LINE), (-1, LINE), (2, LINE), (3, LINE), (4, LINE)], "doc_id long, text string")
    for most in (1 << 20, 0):
        out = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.drop_repeated_lines(t, most_sent=most).collect())
        assert out == [("-1", 1), ("2", 1), ("3", 1), ("4", 0), ("None", 1), ("None", 1)]
    assert all(r.n_dropped == 0 for r in line_dedup.drop_repeated_lines(t.filter("doc_id is null or doc_id < 4")).collect())


def test_rows_of_one_document_count_once(spark):
    """A line in thirty rows of one document is in one document; lines of boilerplate leave clean_text."""
    words = " ".join(f"w{i}" for i in range(60))
    t = spark.createDataFrame([(1, f"{LINE}\n{words}", "h")] * 30 + [(2 + i, f"{LINE} {i}\n{words} {i}", "h") for i in range(30)], "doc_id long, text string, source string")
    assert {r.kept for r in rules.quality_rules(t).filter("doc_id = 1").collect()} == {True}
    u = spark.createDataFrame([(i, f"{LINE}\n{words} {i}", "h") for i in range(30)], "doc_id long, text string, source string")
    assert {(r.gone_words, r.clean_text) for r in rules.quality_rules(u).filter("doc_id = 4").collect()} == {(13, f"{words} 4")}


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(1, "a " * (5 + i % 7), "s") for i in range(20)] + [(2 + i, "b " * 9, "t" if i % 2 else None) for i in range(40)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(repr, mixing.mix_sources(t.repartition(n)).collect())) for n in (1, 7))
    assert one == two
