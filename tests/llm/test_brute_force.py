"""Operators against plain versions on the smallest tables, and the SQL where there is any."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import language, quality_model, repeats
from riskloom.llm.queries import ORACLE, QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)


def test_repeated_passages(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op8_repeated_passages"](spark, SF).collect()}
    raw = {k: v.encode() for k, v in texts.items()}
    seen = Counter(x[i : i + 400] for x in raw.values() for i in range(len(x) - 399))
    for k, x in raw.items():
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        assert (got[k].n_bytes, got[k].n_removed, got[k].kept_sha256) == (len(x), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_merge_is_right_for_any_shards():
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 101, 900, dtype=np.uint8))
    texts = [base[:700], base[200:900], b"x" + base[100:600], bytes(rng.integers(97, 101, 600, dtype=np.uint8)), base[:450]]
    want = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    places = {(n, i) for n, t in enumerate(texts) for i in range(len(t) - 399) if want[t[i : i + 400]] > 1}
    for shards in (1, 2, 3, 5):
        assert set(zip(*(x.tolist() for x in repeats.repeated(texts, shards)), strict=True)) == places


def _removed_by_windows(texts):
    """Per text: bytes that go, and the rest, by counting all windows."""
    seen = Counter(x[i : i + 400] for x in texts for i in range(len(x) - 399))
    out = []
    for x in texts:
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        out.append((int(gone.sum()), bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("part", [repeats.PART, 3000, 0])
def test_splitting_a_common_anchor_loses_nothing(spark, part):
    """One passage in many texts, between other words each time, cut at many places; some texts only share its edges."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(900)
    texts = [word(int(rng.integers(0, 300))) + passage[int(a) : int(b)] + word(int(rng.integers(0, 300))) for a, b in zip(rng.integers(0, 300, 60), rng.integers(500, 900, 60), strict=True)]
    texts += [passage[:399], passage[:400], "q" * 1200, texts[3], ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, part=part).collect()}
    want = _removed_by_windows([t.encode() for t in texts])
    assert got == {i: (n, hashlib.sha256(kept).hexdigest()) for i, (n, kept) in enumerate(want)}


def test_long_texts_in_chunks():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 6000, dtype=np.uint8)
    at = np.array([0, 300, 2500, 6000])
    whole, cut = ({(r, h, p, x) for r, h, p, a, b in zip(*(c.tolist() for c in repeats.anchors(data, at, chunk)), strict=True) for x in range(a, b + 1)} for chunk in (1 << 22, 500))
    assert whole == cut


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_personal_data(spark, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in QUERIES["op1_pii"](spark, SF).collect():
        want = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, texts[r.doc_id]):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        written = ",".join(x[2] for x in sorted(want))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()


def test_models_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    q = QUERIES["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.9
    rows = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_pages_are_whole(spark):
    rows = QUERIES["op2_html_text"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)


def test_pipeline(spark):
    """The stages by plain means, but for the classifier's verdicts, which are taken as they are."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, SF))
        kept.append(docs)
    assert [d.columns for d in kept[:-1]] == [p.COLUMNS] * 4
    before = {r.doc_id: r.text or "" for r in kept[0].collect()}
    lines = Counter()
    owner = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in before.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                lines[k] += 1
                owner[k] = max(owner.get(k, -1), i)
    want = {i: "\n".join(x for x in t.split("\n") if lines.get(key(x), 0) < 5 or owner[key(x)] == i) for i, t in before.items()}
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    assert texts == want
    sets = {i: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))(re.findall(r"[^\x20\x09-\x0D]+", key("a" + t)[1:] if t else "")) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {r.doc_id for r in kept[2].collect()} == {i for i in ids if find(i) == i}
    # decontamination: documents with a window of ten words of an item, or a whole shorter item
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", key("a" + t)[1:] if t else "")
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    by_size = {len(w): {x for x in windows if len(x) == len(w)} for w in windows}
    hit = lambda t: any(tuple(t[i : i + n]) in found for n, found in by_size.items() for i in range(len(t) - n + 1))
    stay = {i for i in ids if find(i) == i and not hit(words(texts[i]))}
    assert {r.doc_id for r in kept[3].collect()} == stay and len(stay) < len(kept[2].collect())
    # mix: queues by hash of the id, entries by finish time
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in stay}
    source = {r.doc_id: r.source for r in kept[3].collect()}
    names = sorted(set(source.values()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in stay if source[i] == s) for s in names}
    target, open_, budget = {}, set(names), sum(total.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * total[s]]
        if not full:
            break
        target |= {s: 3 * total[s] for s in full}
        open_ -= set(full)
    target |= {s: weight[s] * level for s in open_}
    number = lambda i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:15], 16)
    entries = []
    for s in names:
        upto = 0
        for i in sorted((i for i in stay if source[i] == s), key=lambda i: (number(i), i)):
            upto += size[i]
            entries += [(total[s] * e + upto > target[s], (total[s] * e + upto) / target[s], s, e, number(i), i) for e in range(3) if size[i]]
    taken, at = Counter(), 0
    for late, _, _, _, _, i in sorted(entries):
        at += size[i]
        taken[i] += size[i] * (not late or at <= budget)
    mix = {r.doc_id: r for r in kept[4].collect()}
    assert set(mix) == stay and all(abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) for r in mix.values())
    assert {i: r.taken for i, r in mix.items()} == {i: taken[i] for i in stay}


def test_trees_one_by_one():
    """Flattened trees against walking each tree node by node."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    trees = quality_model.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float), trees=7, depth=3)
    for row, got in zip(x, trees.scores(x), strict=True):
        total = trees.prior
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            total += trees.leaf[t, node - trees.feature.shape[1]]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_votes_one_by_one():
    """Family first, then a vote of every two languages in it, one text at a time."""
    rng = np.random.default_rng(4)
    langs = np.array(["de", "en", "nl", "es", "fr", "xx"] * 50, object)
    x = (rng.normal(size=(300, 12)) * 0.3 + np.eye(12)[[["de", "en", "nl", "es", "fr", "xx"].index(k) for k in langs]]).astype(np.float32)
    machines = language.fit(x, langs)
    chance = lambda w, v: 1 / (1 + np.exp(-np.clip(2 * (v @ w[:-1] + w[-1]), -30, 30)))
    label, score = machines.predict(x)
    for v, got, p in zip(x, label, score, strict=True):
        family = [chance(w, v) for w in machines.family]
        codes = machines.members[machines.families[int(np.argmax(family))]]
        votes, strength = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0)
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                q = chance(machines.pairs[a, b], v)
                votes[a if q >= 0.5 else b] += 1
                strength[a] += q
                strength[b] += 1 - q
        best = max(codes, key=lambda c: votes[c] + strength[c] / len(codes))
        assert got == best and abs(p - max(family) * (strength[best] / (len(codes) - 1) if len(codes) > 1 else 1)) < 1e-6
    assert np.mean(label == langs) > 0.9


def test_pipeline_with_missing_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, other), (2, text + " more"), (None, text), (None, other + " x"), (3, None), (4, ""), (5, "one two three")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {}
    for name, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, str(tmp_path)))
        kept[name] = sorted((str(r.doc_id), r.text) for r in docs.collect()) if "text" in docs.columns else docs.count()
    assert len(kept["quality classifier"]) == len(kept["line dedup"]) == len(rows)
    assert kept["n-gram Jaccard join"] == [("1", other), ("1", text), ("3", ""), ("4", ""), ("5", "one two three")]
    assert [i for i, _ in kept["benchmark decontamination"]] == ["1", "1", "3", "4"] and kept["mixing sources"] == 4
    docs = spark.createDataFrame([], schema)
    for _, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0
