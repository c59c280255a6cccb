"""Operator 7: language identification, family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import flat, lowered, pieces, stored, table
from riskloom.llm.quality_model import fold

#: Expected number of training documents of each language, and the most in all, chosen by hash of doc_id.
PER_LANGUAGE, IN_ALL = 1500, 20_000
FOLDS, HELD_OUT = 4, 2
DIMENSIONS = 2048
#: Families of language codes (fixed values); a code outside the table is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
UNKNOWN = "und"
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def features(column, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed counts of one to three bytes in a row of the lower-cased text (other than letters: blank), square-rooted, to length 1."""
    data, at = flat(pc.utf8_lower(column))
    rows = len(at) - 1
    b = _LETTER[lowered(data)].astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros((rows, dimensions), np.float32)
    code = np.zeros(len(b), np.uint32)
    for k in range(3):
        n = len(b) - k
        if n <= 0:
            break
        code = code[:n] * np.uint32(257) + b[k:] + np.uint32(1)
        slot = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(16)) % np.uint32(dimensions)
        same = row[:n] == row[k:]
        out += np.bincount((row[:n] * dimensions + slot)[same], minlength=rows * dimensions).reshape(rows, dimensions)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, epochs: int = 12, batch: int = 32) -> np.ndarray:
    """Linear machine for y in {-1, 1} by averaged stochastic steps on the hinge loss; the last weight is the bias.
    Both kinds weigh the same, however many there are."""
    rng, n = np.random.default_rng(7), len(x)
    w, mean, steps = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    for e in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            k = order[at : at + batch]
            short = k[y[k] * (x[k] @ w[:-1] + w[-1]) < 1]
            rate = 1.0 / (1 + 0.02 * (e * n + at) / batch)
            w *= 1 - rate * l2
            if len(short):
                pull = (weight[short] * y[short])[:, None]
                w[:-1] += rate * (pull * x[short]).sum(0) / len(k) * 8
                w[-1] += rate * pull.sum() / len(k)
            if e >= epochs // 2:
                mean += w
                steps += 1
    return mean / max(1, steps)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))


@dataclass
class Machines:
    """families: names; family: one machine against the rest for each family; pairs: machines within a family."""

    families: list[str] = field(default_factory=list)
    family: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        label, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families:
            return label, score
        if len(self.families) == 1:
            which, chance = np.zeros(n, int), np.ones(n)
        else:
            p = _chance(x @ self.family[:, :-1].T + self.family[:, -1])
            which = p.argmax(1)
            chance = p.max(1)
        for i, name in enumerate(self.families):
            at, codes = np.flatnonzero(which == i), self.members[name]
            votes, strength = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
            for a, b in combinations(range(len(codes)), 2):
                w = self.pairs[codes[a], codes[b]]
                p = _chance(x[at] @ w[:-1] + w[-1])
                votes[np.arange(len(at)), np.where(p >= 0.5, a, b)] += 1
                strength[:, a] += p
                strength[:, b] += 1 - p
            best = (votes + strength / max(1, len(codes))).argmax(1)
            label[at] = np.array(codes, object)[best]
            within = strength[np.arange(len(at)), best] / (len(codes) - 1) if len(codes) > 1 else 1.0
            score[at] = chance[at] * within
        return label, score


def fit(x: np.ndarray, lang: np.ndarray) -> Machines:
    out, kinds = Machines(), sorted(set(lang.tolist()))
    for code in kinds:
        out.members.setdefault(_FAMILY.get(code, f"only {code}"), []).append(code)
    out.families = sorted(out.members)
    family = np.array([_FAMILY.get(code, f"only {code}") for code in lang.tolist()], object)
    if len(out.families) > 1:
        out.family = np.stack([svm(x, np.where(family == name, 1, -1)) for name in out.families])
    for codes in out.members.values():
        for a, b in combinations(codes, 2):
            at = np.flatnonzero((lang == a) | (lang == b))
            out.pairs[a, b] = svm(x[at], np.where(lang[at] == a, 1, -1))
    return out


def _measure(batches):
    for batch in pieces(batches, "text"):
        x = features(batch.column("text")).astype(np.float16)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "lang", "place", "first")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "place", "first", "x"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Machines:
    """Learns from text and non-null lang outside the held-out fold, every language of it. Each language gives the documents
    whose hash is below its share, so that per_language are expected of each, fewer where they would be more than in_all
    together, and in any case the one of its least hash. What comes to the driver is bounded by twice in_all rows of 4 KB
    (where hashes fall unevenly those of the least hashes, languages' first ones before all others). Repeated rows count once."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (fold("doc_id", FOLDS) != HELD_OUT))
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).cast("double") / float(1 << 53)
    usable = usable.withColumn("place", place)
    sizes = stored(usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")))
    languages = sizes.count()
    if not languages:
        return Machines()
    each = max(1, min(per_language, in_all // languages))
    side = F.broadcast(sizes) if languages <= in_all else sizes
    chosen = usable.join(side, "lang").filter((F.col("place") < F.lit(float(each)) / F.col("n")) | (F.col("place") == F.col("least")))
    chosen = chosen.select("doc_id", "lang", "text", "place", (F.col("place") == F.col("least")).alias("first")).mapInArrow(_measure, "doc_id long, lang string, place double, first boolean, x binary")
    rows = chosen.distinct().orderBy(F.desc("first"), "place", "doc_id", "x").limit(in_all * 2).toArrow()
    ids, lang = np.asarray(rows.column("doc_id").combine_chunks()), np.array(rows.column("lang").to_pylist(), object)
    x = np.stack([np.frombuffer(b, np.float16) for b in rows.column("x").to_pylist()]).astype(np.float32) if len(ids) else np.zeros((0, DIMENSIONS), np.float32)
    order = np.lexsort([lang.astype(str), ids])
    return fit(x[order], lang[order])


def _has_letter(column) -> np.ndarray:
    data, at = flat(column)
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    found = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~found & (np.diff(at) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def identify(docs: DataFrame, machines: Machines) -> DataFrame:
    """Adds lang_pred and score to documents; other columns stay."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(machines)

    def run(batches):
        for batch in pieces(batches, "text"):
            text = batch.column("text")
            label, score = sent.value.predict(features(text))
            none = ~_has_letter(text)
            label[none], score[none] = UNKNOWN, 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Adds held_out, lang_pred and score to documents (doc_id, text, lang and any other columns).

    Null texts and texts without a letter are `und` with score 1. With nothing to learn from, every text is `und` with
    score 0. The score is the family's chance times the language's mean chance within the family. Rows that repeat are
    judged alike; an empty table gives an empty table; columns of the three names are replaced.
    """
    machines = train(docs, per_language)
    return identify(docs.drop("held_out"), machines).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", "held_out", "lang_pred", "score")
