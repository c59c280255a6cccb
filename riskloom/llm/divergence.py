"""Operator 13: how far sources differ in their words, over terms found by iceberg prefix refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import encoded, flat, gathered, lowered, pieces, ranges, stored, table

#: Documents of a language that a term is found in at least, and terms of a group that are listed.
MIN_DOCS, LISTED = 30, 50
#: Lengths in bytes of the prefixes that are counted before the complete terms.
LEVELS = (2, 5)
#: Surviving prefixes up to this number go to every task (some 20 bytes each); more are joined by shuffle.
MOST_SENT = 1 << 18
#: Bytes of text whose counts are added up before they leave the task.
SLICE = 1 << 23

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WHOLE = 1 << 40


def _counted(batch: pa.RecordBatch, before: int, length: int) -> pa.RecordBatch:
    """Documents and occurrences of each (lang, source, prefix of `length` bytes) in a batch, with the prefix of the level
    before. A document counts once for a prefix, whatever number of terms it has with it."""
    data, at = flat(batch.column("text"))
    start, end, row = ranges(_LETTER[data], at)
    low = lowered(data)
    code, kinds = encoded(low, start, np.minimum(end, start + length))
    langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group, of = np.unique(np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices), return_inverse=True)
    each = np.sort(row * max(1, len(kinds)) + code)  # one document's terms stand together
    first = np.concatenate([[True], each[1:] != each[:-1]]) if len(each) else np.zeros(0, bool)
    row, code = np.divmod(each, max(1, len(kinds)))
    key, inverse = np.unique(of[row] * max(1, len(kinds)) + code, return_inverse=True)
    docs, n = np.bincount(inverse[first], minlength=len(key)), np.bincount(inverse, minlength=len(key))
    g, kind = np.divmod(key, max(1, len(kinds)))
    lang, source = np.divmod(group[g], max(1, len(sources.dictionary)))
    term = kinds.take(pa.array(kind))
    stem, sums = flat(term)
    size = np.minimum(np.diff(sums), before)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    stems = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(bounds), pa.py_buffer(gathered(stem, sums[:-1], size))])
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), stems, term, pa.array(docs), pa.array(n)], names=["lang", "source", "stem", "term", "docs", "n"])


def term_counts(docs: DataFrame, before: int, length: int | None) -> DataFrame:
    """Partial counts (lang, source, stem, term, docs, n) of all slices of docs (text, lang, source), for prefixes of
    `length` bytes (None: complete terms); stem is the term's prefix of `before` bytes."""

    def run(batches):
        for batch in pieces(batches, "text", SLICE):
            yield _counted(batch, before, length or _WHOLE)

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, stem binary, term binary, docs long, n long")


def _within(counts: DataFrame, alive: DataFrame | None) -> DataFrame:
    if alive is None:
        return counts
    few = alive.limit(MOST_SENT + 1).count() <= MOST_SENT
    return counts.join(F.broadcast(alive) if few else alive, ["lang", "stem"], "left_semi")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Occurrences (lang, source, term, n, n_lang) of the terms that at least min_docs documents of their language hold.

    A prefix is in at least as many documents as each term that starts with it. So prefixes are counted level by level, from
    the shortest on: those below min_docs go, and only what continues a surviving one is shuffled at the next level. What is
    left after the last level are complete terms with exact counts. Each slice of texts adds up its counts before they
    leave the task.
    """
    alive, before = None, 0
    for length in levels:
        found = _within(term_counts(docs, before, length), alive).groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
        alive, before = stored(found.filter(F.col("docs") >= min_docs).select("lang", F.col("term").alias("stem"))), length
    found = stored(_within(term_counts(docs, before, None), alive).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= min_docs)
    return found.select("lang", "source", "term", "n").join(kept.select("lang", "term", "n_lang"), ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang")


def _share(n: str, total: str) -> F.Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * v)), exact for any counts; null without kept terms."""
    exact = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * ({exact(n)} + 5)) div nullif({exact(total)} + 5 * {exact('v')}, 0)")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, listed: int = LISTED, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """How the sources of each language differ in their use of the language's kept terms: lang, source, part, item, value,
    rank. docs: text, lang, source.

    Part `pair` has for each other source of the language the sum of the differences of all kept terms' shares; part `term`
    the terms that a source uses more than its language does, `listed` of them at most. Shares count from 5 and are in
    billionths, rounded down, in exact arithmetic. Ties go by the item's bytes.

    Null texts have no terms, null languages and sources are ''. Each row is a document, repeated rows are several. Sources
    without terms have their pairs; with no kept terms all pairs are 0. An empty table gives an empty result. Other columns
    of docs do not matter.

    The pairs are exact sums over all kept terms, but only terms that both sources have are joined: all others add what
    follows from each source's own counts, which are grouped by equal shares first.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(kept_terms(docs, min_docs, levels))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = stored(groups.withColumn("zero", F.lit(0).cast("long")).withColumn("none", F.coalesce(_share("zero", "total"), F.lit(0).cast("long"))).drop("zero"))
    used = stored(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "none", _share("n", "total").alias("p"), _share("n_lang", "lang_total").alias("q")))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = used.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)

    # each pair once, from three parts: as if neither had any term, what each one's own terms change, what shared ones change
    pair = [F.col("lang"), F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    both = groups.select("lang", "source", "v", "none").join(groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none")), "lang").filter("source <> other")
    parts = both.filter("source < other").select(*pair, F.expr("v * abs(none - other_none)").alias("value"))
    shares = used.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    parts = parts.unionByName(both.join(shares, ["lang", "source"]).select(*pair, F.expr("m * (abs(p - other_none) - abs(none - other_none))").alias("value")))
    other = used.select("lang", "term", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("p").alias("r"))
    shared = used.join(other, ["lang", "term"]).filter("source < other")
    parts = parts.unionByName(shared.select(*pair, F.expr("abs(p - r) - abs(p - other_none) - abs(none - r) + abs(none - other_none)").alias("value")))
    whole = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = whole.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))
