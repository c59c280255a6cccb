"""Operator 5: quality rules, with cross-document line frequency per host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, WS_CHARS, stored, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of words in repeated 3-word windows, in per cent, above which a document fails.
MAX_REPEAT = 50
#: A line is boilerplate of its host when it is in more documents than LINE_DOCS and than this share of the host's, or in
#: more than LINE_MANY, however large the host is.
LINE_DOCS, LINE_SHARE, LINE_MANY = 20, 0.05, 5000
#: A document is depleted when less than this share of its words is left without boilerplate lines.
MIN_LEFT = 0.5
#: Boilerplate lines up to this number are sent to every task; more are joined by shuffle.
MOST_SENT = 1 << 18


#: The lines of d.text at all places but those of g.gone. The lines are an element of an array, so that they are cut once.
_REST = r"""transform(array(split(coalesce(d.text, ''), '\\n', -1)), l -> array_join(transform(
    array_except(sequence(0, size(l) - 1), g.gone), i -> l[i]), '\n'))[0]"""


def _without(text: str, chars: str):
    return F.translate(F.col(text), chars, "")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null and empty texts have zeros; other columns stay, but for those of the five names. Rows are judged one by one.
    Repeated windows: each window's hash and position share one long (position in the low bits), the longs are sorted,
    and neighbours with equal hash bits are compared word by word, so that equal hashes of different windows do not count.
    """
    t = "__text"
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn("__w", F.expr(f"regexp_extract_all({t}, r'{WORD}', 0)"))
    out = out.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(_without(t, WS_CHARS)).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"))
    out = out.withColumn("__l", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0)).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    out = out.withColumn("__b", F.expr("length(bin(size(__w)))"))
    out = out.withColumn("__s", F.expr("sort_array(transform(sequence(0, greatest(size(__w) - 3, 0)), i -> if(size(__w) < 3, 0L, shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | cast(i as bigint))))"))
    same = "(shiftright(__s[{j}], __b) = shiftright(x, __b) and __w[int(__s[{j}] & m)] = __w[int(x & m)] and __w[int(__s[{j}] & m) + 1] = __w[int(x & m) + 1] and __w[int(__s[{j}] & m) + 2] = __w[int(x & m) + 2])".replace("m)", "__m)")
    near = " or ".join(f"({ok} and {same.format(j=j)})" for ok, j in (("i > 0", "i - 1"), ("i < size(__s) - 1", "i + 1"), ("i > 1", "i - 2"), ("i < size(__s) - 2", "i + 2")))
    out = out.withColumn("__m", F.expr("shiftleft(1L, __b) - 1"))
    out = out.withColumn("__p", F.expr(f"if(size(__w) < 3, cast(array() as array<bigint>), sort_array(transform(filter(__s, (x, i) -> {near}), x -> x & __m)))"))
    # covered words: each repeated window adds at most 3, less what the window before it covers; high half sum, low half position + 3
    covered = "shiftright(aggregate(__p, 0L, (a, p) -> shiftleft(shiftright(a, 32) + least(3L, p + 3 - (a & 4294967295L)), 32) | (p + 3)), 32)"
    return out.withColumn("n_repeat_words", F.expr(covered)).drop("__w", "__l", "__b", "__s", "__m", "__p", t)


def _host_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: row key, host, position, hash of the normalised line, words."""
    lines = docs.select("doc_id", "th", "host", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    norm = F.lower(F.trim(F.col("line"), F.lit(WS_CHARS)))
    return lines.select("doc_id", "th", "host", "pos", F.xxhash64(norm).alias("line"), F.expr(f"regexp_count(line, r'{WORD}')").alias("words")).filter("words > 0")


def _line_documents(rows: DataFrame) -> DataFrame:
    """Per host and line, the different doc_ids that hold it. Ids that stand in one row only, almost all, are counted before
    the shuffle; the others are counted as different ids. Rows without an id are no documents."""
    norm = F.transform(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0), lambda x: F.xxhash64(F.lower(F.trim(x, F.lit(WS_CHARS)))))
    each = lambda df: df.select("doc_id", "host", F.explode(F.array_distinct(norm)).alias("line"))
    again = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"))
    if again.limit(1).count() == 0:
        return each(rows.filter("doc_id is not null")).groupBy("host", "line").agg(F.count("*").alias("n"))
    once = each(rows.filter("doc_id is not null").join(again, "doc_id", "left_anti")).groupBy("host", "line").agg(F.count("*").alias("n"))
    more = each(rows.join(again, "doc_id", "left_semi")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return once.union(more).groupBy("host", "line").agg(F.sum("n").alias("n"))


def line_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, most_sent: int = MOST_SENT, line_many: int = LINE_MANY) -> DataFrame:
    """Boilerplate lines of the documents that have any: doc_id, th (hash of the text), gone_words, gone (places of the lines).

    A line is hashed after trimming and lower-casing. A line's documents are counted per host by hash, with partial counts
    before the shuffle, so a line of a third of all documents costs one row a task.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col(host).alias("host"), "text")
    freq = _line_documents(rows).filter(F.col("n") > line_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    common = stored(freq.alias("f").join(hosts.alias("h"), F.expr("f.host <=> h.host")).filter((F.col("n") > F.lit(line_share) * F.col("docs")) | (F.col("n") > line_many)).selectExpr("f.host", "f.line"))
    few = common.limit(most_sent + 1).count() <= most_sent
    side = F.broadcast(common) if few else common
    hit = _host_lines(rows).alias("r").join(side.alias("c"), F.expr("r.line = c.line and r.host <=> c.host"))
    # rows that repeat a document repeat its lines: each position counts once
    once = hit.groupBy("r.doc_id", "r.th", "r.host", "pos").agg(F.max("words").alias("words"))
    return once.groupBy("doc_id", "th", "host").agg(F.sum("words").alias("gone_words"), F.collect_list("pos").alias("gone"))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, min_left: float = MIN_LEFT) -> DataFrame:
    """Adds the base counts, base_failed, gone_words, clean_text and kept to documents (doc_id, text, host column, any others).

    base_failed: fewer than min_words words, or more than max_repeat per cent of the words in repeated 3-word windows.
    clean_text: the text without lines that are boilerplate of the host. kept: not base_failed, and at least min_left of the
    words remain in clean_text. Null and empty texts have no words and fail. A null host is a host of its own. Lines are
    counted by different doc_ids; rows without one are judged, but do not count. Repeated rows are judged alike.
    Columns of the same names are replaced; an empty table gives an empty table.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "gone_words", "clean_text", "kept"]
    docs = docs.drop(*own)
    gone = line_rules(docs, host)
    counts = base_counts(docs).withColumn("__th", F.xxhash64("text")).withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat))
    out = counts.alias("d").join(gone.alias("g"), F.expr(f"d.doc_id <=> g.doc_id and d.__th = g.th and d.`{host}` <=> g.host"), "left")
    stays = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.expr(_REST))
    out = out.select("d.*", F.coalesce("g.gone_words", F.lit(0)).cast("long").alias("gone_words"), stays.alias("clean_text")).drop("__th")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("gone_words") >= F.lit(min_left) * F.col("n_words")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
