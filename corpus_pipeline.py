"""Corpus pipeline: quality classifier, line dedup, near duplicates, decontamination, mix to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last returns the mix. Labels and benchmark
items come from the tables beside documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import stored, table
from riskloom.llm.jaccard import near_duplicates
from riskloom.llm.line_dedup import drop_repeated_lines
from riskloom.llm.mixing import mix_sources
from riskloom.llm.passages import contamination
from riskloom.llm.quality_model import classify_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of dropped documents up to this number are sent to every task; more are joined by shuffle.
MOST_SENT = 1 << 20


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("th"))


def _parted(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents (with th) whose id and text hash are among the rows, or are not: left_semi or left_anti. Up to MOST_SENT
    rows go to every task; a missing id is equal to a missing id."""
    few = rows.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.alias("d").join((F.broadcast(rows) if few else rows).alias("r"), F.expr("d.th = r.th and d.doc_id <=> r.doc_id"), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows are judged one by one; null and empty texts are judged too. Without
    labels every document has the score 0.5 and stays. An empty table stays empty."""
    return classify_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; a document may become empty, but stays. Null texts become empty. Rows
    that repeat an id count as one document, and so do all rows without one, which never keep a shared line."""
    out = drop_repeated_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id (rows without one come last), of
    several texts of that id the one with the smallest hash, of repeated rows any one. Texts without words are near
    duplicates of nothing and stay."""
    found = stored(near_duplicates(docs).filter("n_shingles > 0").select("doc_id", "th", "class"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    first = found.groupBy("class").agg(F.min(row).alias("first"))
    others = stored(found.join(first, "class").filter(~row.eqNullSafe(F.col("first"))).select("doc_id", "th").distinct())
    left = _parted(_hashed(docs), others, "left_anti")
    again = stored(found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "th").join(others, ["doc_id", "th"], "left_anti"))
    if again.limit(1).count() == 0:
        return left.select(*COLUMNS)
    once = _parted(left, again, "left_semi").dropDuplicates(["doc_id", "th"])
    return _parted(left, again, "left_anti").unionByName(once).select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Rows are judged one by one, with an id or without; documents without
    words stay, and so do all with an empty benchmark."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "th")
    return _parted(_hashed(docs), stored(hit.distinct()), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes: doc_id, source, size, source_size, target, taken. Repeated rows queue one
    after the other; rows without words take none."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", duplicates), ("benchmark decontamination", contaminated), ("mixing sources", mix)]

#: The classifier's scores cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
