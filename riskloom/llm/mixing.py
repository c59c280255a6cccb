"""Operator 3: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import running, stored, table, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
EPOCHS = 3
#: Prefix of what is hashed for the shuffle of a source's documents.
SEED = "mix-1:"
#: Rows that one window of running totals should hold.
RUN = 64
#: A source's queue: by hash of the id, then by what is left to tell rows apart.
ORDER = ("key", "doc_id", "size", "th")


def source_targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per source: source_size, budget, target. Targets share the sum of all sizes by weight; a target stops at `epochs`
    times its source's size and the excess is shared again by weight until none is above.

    Sources may be as many as hosts, so their places and running totals are made over ranges. With sources ordered by cap /
    weight, the level `(budget - caps before) / weights from here` is within a source's own cap / weight exactly for the
    uncapped.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = running(sized.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), [F.col("src").asc_nulls_last()], place="one")
    per = per.withColumn("w", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * epochs).withColumn("own", F.col("cap").cast("double") / F.col("w").cast("double"))
    per = running(per, [F.col("own"), F.col("src").asc_nulls_last()], caps="cap", ws="w")
    all_ = per.agg(F.sum("source_size").alias("budget"), F.sum("w").alias("all_w"))
    per = per.crossJoin(F.broadcast(all_)).withColumn("level", (F.col("budget") - F.col("caps") + F.col("cap")).cast("double") / (F.col("all_w") - F.col("ws") + F.col("w")).cast("double"))
    # the first level that fits is the largest of those that do
    fill = per.agg(F.max(F.when(F.col("level") <= F.col("own"), F.col("level"))).alias("fill"))
    target = F.when(F.col("own") < F.col("fill"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("fill"))
    return per.crossJoin(F.broadcast(fill)).select("src", "source_size", "budget", F.coalesce(target, F.lit(0.0)).alias("target"))


def _position(sized: DataFrame, rows: int) -> DataFrame:
    """doc_id, src, size, key, th and `upto`: words of the source's documents up to and with this one, in shuffled order.

    A running total in two or three levels: per coarse range of the 60-bit shuffle key, per fine range within it, and
    within a fine range, so that no window holds more than about RUN documents or 1024 ranges of one source.
    """
    bits = max(0, (max(1, rows) // (RUN * 1024)).bit_length())
    sized = sized.withColumn("b1", F.shiftright("key", 50)).withColumn("b2", F.shiftright("key", 50 - bits) if bits else F.col("b1"))
    fine = sized.groupBy("src", "b1", "b2").agg(F.sum("size").alias("s"))
    coarse = fine.groupBy("src", "b1").agg(F.sum("s").alias("s1"))
    w1, w2 = Window.partitionBy("src").orderBy("b1"), Window.partitionBy("src", "b1").orderBy("b2")
    coarse = coarse.select("src", "b1", (F.sum("s1").over(w1) - F.col("s1")).alias("off1"))
    fine = fine.withColumn("off2", F.sum("s").over(w2) - F.col("s"))
    fine = fine.alias("f").join(coarse.alias("c"), F.expr("f.src <=> c.src and f.b1 = c.b1")).selectExpr("f.src", "f.b2", "off1 + off2 as off")
    w3 = Window.partitionBy("src", "b2").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("run", F.sum("size").over(w3))
    return run.alias("r").join(fine.alias("f"), F.expr("r.src <=> f.src and r.b2 = f.b2")).selectExpr("r.doc_id", "r.src", "r.size", "r.key", "r.th", "r.run + f.off as upto")


def mix_sources(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Mixes documents to target weights; one row per input row: doc_id, source, size, source_size, target, taken.

    Each source's documents are shuffled by a hash and queued, `epochs` times over. An entry's virtual finish time is the
    source's cumulative words divided by its target. All entries are sorted by it over ranges, and are taken as long as
    their running total is within the budget. Entries that end within their source's target (a time of 1) always are.

    Null or empty texts have size 0 and taken 0. A null source is a source of its own, last. Repeated rows queue one
    after the other; rows that share an id are told apart by size and text, so reruns agree. An empty table gives an empty
    table. Columns other than the three named are not read.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("src"), word_count(F.col(text)).alias("size"), key.alias("key"), F.xxhash64(text).alias("th")))
    sources = stored(source_targets(sized, weights, epochs))
    queued = _position(sized, sized.count()).alias("q").join(sources.alias("s"), F.expr("q.src <=> s.src")).selectExpr("q.doc_id", "q.src", "size", "key", "th", "upto", "source_size", "target", "budget")
    queued = stored(queued)
    entries = queued.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("ends", F.col("source_size") * F.col("epoch") + F.col("upto"))
    entries = entries.select("src", "upto", "epoch", "size", *[c for c in ORDER if c != "size"], "budget", (F.col("ends").cast("double") / F.col("target")).alias("finish"), (F.col("ends") <= F.col("target")).alias("fits"))
    order = [F.col("fits").desc(), F.col("finish"), F.col("src").asc_nulls_last(), F.col("epoch"), *map(F.col, ORDER)]
    taken = running(entries, order, total="size").filter("fits or total <= budget").groupBy("src", "upto").agg(F.count("*").alias("times"))
    # a queue's cumulative words are different for each of its rows with words
    joined = queued.alias("q").join(taken.alias("t"), F.expr("q.src <=> t.src and q.upto = t.upto and q.size > 0"), "left")
    return joined.selectExpr("q.doc_id", "q.src as source", "size", "source_size", "target", "size * coalesce(times, 0) as taken")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
