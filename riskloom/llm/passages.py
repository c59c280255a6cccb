"""Operator 6: benchmark decontamination with a distributed positional inverted index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these: the ASCII characters other than digits and letters (A-Z are lower-cased first).
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
WINDOW = 10
#: Rarest terms of each window whose postings are intersected.
ANCHORS = 2
#: Words by which the rarest terms of a window may be displaced in a proximity match.
SLOP = 3
#: Test words up to this number are sent to every task (some 50 bytes each); more are joined by shuffle.
MOST_SENT = 1 << 19


def tokens(text):
    """Words of a text column, A-Z lower-cased; null has none. Every character between words becomes a blank and the text
    is split there: a fifth of the time of a search for the words by pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " ", -1), "")


class Index:
    """Postings of the training documents for the rarest terms of the test items' windows.

    Two passes over the documents: one counts the test items' terms, one stores the positions of each window's rarest
    terms (a table in the shared folder). Terms that no item needs are never shuffled, and counts are summed before the
    shuffle. A window with a term that no document has is left out, as it cannot occur.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS, most_sent: int = MOST_SENT):
        # a row's name: its id, which may be missing or repeated, and its text's hash
        self.docs, self.window = docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), window
        self.items = stored(items.select("item_id", tokens(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0").withColumn("len", F.least("n", F.lit(window))))
        size = self.items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.small, self.most_sent = size <= most_sent, most_sent
        side = self._side
        words = self.items.select("item_id", "n", "len", F.posexplode("words").alias("ipos", "term"))
        exploded = self.docs.select(F.explode(tokens(F.col("text"))).alias("term"))
        counts = exploded.join(side(words.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("freq"))
        words = words.join(side(stored(counts)), "term", "left")
        starts = words.select("item_id", "ipos", "term", "freq", "len", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("len") + 1), F.least("ipos", F.col("n") - F.col("len")))).alias("start"))
        by_window = Window.partitionBy("item_id", "start")
        ranked = starts.withColumn("rank", F.row_number().over(by_window.orderBy("freq", "ipos"))).withColumn("missing", F.max(F.col("freq").isNull()).over(by_window)).filter(~F.col("missing") & (F.col("rank") <= anchors))
        self.windows = stored(ranked.select("item_id", "start", "ipos", "term"))
        self.anchors = self.windows.select("term", "item_id", "ipos").distinct()
        places = self.docs.select("doc_id", "th", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
        self.postings = stored(places.join(side(self.anchors.select("term").distinct()), "term").select("term", "doc_id", "th", "pos"))

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def alignments(self) -> DataFrame:
        """doc_id, th, item_id, delta (document position of the item's first word) and the item positions found there."""
        hits = self.postings.join(self._side(self.anchors), "term").select("doc_id", "th", "item_id", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos")
        return hits.groupBy("doc_id", "th", "item_id", "delta").agg(F.collect_set("ipos").alias("found"))

    def candidates(self) -> DataFrame:
        """Alignments at which all rarest terms of at least one window stand."""
        need = self.windows.groupBy("item_id", "start").agg(F.collect_set("ipos").alias("need")).groupBy("item_id").agg(F.collect_set("need").alias("needs"))
        near = self.alignments().join(self._side(need), "item_id")
        return near.filter(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("found"))) == 0)).select("doc_id", "th", "item_id", "delta")

    def phrases(self) -> DataFrame:
        """Exact matches per document: doc_id, th, n_words, hits (positions of hit words), items. Candidates meet the texts of
        their documents; each window is then compared word by word."""
        found = stored(self.candidates())
        per = found.join(self._side(self.items.select("item_id", "words", "n", "len")), "item_id").groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "delta", "words", "n", "len")).alias("found"))
        ids = found.select("th").distinct()
        few = ids.limit(self.most_sent + 1).count() <= self.most_sent
        # only texts with candidates are shuffled
        texts = self.docs.join(F.broadcast(ids), "th", "left_semi") if few else self.docs
        both = texts.alias("d").join(per.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.th = p.th"))
        w = both.select("d.doc_id", "d.th", tokens(F.col("d.text")).alias("w"), "p.found")
        w = w.withColumn("found", F.expr("""transform(found, f -> struct(f.item_id as item_id, f.delta as delta, f.len as len, f.n as n,
            array_join(transform(f.words, (x, j) -> if(f.delta + j >= 0 and f.delta + j < size(w), if(get(w, f.delta + j) = x, '1', '0'), '0')), '') as same))"""))
        w = w.withColumn("found", F.expr("transform(found, f -> struct(f.item_id as item_id, f.delta as delta, f.len as len, filter(sequence(0, f.n - f.len), s -> substring(f.same, s + 1, f.len) = repeat('1', f.len)) as starts))"))
        w = w.withColumn("found", F.expr("filter(found, f -> size(f.starts) > 0)"))
        hits = F.expr("array_distinct(flatten(flatten(transform(found, f -> transform(f.starts, s -> sequence(f.delta + s, f.delta + s + f.len - 1))))))")
        return w.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), F.array_sort(F.array_distinct(F.expr("transform(found, f -> cast(f.item_id as string))"))).alias("items"))

    def proximity(self, slop: int = SLOP) -> DataFrame:
        """doc_id, th, item_id of near matches: two of a window's rarest terms stand in the document, but 1 to `slop` words
        nearer or farther from each other than in the item. Short windows of one term have none, and so has an empty table.
        Windows that share their two terms are one pair. A pair's postings of a document are sorted by displacement, and
        each looks back at those 1 to `slop` before it: one of the other term is a match, however many stand between."""
        both = self.windows.groupBy("item_id", "start").agg(F.min(F.struct("ipos", "term")).alias("a"), F.max(F.struct("ipos", "term")).alias("b")).filter("a.ipos < b.ipos")
        pairs = both.select("item_id", "a", "b").distinct().select("item_id", F.col("a.ipos").alias("first"), F.col("b.ipos").alias("second"), F.explode(F.array("a", "b")).alias("x")).select("item_id", "first", "second", "x.ipos", "x.term")
        spread = self.postings.join(self._side(pairs), "term").select("doc_id", "th", "item_id", "first", "second", "ipos", (F.col("pos") - F.col("ipos")).alias("delta"))
        back = Window.partitionBy("doc_id", "th", "item_id", "first", "second").orderBy("delta").rangeBetween(-slop, -1)
        near = spread.withColumn("low", F.min("ipos").over(back)).withColumn("high", F.max("ipos").over(back))
        return near.filter((F.col("low") != F.col("ipos")) | (F.col("high") != F.col("ipos"))).select("doc_id", "th", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_sent: int = MOST_SENT, slop: int | None = None) -> DataFrame:
    """Per row of documents: doc_id, th (hash of the text), n_words, n_hit, items (sorted ids as text), n_items,
    contaminated; with `slop` also near, the sorted ids of the items with a proximity match, whether or not they are hit.

    A window is `window` consecutive words of an item (all of a shorter item); a word inside any occurrence is hit. Null
    and empty texts have no words; an item without words has no window; equal items are all reported. Rows that repeat
    a document repeat its result; rows that share an id but not the text have their own, and so have rows without an id.
    Empty tables give an empty table or documents without hits.
    """
    index = Index(docs, items, window, most_sent=most_sent)
    # no filter on hits: Catalyst would push it below the words, which would then be cut out anew for each comparison
    best = F.max(F.struct(F.size("hits").cast("long").alias("n_hit"), "items")).alias("b")
    found = index.phrases().groupBy("doc_id", "th").agg(best).select("doc_id", "th", "b.n_hit", "b.items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    out = counted.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.th = f.th"), "left")
    none = F.array().cast("array<string>")
    out = out.select("d.doc_id", "d.th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    if slop is None:
        return out
    near = index.proximity(slop).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near"))
    out = out.alias("d").join(near.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.th = p.th"), "left")
    return out.select("d.*", F.coalesce("near", none).alias("near"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    sha = lambda ids: F.sha2(F.array_join(ids, ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha("items").alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"), sha("near").alias("near_sha256"))
