"""Names to company ids (survey 2.E): blocked trigram joins, cascades, routing by confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.clean import likely_person, name_core, name_light, name_strict, pan_ok, trigrams, without_messrs
from riskloom.operators.similar import similar_sets
from riskloom.sources.shared import kept

#: Queries up to this number are sent to every task.
MOST_SENT = 100_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts as rows of a matrix, filled with zeros, and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def jaro_winkler_of(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair, for all pairs at once: one step for each place of the longest first text, in which
    every pair looks for its letter among the letters of the second text that are near and not taken yet. Pairs above 0.7 gain
    by their common beginning, four letters at most; two empty texts are alike."""
    x, n = _codes(a)
    y, m = _codes(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    place, free = np.arange(y.shape[1]), np.arange(y.shape[1]) < m[:, None]
    matched, every = np.zeros(x.shape, bool), np.arange(len(x))
    for i in range(x.shape[1]):
        near = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        hit = near.any(1)
        free[every[hit], near.argmax(1)[hit]] = False
        matched[hit, i] = True
    taken = ~free & (place < m[:, None])
    same = matched.sum(1)
    # the matched letters of both texts in their own orders, side by side
    first, second = np.zeros(x.shape, np.uint32), np.zeros(x.shape, np.uint32)
    order = lambda mask: np.cumsum(mask, 1)[mask] - 1
    first[np.nonzero(matched)[0], order(matched)] = x[matched]
    second[np.nonzero(taken)[0], order(taken)] = y[taken]
    half = (first != second).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(same > 0, (same / n + same / m + (same - half) / same) / 3, 0.0)
    jaro = np.where((n == 0) & (m == 0), 1.0, jaro)
    width = min(4, x.shape[1], y.shape[1])
    alike = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
    return np.where(jaro > 0.7, jaro + np.logical_and.accumulate(alike, 1).sum(1) * 0.1 * (1 - jaro), jaro)


def _jaro_winkler(a: str, b: str) -> float:
    """One pair, for checks."""
    return float(jaro_winkler_of([a], [b])[0])


def jaro_winkler(a, b):
    """Column expression; only for candidate pairs that a blocking join has made. Null counts as empty; two empty texts are
    alike. A batch of pairs is judged in parts of alike length."""

    def judge(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = x.fillna("").to_numpy(object), y.fillna("").to_numpy(object)
        out, size = np.zeros(len(left)), np.array([max(len(i), len(j)) for i, j in zip(left, right, strict=True)], np.int64)
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            out[part] = jaro_winkler_of(list(left[part]), list(right[part]))
        return pd.Series(out)

    return F.pandas_udf(judge, "double")(a, b)


def similar_names(queries: DataFrame, master: DataFrame, above: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (qid, cin, sim) with a trigram similarity above the limit.

    Inverted-index join: only the rarest trigrams of each name are joined. A pair above the limit shares more than
    above * n of a name's n trigrams, so one of any n - floor(above * n) of them, in a common order by rarity, is shared
    (prefix filter), and at its place in both enough must be left (positional filter). Similarity is then exact, from the whole sets.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are small, what comes of them is large
    # the names are kept, as they are read twice: to count their trigrams and to deal them
    sets = lambda df, key: kept(df.select(key, *same, "name").dropna(subset=[key]).repartition(parts, key)).select(key, *same, trigrams("name").alias("grams"))
    return similar_sets(sets(queries, "qid"), sets(master, "cin"), above, same)


def judged(near: DataFrame, queries: DataFrame, master: DataFrame) -> DataFrame:
    """Pairs (qid, cin, sim) with jw, the Jaro-Winkler similarity of their names."""
    both = near.join(_shuffled(queries.select("qid", F.col("name").alias("__a"))), "qid").join(_shuffled(master.select("cin", F.col("name").alias("__b"))), "cin")
    return both.withColumn("jw", jaro_winkler("__a", "__b")).drop("__a", "__b")


def candidates(queries: DataFrame, master: DataFrame, above: float, k: int, same: tuple[str, ...] = ()) -> DataFrame:
    """The k most similar companies of each name, ties by cin."""
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "cin")
    return similar_names(queries, master, above, same).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ambiguous(found: DataFrame) -> DataFrame:
    """Names with two or three candidates, the best between 0.5 and 0.7 and hardly better than the next."""
    w = Window.partitionBy("qid")
    by = w.orderBy(F.col("sim").desc(), "cin")
    flagged = found.withColumn("n", F.count("*").over(w)).withColumn("next", F.lead("sim").over(by)).withColumn("r", F.row_number().over(by)).filter("r = 1")
    return flagged.select("qid", (F.col("n").between(2, 3) & F.col("sim").between(0.5, 0.7) & (F.col("sim") - F.col("next") <= 0.05 + 1e-9)).alias("ambiguous"))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the names or the companies. Spark's estimate of it comes from the size of compressed files, less
    than a tenth of what a broadcast of it takes on the driver, so it is never left to that estimate."""
    return df.hint("merge")


def _first(found: list[DataFrame]) -> DataFrame:
    """Lowest stage wins for each name, then the cin."""
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("qid").agg(F.min(F.struct("stage", "cin", "confidence", "method")).alias("b")).select("qid", "b.cin", "b.confidence", "b.method")


def resolve_strict(queries: DataFrame, master: DataFrame, judge=jaro_winkler) -> DataFrame:
    """Cascade for formal records (qid, raw_name, state, industry, cin, pan): cin, confidence, method of each name; null cin
    and method `queue` if nothing fits. Fuzzy stages run only on what the exact ones leave."""
    m = master.select("cin", F.col("registered_state").alias("state"), F.col("industrial_class").alias("industry"), "pan", name_strict("company_name").alias("name"))
    q = queries.withColumn("name", name_strict("raw_name"))
    tag = lambda df, stage, confidence, method: df.select("qid", F.lit(stage).alias("stage"), "cin", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    one = q.select("qid", F.col("cin")).join(_shuffled(m.select("cin")), "cin")
    two = q.filter(pan_ok("pan")).select("qid", "pan").join(_shuffled(m.select("pan", "cin")), "pan")
    three = q.filter("name <> ''").select("qid", "name").join(_shuffled(m.select("name", "cin")), "name")
    exact = _first([tag(one, 1, 100.0, "cin"), tag(two, 2, 100.0, "pan"), tag(three, 3, 95.0, "normalized_exact")])
    exact = kept(exact)
    rest = kept(q.join(_shuffled(exact.select("qid")), "qid", "left_anti").filter("name <> ''").select("qid", "name", "state", "industry"))
    near = similar_names(rest, m, 0.5, ("state",))
    asked, known = rest.select("qid", F.col("name").alias("a"), F.col("industry").alias("i")), m.select("cin", F.col("name").alias("b"), F.col("industry").alias("j"))
    pairs = kept(near.join(_shuffled(asked), "qid").join(_shuffled(known), "cin"))
    four = pairs.filter("sim > 0.8")
    five = pairs.filter(judge("a", "b") >= 0.85)
    six = pairs.filter("sim > 0.6 and i = j")  # pairs of a state above 0.5 hold those of a state and industry above 0.6
    far = kept(candidates(rest, m, 0.6, 10))
    seven = far.filter("rank = 1").join(_shuffled(ambiguous(far).filter("not ambiguous").select("qid")), "qid")
    best = lambda df: df.groupBy("qid").agg(F.max_by("cin", F.struct("sim", "cin")).alias("cin"))
    fuzzy = _first([tag(best(four), 4, 90.0, "trigram_state_08"), tag(best(five), 5, 85.0, "jaro_winkler"), tag(best(six), 6, 75.0, "trigram_state_industry"), tag(seven, 7, 60.0, "trigram_any")])
    out = queries.select("qid").join(_shuffled(exact.unionByName(fuzzy)), "qid", "left")
    return out.select("qid", "cin", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("queue")).alias("method"))


def shortest_with_prefix(names: DataFrame, master: DataFrame, least: int = 5) -> DataFrame:
    """The shortest company name (`light`; then the smallest cin) that starts with each name of `least` letters or more.

    Prefixes of any length are equal keys: a company's name gives one for each length that some query has, and only the
    shortest company of each is kept, before the shuffle too. So a beginning that very many companies share is one row,
    and no name meets companies that do not start with it.
    """
    asked = names.filter(F.length("light") >= least).select("qid", F.col("light").alias("prefix"))
    lengths = [r.n for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as a name has letters
    each = master.select("cin", "light", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("light"))).alias("n"))
    best = each.groupBy(F.substring("light", F.lit(1), F.col("n")).alias("prefix")).agg(F.min(F.struct(F.length("light").alias("size"), "cin")).alias("b"))
    return asked.join(best.hint("merge"), "prefix").select("qid", "b.cin")  # a row explodes to many: its estimate is far too low


def resolve_light(queries: DataFrame, master: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cascade for scraped names (qid, raw_name): person, alias, light exact, same letters, prefix, core exact, trigrams."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select("qid", "raw_name").repartition(parts, "qid").select("qid", F.trim(without_messrs("raw_name")).alias("clean")).withColumn("light", name_light("clean")).withColumn("core", name_core("clean"))
    m = master.select("cin", "company_name").repartition(parts, "cin").select("cin", "company_name", name_light("company_name").alias("light"), name_core("company_name").alias("core"))
    q, m = kept(q), kept(m)  # many joins read either side: names are cleaned once
    tag = lambda df, stage, confidence, method: df.select("qid", F.lit(stage).alias("stage"), "cin", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    person = q.filter(likely_person("clean")).select("qid")
    names = q.join(_shuffled(person), "qid", "left_anti").filter("light <> ''")
    alias = names.join(_shuffled(aliases.select(F.col("normalized_alias").alias("light"), "cin")), "light").join(_shuffled(m.select("cin")), "cin", "left_semi")
    light = names.select("qid", "light").join(_shuffled(m.select("light", "cin")), "light")
    letters = names.select("qid", F.lower("clean").alias("l")).join(_shuffled(m.select(F.lower("company_name").alias("l"), "cin")), "l")
    start = shortest_with_prefix(names, m)
    core = names.filter("core <> '' and core <> light").select("qid", "core").join(_shuffled(m.select("core", "cin")), "core")
    exact = _first([tag(alias, 1, 99.0, "alias"), tag(light, 2, 95.0, "light_exact"), tag(letters, 3, 85.0, "same_letters"), tag(start, 4, 82.0, "prefix"), tag(core, 5, 78.0, "core_exact")])
    exact = kept(exact)
    rest = kept(names.join(_shuffled(exact.select("qid")), "qid", "left_anti").select("qid", "light", "core"))

    def best(df: DataFrame, steps) -> DataFrame:
        top = df.groupBy("qid").agg(F.max(F.struct("sim", "cin")).alias("b")).select("qid", "b.cin", "b.sim")
        return top.withColumn("confidence", steps(F.col("sim")))

    six = best(similar_names(rest.select("qid", F.col("light").alias("name")), m.select("cin", F.col("light").alias("name")), 0.45), lambda s: F.when(s >= 0.75, 85.0).when(s >= 0.6, 72.0).otherwise(55.0))
    seven = best(similar_names(rest.filter("core <> '' and core <> light").select("qid", F.col("core").alias("name")), m.select("cin", F.col("core").alias("name")), 0.4), lambda s: F.when(s >= 0.6, 65.0).otherwise(45.0))
    fuzzy = _first([six.select("qid", F.lit(6).alias("stage"), "cin", "confidence", F.lit("trigram").alias("method")), seven.select("qid", F.lit(7).alias("stage"), "cin", "confidence", F.lit("core_trigram").alias("method"))])
    found = exact.unionByName(fuzzy).unionByName(person.select("qid", F.lit(None).cast("string").alias("cin"), F.lit(0.0).alias("confidence"), F.lit("person").alias("method")))
    return queries.select("qid").join(_shuffled(found), "qid", "left").select("qid", "cin", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("none")).alias("method"))


def route_by_confidence(resolved: DataFrame, sure: float = 75.0, maybe: float = 50.0) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.0))
    return resolved.withColumn("sink", F.when(F.col("cin").isNull(), "unmapped").when(c >= sure, "legal_events").when(c >= maybe, "resolution_queue").otherwise("unmapped"))


def apply_manual(decisions: DataFrame, queue: DataFrame, master: DataFrame) -> DataFrame:
    """Operator decisions (queue_id, cin): accepted, or why not."""
    df = decisions.join(queue.select("queue_id", F.lit(True).alias("known")), "queue_id", "left").join(master.select("cin", F.lit(True).alias("company")), "cin", "left")
    return df.select("queue_id", "cin", F.when(F.col("known").isNull(), "unknown queue id").when(F.col("company").isNull(), "unknown company").otherwise("resolved").alias("result"))


def reprocess(unmapped: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Unmapped signals whose identifier has become known."""
    known = identifiers.groupBy("identifier_type", "identifier_value").agg(F.min("cin").alias("cin"))
    return unmapped.filter("not resolved").join(known, ["identifier_type", "identifier_value"]).select("signal_id", "cin")


def resolution_rate(resolved: DataFrame) -> DataFrame:
    out = resolved.groupBy("source").agg(F.count_if(F.col("cin").isNotNull()).alias("resolved"), F.count("*").alias("total"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("resolved") * 100.0 / F.col("total"), 1)).otherwise(0.0).cast("double"))


def alias_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unique (alias, cin) with normalised aliases."""
    both = old.select("alias", "cin").unionByName(new.select("alias", "cin")).withColumn("normalized_alias", name_light("alias"))
    return both.filter("normalized_alias <> ''").groupBy("normalized_alias", "cin").agg(F.min("alias").alias("alias"))


def search_companies(queries: DataFrame, master: DataFrame, n: int = 10) -> DataFrame:
    """Names that start with a query, then names that hold it, at most n each. Any number of queries: they meet only the
    names that hold their rarest three letters in a row (all letters of a shorter one), by an inverted index of the names.
    Up to MOST_SENT queries are sent to every task, more are joined by shuffle; the index is never sent, whatever its estimate."""
    names = master.select("cin", F.lower("company_name").alias("name"))
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k))).otherwise(F.array().cast("array<string>")))))
    index = names.select("cin", "name", F.explode(pieces(F.col("name"))).alias("g"))
    freq = index.groupBy("g").agg(F.count("*").alias("f"))
    q = queries.select("query", F.lower("query").alias("t")).distinct().filter("t <> ''")
    rarest = q.select("query", "t", F.explode(pieces(F.col("t"))).alias("g")).filter(F.length("g") == F.least(F.length("t"), F.lit(3))).join(freq.hint("merge"), "g", "left").groupBy("query", "t").agg(F.min_by("g", F.struct(F.coalesce("f", F.lit(0)), "g")).alias("g"))
    few = q.limit(MOST_SENT + 1).count() <= MOST_SENT
    pairs = index.join(rarest.hint("broadcast" if few else "merge"), "g").filter(F.contains("name", F.col("t")))
    ranked = pairs.withColumn("rank", F.when(F.startswith("name", F.col("t")), 1).otherwise(2))
    w = Window.partitionBy("query", "rank").orderBy("name", "cin")
    return ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("query", "cin", "rank", "r")


def identifier_chain(records: DataFrame, identifiers: DataFrame, master: DataFrame, directors: DataFrame) -> DataFrame:
    """cin and method of records (rid, gstin, pan, cin_text, director): tax number, then PAN, then an id as text, then the
    director's latest company."""
    known = lambda t: identifiers.filter(F.col("identifier_type") == t).groupBy("identifier_value").agg(F.min("cin").alias(f"cin_{t}"))
    w = Window.partitionBy("name").orderBy(F.col("date_of_appointment").desc_nulls_last(), "cin")
    last = directors.select(F.lower("director_name").alias("name"), "cin", "date_of_appointment").withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", F.col("cin").alias("cin_director"))
    df = records.join(known("GSTIN").withColumnRenamed("identifier_value", "gstin"), "gstin", "left").join(known("PAN").withColumnRenamed("identifier_value", "pan"), "pan", "left")
    df = df.join(master.select(F.col("cin").alias("cin_text"), F.col("cin").alias("cin_own")), "cin_text", "left").withColumn("name", F.lower("director")).join(last, "name", "left")
    method = F.when(F.col("cin_GSTIN").isNotNull(), "gstin").when(F.col("cin_PAN").isNotNull(), "pan").when(F.col("cin_own").isNotNull(), "cin").when(F.col("cin_director").isNotNull(), "director").otherwise("none")
    return df.select("rid", F.coalesce("cin_GSTIN", "cin_PAN", "cin_own", "cin_director").alias("cin"), method.alias("method"))
