"""Operator 1: personal data, with information-theoretic sanitisation. DataFrame functions only.

Base spans come from four patterns. Besides, words that stand near a protected value (a base span) in the corpus are
weighed: with n_e the value's contexts, n_et those that hold the word, n_t these and the other texts of the word, and N the
value's contexts and the texts without it, the disclosure is the pointwise mutual information log(N n_et / (n_e n_t)) as a
share of the value's information log(N / n_e). It is 1 for a word that is only found with the value. Equal contexts and
equal texts count once in all four. Words above the threshold are spans of the kind `term` wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the contract, written without backtracking: a run of characters is entered at its start or right after
#: the last match, and groups that cannot give anything back are possessive. Leftmost matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9]*+(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_HINTS = {"email": "instr(t, '@') > 0", "ip": "t rlike r'[0-9][.][0-9]'", "card": "t rlike r'[0-9][ -]?[0-9]'", "phone": "instr(t, '+') > 0"}
_VALID = {
    "email": "true",
    "ip": "forall(split(m.v, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and cast(concat('0', substring(trim(LEADING '0' FROM p), 1, 3)) as int) <= 255)",
    "card": "length(translate(m.v, ' -', '')) between 12 and 19 and aggregate(sequence(1, length(translate(m.v, ' -', ''))), 0, (a, i) -> a + element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(reverse(translate(m.v, ' -', '')), i, 1) as int) + if(i % 2 = 0, 10, 0) + 1)) % 10 = 0",
    "phone": "length(regexp_replace(m.v, '[^0-9]', '')) between 9 and 15",
}
#: Characters of context on each side of a value; words that its ends cut in two do not count.
CONTEXT = 100
#: A term: a letter and at least three more letters or digits.
TERM = r"\p{L}[\p{L}\p{N}]{3,}+"
_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), r'{TERM}', 0)"
#: A pair of value and word needs so many different contexts.
MIN_CONTEXTS = 3
DISCLOSURE = 0.9
#: Terms at least so revealing are removed, others are generalised to their first letter.
REMOVE = 0.97
#: Terms, or documents with terms, up to this number are sent to every task; more are joined by shuffle.
MOST_SENT = 1 << 18


#: Matches whose places are added up together, and code points of the pieces that contexts are cut from.
_BLOCK, _PIECE = 256, 1000


def _let(name: str, value: str, then: str) -> str:
    """SQL: an expression over a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _placed(pattern: str, t: str = "t") -> str:
    """SQL: matches of a pattern with their places in code points. The text is split at the matches, and lengths add up, in
    blocks: as arrays are copied when they grow, one array of all matches would take the square of their number."""
    size = "length(x.`0`) + coalesce(length(x.`1`), 0)"
    zipped = f"arrays_zip(split({t}, {pattern}, -1), regexp_extract_all({t}, {pattern}, 0))"
    blocks = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> slice(z, b * {_BLOCK} + 1, {_BLOCK}))"
    starts = f"aggregate(transform(k, y -> aggregate(y, 0, (a, x) -> a + {size})), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    placed = f"""flatten(transform(k, (y, i) -> aggregate(y, named_struct('at', q[i], 'out', cast(array() as array<struct<s: int, e: int, v: string>>)),
        (a, x) -> if(x.`1` is null, a, named_struct('at', a.at + {size}, 'out', concat(a.out, array(named_struct('s', a.at + length(x.`0`), 'e', a.at + {size}, 'v', x.`1`))))), a -> a.out)))"""
    return _let("z", zipped, _let("k", blocks, _let("q", starts, placed)))


def _cut(start: str, size: str, pieces: str = "c") -> str:
    """SQL: substring(text, start, size) for sizes up to _PIECE, from the text's pieces; a substring of the text itself is
    searched from its beginning."""
    piece = lambda i: f"coalesce(try_element_at({pieces}, cast(({start} - 1) div {_PIECE} + {i} as int)), '')"
    return f"substring(concat({piece(1)}, {piece(2)}), ({start} - 1) % {_PIECE} + 1, {size})"


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds `base`, an array of (s, k, e, v): start, number of the kind, end, value; sorted by start and kind."""
    out = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    none = "cast(array() as array<struct<s: int, k: int, e: int, v: string>>)"
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = f"transform(filter({_placed(chr(114) + chr(39) + pattern + chr(39))}, m -> {_VALID[kind]}), m -> named_struct('s', m.s, 'k', {k}, 'e', m.e, 'v', m.v))"
        out = out.withColumn(f"__{kind}", F.expr(f"if({_HINTS[kind]}, {spans}, {none})"))
    return out.withColumn("base", F.array_sort(F.concat(*[f"__{kind}" for kind in PATTERNS]))).drop(*[f"__{kind}" for kind in PATTERNS])


def _contexts(spans: DataFrame) -> DataFrame:
    """value (hash of kind and text), context (hash), th (hash of the whole text), terms: a row for each value's place."""
    near = spans.select("th", F.explode("near").alias("x")).select("th", "x.value", "x.around")
    return near.select("value", F.xxhash64("around").alias("context"), "th", F.array_distinct(F.expr(f"regexp_extract_all(lower(around), r'{TERM}', 0)")).alias("terms"))


def _distinct_texts(docs: DataFrame, most_sent: int) -> tuple[DataFrame, int]:
    """Each text once (th, text), and their number. Only texts that have copies are shuffled, while their hashes are few."""
    texts = docs.select(F.xxhash64("text").alias("th"), "text")
    sizes = stored(texts.groupBy("th").agg(F.count("*").alias("copies")))
    again = sizes.filter("copies > 1").select("th")
    if again.limit(most_sent + 1).count() > most_sent:
        return texts.dropDuplicates(["th"]), sizes.count()
    once = texts.join(F.broadcast(again), "th", "left_anti")
    return once.unionByName(texts.join(F.broadcast(again), "th", "left_semi").dropDuplicates(["th"])), sizes.count()


def revealing_terms(docs: DataFrame, spans: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE, most_sent: int = MOST_SENT) -> DataFrame | None:
    """term, disclosure of the words that reveal a value; None if no value has enough contexts with any word.

    Equal contexts and equal texts (copies) count once. A word's texts are counted over the whole corpus; those in which it
    stands near the value are represented by its contexts there, so that a passage in many texts hides no word. Counts are
    summed before each shuffle.
    """
    near = _contexts(spans)
    rows = near.select("value", "context", "th", F.explode("terms").alias("term"))
    shared = rows.select("value", "term", "context").distinct().groupBy("value", "term").agg(F.count("*").alias("n_et"))
    pairs = stored(shared.filter(F.col("n_et") >= min_contexts))
    if pairs.limit(1).count() == 0:
        return None
    texts, n = _distinct_texts(docs, most_sent)
    # n_e contexts in d_e texts
    values = near.select("value", "context").distinct().groupBy("value").agg(F.count("*").alias("n_e")).join(near.select("value", "th").distinct().groupBy("value").agg(F.count("*").alias("d_e")), "value")
    terms = pairs.select("term").distinct()
    few = terms.limit(most_sent + 1).count() <= most_sent
    # d_et: the texts behind n_et
    wanted = rows.select("value", "term", "th").join(F.broadcast(terms) if few else terms, "term", "left_semi").distinct()
    behind = wanted.groupBy("value", "term").agg(F.count("*").alias("d_et"))
    words = texts.select(F.explode(F.array_distinct(F.expr(_WORDS))).alias("term"))
    # counted before the join: a candidate may be a common word
    counts = words.groupBy("term").agg(F.count("*").alias("d_t"))
    spread = counts.join(F.broadcast(terms) if few else terms, "term")
    found = pairs.join(behind, ["value", "term"]).join(values, "value").join(spread, "term")
    found = found.withColumn("n", (F.lit(n) - F.col("d_e") + F.col("n_e")).cast("double")).withColumn("n_t", F.greatest(F.col("d_t") - F.col("d_et"), F.lit(0)) + F.col("n_et")).filter("n_e < n")
    ratio = F.log(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("n") / F.col("n_e"))
    found = found.withColumn("disclosure", F.least(ratio, F.lit(1.0)))
    return stored(found.filter(F.col("disclosure") >= disclosure).groupBy("term").agg(F.max("disclosure").alias("disclosure")))


def _term_spans(docs: DataFrame, terms: DataFrame, most_sent: int) -> DataFrame:
    """doc_id, th, terms (s, e, v) and the ones to remove, of the documents that hold a revealing term."""
    few = terms.limit(most_sent + 1).count() <= most_sent
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array_distinct(F.expr(_WORDS))).alias("term"))
    held = stored(words.join(F.broadcast(terms) if few else terms, "term").groupBy("doc_id", "th").agg(F.collect_set("term").alias("own"), F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("removed")))
    few = held.limit(most_sent + 1).count() <= most_sent
    mine = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("d").join((F.broadcast(held) if few else held).alias("h"), F.expr("d.doc_id <=> h.doc_id and d.th = h.th")).select("d.doc_id", "d.th", F.col("d.text").alias("t"), "own", "removed").dropDuplicates(["doc_id", "th"])
    # one pattern for all words of a text; those that are not its revealing terms are left out
    places = _placed(rf"r'(?<![\p{{L}}\p{{N}}]){TERM}(?![\p{{L}}\p{{N}}])'")
    return mine.select("doc_id", "th", F.expr(f"filter({places}, x -> array_contains(own, lower(x.v)))").alias("terms"), "removed")


def find_personal_data(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE, most_sent: int = MOST_SENT) -> DataFrame:
    """Per row of documents: doc_id, th (hash of the text), base and spans, arrays of (s, k, e, v) sorted by start and kind, and
    removed, the revealing terms of a disclosure of REMOVE or more.

    Base spans are the leftmost matches of the four patterns that do not overlap within their kind; matches that fail their
    check are dropped. Revealing terms inside a base span are left out. Null and empty texts have no spans. Rows that
    repeat a document repeat its spans; an empty table gives an empty table; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    spans = base_spans(docs)
    # with the character outside of the window goes the word that it belongs to, if any
    before = rf"if(b.s > {CONTEXT}, regexp_replace({_cut(f'(b.s - {CONTEXT})', str(CONTEXT + 1))}, r'(?s)^(?:[\p{{L}}\p{{N}}]+|.)', ''), {_cut('1', 'b.s')})"
    after = rf"if(length({_cut('(b.e + 1)', str(CONTEXT + 1))}) > {CONTEXT}, regexp_replace({_cut('(b.e + 1)', str(CONTEXT + 1))}, r'(?s)(?:[\p{{L}}\p{{N}}]+|.)\z', ''), {_cut('(b.e + 1)', str(CONTEXT))})"
    around = f"named_struct('value', xxhash64(b.k, lower(b.v)), 'around', concat({before}, ' # ', {after}))"
    pieces = f"regexp_extract_all(t, r'(?s).{{1,{_PIECE}}}', 0)"
    spans = stored(spans.withColumn("near", F.expr(f"if(size(base) = 0, cast(array() as array<struct<value: bigint, around: string>>), {_let('c', pieces, f'transform(base, b -> {around})')})")).select("doc_id", F.xxhash64("text").alias("th"), "base", "near"))
    terms = revealing_terms(docs, spans, min_contexts, disclosure, most_sent)
    if terms is None or terms.limit(1).count() == 0:
        return spans.select("doc_id", "th", "base", F.col("base").alias("spans"), F.array().cast("array<string>").alias("removed"))
    placed = _term_spans(docs, terms, most_sent)
    out = spans.alias("b").join(placed.alias("p"), F.expr("b.doc_id <=> p.doc_id and b.th = p.th"), "left")
    added = F.expr(f"transform(filter(coalesce(terms, array()), x -> not exists(base, b -> b.s < x.e and x.s < b.e)), x -> named_struct('s', x.s, 'k', {KINDS.index('term')}, 'e', x.e, 'v', x.v))")
    return out.select("b.doc_id", "b.th", "base", F.array_sort(F.concat("base", added)).alias("spans"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))


def _written(column: str):
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat(element_at({kinds}, x.k + 1), ':', x.s, ':', x.e)), ',')")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """Documents with a column `sanitised`: base spans replaced by their kind in brackets, revealing terms generalised to their
    first letter and an ellipsis, or removed where they reveal the value all but surely. Spans that overlap an earlier one
    are covered with it. Null texts become empty; other columns stay, but for `sanitised`; an empty table stays one."""
    docs = docs.drop("sanitised")
    found = find_personal_data(docs, **options).dropDuplicates(["doc_id", "th"])
    kinds = "array(" + ", ".join(f"'{k.upper()}'" for k in KINDS) + ")"
    joined = docs.withColumn("__th", F.xxhash64("text")).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.__th = f.th"), "left").select("d.*", F.col("f.spans").alias("__spans"), F.col("f.removed").alias("__removed"))
    out = joined.withColumn("__r", F.expr(f"""aggregate(__spans, named_struct('at', 0, 'out', ''), (a, x) -> if(x.e <= a.at, a, named_struct('at', x.e, 'out',
        concat(a.out, substring(text, a.at + 1, greatest(x.s - a.at, 0)), if(x.k = 4, if(array_contains(__removed, lower(x.v)), '', concat(substring(x.v, 1, 1), '…')), concat('[', element_at({kinds}, x.k + 1), ']'))))))"""))
    return out.withColumn("sanitised", F.expr("concat(__r.out, substring(coalesce(text, ''), __r.at + 1, length(coalesce(text, ''))))")).drop("__r", "__th", "__spans", "__removed")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
