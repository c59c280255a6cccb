"""Cleaning expressions (survey 2.B): each takes a column and gives a column, in Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """Trimmed text, null where empty."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def cin_ok(c) -> Column:
    return F.coalesce(col(c).rlike(fixed.CIN_PATTERN), F.lit(False))


def pan_ok(c) -> Column:
    return F.coalesce(col(c).rlike(fixed.PAN_PATTERN), F.lit(False))


def director_number(c) -> Column:
    """Digits only, padded to eight; longer values stay as they are, none gives null."""
    digits = F.nullif(F.regexp_replace(col(c).cast("string"), r"\D", ""), F.lit(""))
    return F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))


def squash(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def _any(tokens: list[str]) -> str:
    return r"\b(?:" + "|".join(tokens) + r")\b"


def _bare(c: Column) -> Column:
    return F.translate(c, fixed.PUNCTUATION, "")


def name_light(c) -> Column:
    """Legal suffixes go first, then punctuation."""
    return squash(_bare(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), _any(fixed.LIGHT_TOKENS), " ")))


def name_strict(c) -> Column:
    """Punctuation goes first, then legal and business words, longest first."""
    return squash(F.regexp_replace(squash(_bare(F.lower(F.coalesce(col(c), F.lit(""))))), _any(fixed.STRICT_TOKENS), " "))


def name_core(c) -> Column:
    return squash(_bare(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), _any(sorted(fixed.CORE_TOKENS, key=len, reverse=True)), " ")))


def without_messrs(c) -> Column:
    return F.regexp_replace(col(c), r"(?i)^m/s\.?\s*", "")


def likely_person(c) -> Column:
    words = F.split(F.trim(col(c)), r"\s+")
    plain = F.forall(words, lambda w: w.rlike("^[A-Za-z]+$"))
    return F.coalesce(~col(c).rlike("(?i)" + _any(fixed.COMPANY_TOKENS)) & ~col(c).rlike(r"\d") & F.size(words).between(2, 5) & plain, F.lit(False))


def any_date(c, formats: list[str] = fixed.DATE_FORMATS) -> Column:
    """First format that fits, then an ISO date anywhere in the text."""
    text = F.trim(col(c))
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*tried, F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date"))


def money(c, lakh: bool = True) -> Column:
    """Whole rupees of '₹12.5 Cr', '50 Lakh', '1,250,000'."""
    text = F.lower(F.regexp_replace(col(c).cast("string"), "[,₹]", ""))
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("decimal(24,4)")
    factor = F.when(text.rlike(r"\d\s*(?:cr|crore)"), 10_000_000)
    if lakh:
        factor = factor.when(text.rlike(r"\d\s*(?:lakh|lac)"), 100_000)
    return (number * factor.otherwise(1)).cast("bigint")


def whole(c) -> Column:
    """Integers with separators; decimals are cut off, anything else is null."""
    return F.regexp_replace(F.trim(col(c).cast("string")), ",", "").try_cast("decimal(28,6)").cast("bigint")


def entity_in_title(c) -> Column:
    """Name after 'in the matter of', 'in respect of' or 'against'; else the title without a leading date."""
    found = [F.nullif(F.trim(F.regexp_extract(col(c), rf"(?i){lead}\s+(.+)$", 1), F.lit(" .")), F.lit("")) for lead in ("in the matter of", "in respect of", "against")]
    return F.coalesce(*found, F.trim(F.regexp_replace(col(c), r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\s*", "")))


def company_in_title(c) -> Column:
    """Text after the first dash without a bracketed reference; else after 'In the matter of'; else the title."""
    dash = F.when(F.instr(col(c), "-") > 0, F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_replace(col(c), r"^[^-]*-", "")), r"\s*\[[^\]]+\]\s*$", "")), F.lit("")))
    return F.coalesce(dash, F.nullif(F.trim(F.regexp_extract(col(c), r"(?i)In the matter of\s+(.+?)(?:\s*\[|$)", 1)), F.lit("")), F.trim(col(c)))


def parties(c, split: str = r"(?i)\bvs\.?\b|\bversus\b|,|;") -> Column:
    return F.filter(F.transform(F.split(col(c), split), squash), lambda p: F.exists(F.array(*map(F.lit, fixed.PARTY_TOKENS)), lambda t: F.contains(F.lower(p), t)))


def role_types(c) -> Column:
    return F.filter(F.array(*map(F.lit, fixed.ROLES)), lambda r: F.contains(F.lower(col(c)), r))


def mentions(c, tokens: list[str]) -> Column:
    """Whether any of the tokens is in the lower-cased text."""
    return F.coalesce(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(col(c)), t)), F.lit(False))


def relevant(c) -> Column:
    return mentions(c, fixed.RELEVANT)


def bank_like(c) -> Column:
    return mentions(c, fixed.BANK_TOKENS)


def lookup(c, values: dict, default=None) -> Column:
    """A small fixed table as an expression."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col(c))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def severity_rank(c) -> Column:
    return lookup(c, fixed.SEVERITY_RANK, 0)


def subscriber_rank(c) -> Column:
    return lookup(c, fixed.SUBSCRIBER_RANK, 0)


def case_severity(c) -> Column:
    return lookup(c, fixed.CASE_SEVERITY, "WATCH")


def band(score) -> Column:
    return F.when(col(score) >= 70, "GREEN").when(col(score) >= 40, "AMBER").otherwise("RED")


def lag_hours(next_pull, as_of: Column) -> Column:
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(col(next_pull))) / 3600.0
    return F.when(hours > 0, F.round(hours, 2))


def source_colour(status, failures, last_pull) -> Column:
    return F.when(col(last_pull).isNull(), "grey").when(col(status) == "UNREACHABLE", "red").when((col(status) == "DEGRADED") | (col(failures) > 0), "amber").otherwise("green")


def case_label(case_type, number, year) -> Column:
    part = lambda c: F.coalesce(present(c), F.lit("NA"))
    return F.concat_ws("/", part(case_type), part(number), part(year))


def preview(payload, n: int = 200) -> Column:
    return F.substring(col(payload), 1, n)


def as_json(*cols) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def age_months(since, as_of: Column) -> Column:
    return F.timestamp_diff("MONTH", col(since).cast("timestamp"), as_of)


def optional_filter(value, limit) -> Column:
    """True where the filter is null or equal to the value."""
    return col(limit).isNull() | (col(value) == col(limit))


#: Identifiers that are mined from texts.
IDENTIFIERS = {
    "PAN": r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",
    "GSTIN": r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b",
    "IEC": r"\b([0-9]{10})\b",
    "BID": r"\b([0-9]{6,})\b",
    "ESTABLISHMENT": r"\b([0-9]{7})\b",
    "PROPOSAL": r"\b([A-Z]{2,}-\d+)\b",
}


def extract_identifiers(docs: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row (key, id_type, value) for each distinct identifier of a text."""
    found = [F.expr(f"transform(regexp_extract_all({text}, r'{p}', 1), v -> named_struct('id_type', '{t}', 'value', v))") for t, p in (patterns or IDENTIFIERS).items()]
    return docs.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("f")).select(key, "f.id_type", "f.value")


def trigrams(c) -> Column:
    """Distinct padded word trigrams of a text, as pg_trgm makes them."""
    words = F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a, b) -> Column:
    """Shared trigrams as a part of all trigrams; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)).cast("double") / union)
