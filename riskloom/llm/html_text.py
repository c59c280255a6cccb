"""Operator 2: main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import pieces, table

#: Lines summed by a window, and the sum at which text outside of an article element surges.
WINDOW, SURGE = 3, 86

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|iframe|object|textarea|select|svg|math|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_STACKED = frozenset("article aside body dialog div dl fieldset figure footer form head header html li main menu nav ol section table ul".split())
_NEVER = frozenset("aside dialog fieldset form head menu nav title".split())
#: Words of class, id and role that mark what is not the article.
_MARK = re.compile(r"(?<![a-z])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|contentinfo|cookie|cookies|disclaimer|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|promotion|related|reply|replies|respond|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?![a-z])", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _marked(name: str, attributes: str) -> bool:
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        # camelCase is cut into words
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and _MARK.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)):
            return True
        if name == "article" and key in ("class", "id") and re.search(r"(?<![a-z])(?:comment|reply|ad|advert|related)s?(?![a-z])", value, re.I):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, bool]]:
    """The page's blocks as lines, in order: text and whether it is inside an article. What is left out (menus, notices,
    forms, scripts and so on) leaves WINDOW empty lines."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, left out, inside an article
    out_of, inside, at = False, False, 0

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(held))).strip()
        held.clear()
        if text and not out_of:
            out.append((text, inside))

    def gap() -> None:
        out.extend([("", False)] * WINDOW)

    for m in _TOKEN.finditer(html):
        if not out_of and m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        slash, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            held.append(" ")
            continue
        if name not in _BLOCKS:
            continue
        close()
        if name not in _STACKED:
            continue
        was = out_of
        if not slash:
            if name == "body":
                stack = [x for x in stack if x[0] != "head"]
            left = stack[-1][1] if stack else False
            within = stack[-1][2] if stack else False
            drop = name in _NEVER or name == "footer" or name == "header" and not within or _marked(name, attributes) and not (name == "header" and within)
            stack.append((name, left or drop, (within or name in ("article", "main")) and not drop))
        elif any(x[0] == name for x in stack):
            while stack.pop()[0] != name:
                pass
        out_of, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if out_of != was:
            gap()
    if at < len(html) and not out_of:
        tail = html[at:]
        held.append(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", tail) else tail)
    close()
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Sums the lengths of `window` lines from each line on, over all lines that are not marked. Text starts where a sum
    surges and ends at the dive, where a sum is zero, or where an article or main element starts or ends. The sums have to
    reach `surge` code points somewhere between; inside of an article any text is enough, and where a page has nothing of
    either kind its highest sum is the surge."""
    lines = lines_of(html or "")
    return "\n\n".join(_parts(lines, window, surge) or _parts(lines, window, _highest(lines, window)))


def _highest(lines: list[tuple[str, bool]], window: int) -> int:
    return max((sum(len(t) for t, _ in lines[i : i + window]) for i in range(len(lines))), default=0)


def _parts(lines: list[tuple[str, bool]], window: int, surge: int) -> list[str]:
    kept, begin = [], 0
    while begin < len(lines):
        inside, end = lines[begin][1], begin
        while end < len(lines) and lines[end][1] == inside:
            end += 1
        kept += _surges([t for t, _ in lines[begin:end]], window, 1 if inside else surge)
        begin = end
    return kept


def _surges(lines: list[str], window: int, surge: int) -> list[str]:
    size = [len(t) for t in lines]
    total, sums = sum(size[:window]), []
    for i in range(len(size)):
        sums.append(total)
        total += (size[i + window] if i + window < len(size) else 0) - size[i]
    kept, run, high = [], [], 0
    for i, text in enumerate(lines):
        if sums[i] == 0:  # dive
            kept += run if high >= surge else []
            run, high = [], 0
        else:
            high = max(high, sums[i])
            if text:
                run.append(text)
    return kept + (run if high >= surge else [])


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text (empty if none) and n_chars to pages; the other columns stay, but for html.

    Null and empty pages have no text; pages cut in the middle keep what is there, without the unfinished tag. Repeated
    rows give repeated results, an empty table an empty one; columns named text and n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars").withColumnRenamed(html, "html")

    def run(batches):
        for batch in pieces(batches, "html"):
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"), "text string, n_chars long"])
    return pages.mapInArrow(run, schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
