"""Main text of web pages by line-block distribution.

The page is cut into *lines*, one for each block element, while markup, scripts, styles,
forms, comments and the parts that name themselves as menus, headers, footers, sidebars,
notices, adverts or reader comments fall away.  Text lengths summed over sliding windows of
lines give a distribution with plateaus over articles: a plateau begins at the line where the
windowed length leaves nothing (the *surge*, if it climbs over the threshold) and ends where it
falls to nothing again (the *dive*).  All lines between a surge and its dive are kept, short or
linked ones, too; link text counts as menu, not as length.  Where nothing climbs over the
threshold, the highest plateau is the article.  Where the page names its article
(``<article>``, ``<main>``, or an articleBody), the distribution is that of the lines of each
such element -- unless the plateaus of the whole page hold ``teaser`` times as much text outside
of these elements as was found inside, which makes them teasers: then those of the whole page count.

Defined results: null, empty or markup-only html gives an empty text and 0 characters; a tag
that is never closed ends with the page (or with the parent, for ``p``, ``li`` and the like); a
broken entity or tag at the end is text or dropped as a browser would; rows that repeat an
id are each done; very long pages are done whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# --- fixed values: HTML element names ---
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
RAW = frozenset("script style noscript template iframe object svg canvas math textarea select title head audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav footer aside form button dialog menu label option".split())
CLOSES = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
NO_P = BLOCKS - {"body", "html", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "noscript"}
# --- fixed values: words by which parts of a page name themselves ---
NAMED = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottom sidebar side aside widget related recommended comment comments disqus respond reply replies discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager "
    "copyright disclaimer skip search"
)
AWAY_NAMES = frozenset(NAMED.split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named_away(attrs: str) -> tuple[bool, bool]:
    """Whether attributes name a part outside the article, and whether they name the article's body."""
    away = body = False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.split():
                parts = WORDS.findall(CAMEL.sub("-", name).lower())
                if any(p in AWAY_NAMES for p in parts) and not ({"article", "post", "entry", "story"} & set(parts) and {"header", "body", "content", "title"} & set(parts)):
                    away = True
        elif key == "role":
            away |= value.lower() in AWAY_ROLES
        elif key == "itemprop":
            body |= value == "articleBody"
        elif key == "hidden":
            away = True
        elif key == "aria-hidden":
            away |= value.lower() == "true"
        elif key == "style":
            away |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return away, body


class _Line:
    __slots__ = ("text", "linked", "home")

    def __init__(self, text: str, linked: int, home: int):
        self.text, self.linked, self.home = text, linked, home


def lines(page: str) -> list[_Line]:
    """Blocks of text outside the parts that fall away, with the length of their link text and the number of the article they lie in (0: none)."""
    out: list[_Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it falls away, whether it is an article
    parts: list[str] = []
    away = articles = 0
    home = count = linked = links = 0
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(_Line(text, linked, home))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal away, articles, home, links
        name, gone, is_article = stack.pop()
        away -= gone
        if is_article:
            articles -= 1
            if not articles:
                flush()
                home = 0
        if name == "a":
            links -= 1

    while pos < end:
        m = TAG.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not away:
            text = page[pos:stop]
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not away:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
            continue
        if name in BLOCKS:
            flush()
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            if name != "head":
                pos = close.end() if close else end
                continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in CLOSES or name in NO_P:
            shut = CLOSES.get(name, {"p"}) | ({"p"} if name in NO_P else set())
            while stack and stack[-1][0] in shut:
                pop()
        gone, body = _named_away(m[3]) if m[3] and not m[3].isspace() else (False, False)
        gone |= name in AWAY or (name == "header" and not articles)
        if name in ("body", "html", "article", "main"):
            gone = False
        is_article = name in ("article", "main") or body
        if is_article:
            if not articles:
                flush()
                count += 1
                home = count
            articles += 1
        away += gone
        links += name == "a"
        stack.append((name, gone, is_article))
    flush()
    return out


def between_surges(found: list[_Line], window: int = 3, threshold: int = 86) -> list[_Line]:
    """Lines of the plateaus of the windowed text lengths that surge over the threshold; the highest plateau where none does."""
    n = len(found)
    length = [max(0, len(x.text) - 2 * x.linked) for x in found]
    total = [sum(length[i : i + window]) for i in range(n)]
    keep, spans, i = [], [], 0
    while i < n:
        if not length[i]:
            i += 1
            continue
        j = i
        while j < n and total[j] > 0:
            j += 1
        spans.append((max(total[i:j]), i, j))
        i = j
    least = min(threshold + 1, max((top for top, _, _ in spans), default=0))
    for top, i, j in spans:
        if top >= least:
            keep += found[i:j]
    return keep


def _mass(kept: list[_Line]) -> int:
    return sum(max(0, len(x.text) - 2 * x.linked) for x in kept)


def main_text(page: str | None, window: int = 3, threshold: int = 86, teaser: float = 2.0) -> str:
    if not page:
        return ""
    found = lines(page)
    parts: dict[int, list[_Line]] = {}
    for x in found:
        if x.home:
            parts.setdefault(x.home, []).append(x)
    kept = every = between_surges(found, window, threshold)
    if parts:
        kept = [x for part in parts.values() for x in between_surges(part, window, threshold)]
        if _mass([x for x in every if not x.home]) > teaser * _mass(kept):
            kept = every
    return "\n".join(x.text for x in kept)


def extract(pages: DataFrame, html_col: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """``pages`` with ``text`` (its main text) in place of the html; other columns pass through."""
    mark = "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in pages.columns), default=0)) + "html"  # a name that no column has
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    source = pages.select(*[f"`{c}`" for c in kept], F.col(html_col).cast("string").alias(mark))
    schema = StructType([*source.schema.fields[:-1], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array((main_text(x.as_py(), window, threshold) for x in b.column(len(kept))), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), texts], [*kept, "text"])

    return source.mapInArrow(run, schema)
