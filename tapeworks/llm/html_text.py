"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; words of
menus, adverts and other furniture, and those outside a page's main element, score
negative, too. Tags and furniture within the main element score nothing, and furniture there is left out, so
that no part of an article is lost to its markup. A linear
scan finds the contiguous region of the highest sum. The weights are log-odds of being inside the main element,
counted over the labelled pages: those whose own markup marks an article or main element.
"""

from __future__ import annotations

import html
import re
from functools import partial
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# Element names of HTML.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "xmp", "iframe"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "head", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
# Marks by which an article element is itself furniture.
NOT_MAIN = {"ad", "ads", "advert", "comment", "comments", "promo", "promoted", "related", "replies", "reply", "sidebar", "sponsored", "teaser"}
# Words of class, id and role names that mark furniture.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

# Marks that say so as the first or the last part of a name, whatever the rest; words of layout; names of content.
SURE = {"ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "disqus", "footer", "gdpr", "nav", "navbar", "newsletter", "pagination", "promo", "related", "replies", "sidebar", "sponsored"}
LAYOUT = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "more", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}
CONTENT = {"article", "body", "content", "entry", "post", "story", "text"}
# Elements that end furniture which is never closed, and that end one of their own kind.
ENDS = {"blockquote", "div", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "section", "table"}
AGAIN = {"dd", "dt", "li", "option", "p", "td", "th", "tr"}

# Other element names with a weight of their own; all further names share one.
OTHER = {"blockquote", "body", "caption", "center", "colgroup", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "html", "li", "ol", "option", "p", "picture", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "video"}
NAMES = RAW | FURNITURE | VOID | INLINE | MAIN | OTHER

#: Characters of scripts that are written without spaces; two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[^a-z]+")


def _named(attributes: str) -> list[str]:
    return [name for groups in _NAMED.findall(attributes) for name in "".join(groups).lower().split()]


def _marked(attributes: str, marks: set[str] = MARKS) -> bool:
    """Whether an element's names say that it is furniture: a name that is a mark, or is made of marks and words
    of layout only, or begins or ends with a mark that nothing else would; or it is hidden. An element that is also named
    as content is none."""
    names = _named(attributes)
    if not CONTENT.intersection(names):
        for name in names:
            parts = [p for p in _PART.split(name) if p]
            own = [p for p in parts if p in marks]
            if own and (all(p in marks or p in LAYOUT for p in parts) or parts[0] in SURE or parts[-1] in SURE):
                return True
    return bool(_HIDDEN.search(attributes))


def items(page: str):
    """(kind, value, furniture, inside) in page order. kind "text": value is the raw text of
    a run; kind "tag": value is (closes, name). inside: within the page's main element. Furniture ends with its own element or
    with the one around it; if the page never closes it, with the next paragraph, heading or division."""
    at, lower, loose, main, ahead = 0, None, False, 0, {}
    # Open elements and how many there are of each name, within each main element on its own: tags that do not fit
    # never close one. skip: how deep the furniture begins, None outside of it.
    scopes: list[tuple[list[str], dict[str, int]]] = [([], {})]
    kinds: list[bool] = []  # of open main elements: whether they are the page's
    skip: tuple[int, int] | None = None

    def found(text: str) -> int:
        """Where text comes next from here on; each text is looked for once for each place that it has."""
        nonlocal lower
        if lower is None:
            lower = low if len(low := page.lower()) == len(page) else page
        if ahead.get(text, -1) < at:
            place = lower.find(text, at)
            ahead[text] = len(page) if place < 0 else place
        return ahead[text]

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield "text", page[at:end], skip is not None, main > 0
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closes, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        alone = name in VOID or name in RAW or attributes.rstrip().endswith("/")
        stack, many = scopes[-1]
        here = (len(scopes), len(stack))
        if name in MAIN:
            if not closes:
                own = not _marked(attributes, NOT_MAIN)
                skip, loose = (None if own else skip or here), False
                kinds.append(own)
                scopes.append(([], {}))
                main += own
            elif kinds:
                main -= kinds.pop()
                scopes.pop()
        elif skip and not closes and (name == "body" or loose and name in ENDS):
            skip = None
        if not skip and not closes and not alone and name not in MAIN and name not in ("html", "body"):
            furniture = name in FURNITURE or _marked(attributes)
            if furniture and name == "header" and main and any(found(f"<h{i}") < found("</header") for i in range(1, 7)):
                furniture = False  # an article's own header, with its heading
            if furniture:
                skip, loose = here, found("</" + name) == len(page)
        if closes and many.get(name) and name not in MAIN:
            while True:
                last = stack.pop()
                many[last] -= 1
                if last == name:
                    break
        elif not closes and not alone and name not in MAIN:
            if name in AGAIN and stack and stack[-1] == name and (not skip or (len(scopes), len(stack) - 1) > skip):
                stack.pop()
                many[name] -= 1
            stack.append(name)
            many[name] = many.get(name, 0) + 1
        if closes and skip and (len(scopes), len(scopes[-1][0])) <= skip:
            skip = None
        yield "tag", (closes, name), skip is not None, main > 0
        if name in RAW and not closes:
            at = found("</" + name)


def words_in(text: str) -> float:
    """The number of words of a text; what is written without spaces counts by its length."""
    return len(text.split()) + (0 if text.isascii() else len(_UNSPACED.findall(text)) / 2)


def name_of(tag: str) -> str:
    """The name under which a tag is weighed."""
    return tag if tag in NAMES else "?"


@lean
def _learn(batches):
    tally: dict[tuple[str, bool], int] = {}
    for batch in batches:
        for page in batch.column(0).to_pylist():
            own: dict[tuple[str, bool], int] = {}
            labelled = False
            for kind, value, furniture, inside in items(page or ""):
                labelled |= inside
                if furniture and inside:
                    continue
                key = ("" if kind == "text" else name_of(value[1]), inside)
                own[key] = own.get(key, 0) + (round(words_in(value)) if kind == "text" else 1)
            if labelled:
                for k, v in own.items():
                    tally[k] = tally.get(k, 0) + v
    rows = [(k[0], k[1], v) for k, v in tally.items()]
    if rows:
        a, b, c = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.bool_()), pa.array(c, pa.int64())], ["name", "inside", "n"])


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights by tag name (one of NAMES, or "?" for all others), and of a word under "":
    log-odds of being in the main element. Words weigh 1 to 5, tags -5 to -0.1."""
    rows = pages.select(F.col(html_col).cast("string")).mapInArrow(_learn, "name string, inside boolean, n long")
    per = rows.groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    got = {r.name: log((r.a + 1) / (r.b + 1)) for r in per.collect()}
    return {k: min(5.0, max(1.0, v)) if k == "" else max(-5.0, min(-0.1, v)) for k, v in got.items()}


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line ends; "" if no word scores."""
    word, seen = weights.get("", 1.0), list(items(page))
    has_main = any(inside for *_, inside in seen)
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for at, (kind, value, furniture, inside) in enumerate(seen):
        if inside and (furniture or kind == "tag"):
            continue
        if kind == "text":
            score = word * words_in(value) * (-1 if furniture or has_main and not inside else 1)
        else:
            score = weights.get(name_of(value[1]), -1.0)
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, best_range = total, (start, at + 1)
    blocks, block = [], []
    for kind, value, furniture, inside in seen[slice(*best_range)]:
        if kind == "text":
            if not furniture and (inside or not has_main):
                block.append(value)
        elif value[1] == "br":
            block.append(" ")
        elif value[1] not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


@lean
def _extract(batches, weights):
    for batch in batches:
        texts = [main_text(p or "", weights) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """One row per page: id, url, text (main text; empty if there is none), n_chars.

    Null and empty pages have the text "". Repeated rows stay; ids and urls may be null.
    Broken markup is read as far as it goes, pages of any length in linear time. Without
    labelled pages or given weights a word scores 1 and a tag -1. Where a page has main elements only their text is taken,
    captions and a header with the article's heading included, its own footer not. Text without spaces scores by its length. Other columns are
    ignored. Rows are independent; only the tag counts are shuffled."""
    if weights is None:
        weights = learn_weights(pages, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(partial(_extract, weights=weights), f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
