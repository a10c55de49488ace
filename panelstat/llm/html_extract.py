"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags in which words score positive and tags negative; the article
is the contiguous run of highest total, found by one linear scan. A word's weight depends on the
element around it, a tag's on its name, both learned from labelled pages: pages whose own markup
names its article (an `article` or `main` element). Weights are log odds of lying inside that
element, held within fixed bounds; a kind never seen there takes the bounds' default.

Elements whose tag, role, class or id speaks of something else (menus, headers, footers, sidebars,
forms, adverts, notices, comment threads) take a penalty per word beside the learned weights, and are
left out of the run's text if their total is negative; they score next to nothing then, so that one
inside an article does not end it. A name alone never loses an article: an element around the page's
article takes no penalty, nor, on a page that marks none, one that holds over half of the page's
words. Names that may as well stand for a part of an article (headers, related matter) cost little
inside it, so the weights of its words decide: lists of links go, prose stays.

The page's article is the `article` with most words outside comment threads, if it has a third of the
`main` element's (or page's) words at least, else the `main` element. Inside the run, blocks end at
block-level tags; character references are decoded, white space becomes one space, blocks are joined
by a line feed.

Labelled pages: at most `max_pages` distinct ones, those of smallest hash; their kinds of words and
tags, all of them, are the model. Every row is extracted from its whole html.

Edge cases: null, empty and wordless pages give an empty text; a page whose every run is negative
too; of runs of equal score the first and shortest is taken; pages of any length are read in one pass;
unclosed and stray tags, comments and cut references are read as browsers do, without failing, and a
tag that the page's end cuts off is dropped; repeated rows give repeated rows; an empty table returns
none; other columns are ignored.
"""

from __future__ import annotations

import html as html_
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a quote opens a value only after an equals sign
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CUT_TAG = re.compile(r"</?[a-zA-Z]")

# fixed names of the markup language
RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "header"}
HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
COSTLY = (BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}) | {"a", "td", "th", "label", "input", "img"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_\s])(?:{names})(?:$|[-_\s])", re.I)


# words of class and id names: of comment threads, of other matter, of what may be a part of an article
COMMENTS = _words(r"comments?|comment-?list|disqus|replies|respond")
OTHER = _words(
    r"ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|masthead|topbar|footer|sidebar|aside|cookies?|consent|gdpr|"
    r"notices?|popup|modal|newsletter|subscribe|signup|login|breadcrumbs?|pagination"
)
PERHAPS = _words(r"header|related|recommend\w*|widget\w*|share|social|pager|toolbar")
LOW, HIGH, TAG_TOP = -4.0, 4.0, -0.05
UNSEEN_WORD, UNSEEN_LINK, UNSEEN_TAG = 1.0, -1.0, -1.5
PENALTY, SMALL_PENALTY = 2 * HIGH, 0.75
RESULT_SCHEMA = "page_id long, url string, text string, n_chars long"


def _sign(name: str, attributes: str) -> str:
    """What an element's tag, role, class or id speaks of: "comments", "other", "perhaps" or nothing."""
    found = {"perhaps" if name == "header" else "other"} if name in ASIDE else set()
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role":
            found |= {"other"} if value.strip().lower() in ROLES else set()
        elif name not in ("html", "body"):
            found |= {s for s, names in (("comments", COMMENTS), ("other", OTHER), ("perhaps", PERHAPS)) if names.search(value)}
    return next((s for s in ("comments", "other", "perhaps") if s in found), "")


class Element:
    """An element of a page; `words` and `titles` count what it holds."""

    __slots__ = ("kind", "name", "parent", "sign", "titles", "words")

    def __init__(self, name: str, kind: str, sign: str, parent: int):
        self.name, self.kind, self.sign, self.parent = name, kind, sign, parent
        self.words = self.titles = 0


def _kind(name: str, attributes: str) -> str:
    for kind, *values in ATTRIBUTE.findall(attributes):
        if kind.lower() == "class" and "".join(values).split():
            return f"{name}.{''.join(values).split()[0]}"
    return name


def parse(page: str) -> tuple[list[tuple[str, str, int]], list[Element]]:
    """(kind, text, element) of each stretch of text and each tag, and the page's elements in order;
    kinds of words start with `w:`, of tags with `t:`. A tag's text is a line feed if it ends a block."""
    out: list[tuple[str, str, int]] = []
    elements = [Element("", "body", "", -1)]
    open_ = [0]
    at, end, last_tag = 0, len(page), page.rfind(">")
    while at < end:
        if at > last_tag:
            cut = CUT_TAG.search(page, at)
            out.append(("w:" + elements[open_[-1]].kind, page[at : cut.start() if cut else end], open_[-1]))
            break
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                out.append(("w:" + elements[open_[-1]].kind, m[0], open_[-1]))
            continue
        gap = "\n" if name in BLOCK else " " if name in ("br", "td", "th") else ""
        names = [elements[e].name for e in open_]
        if m[1]:
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                out.append(("t:/" + elements[open_[k]].kind, gap, open_[k]))
                del open_[k:]
            continue
        if "head" in names and name not in HEAD:
            del open_[names.index("head") :]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = close.end() if close else end
            continue
        # a new block ends an open paragraph; a list item or row ends one of its kind
        for ended in ({"p"} if name in BLOCK else set()) | ({name} if name in ("li", "td", "th", "tr", "dt", "dd", "option") else set()):
            names = [elements[e].name for e in open_]
            if ended in names:
                k = len(names) - 1 - names[::-1].index(ended)
                if not any(n in ("ul", "ol", "table", "dl", "div", "article", "section", "main") for n in names[k + 1 :]):
                    del open_[k:]
        kind = _kind(name, m[3])
        elements.append(Element(name, kind, _sign(name, m[3]), open_[-1]))
        out.append(("t:" + kind, gap, len(elements) - 1))
        if name not in VOID and not m[0].endswith("/>"):
            open_.append(len(elements) - 1)
    for kind, text, e in out:
        if kind[0] == "w":
            elements[e].words += len(text.split())
    for element in reversed(elements[1:]):
        holder = elements[element.parent]
        holder.words += element.words
        holder.titles += element.titles + (element.name == "h1")
    return out, elements


def _flow(elements: list[Element], given: list[bool]) -> list[bool]:
    """Whether each element or one around it is given."""
    out = list(given)
    for i, element in enumerate(elements[1:], 1):
        out[i] |= out[element.parent]
    return out


def article_of(elements: list[Element]) -> int | None:
    """The element that the page's markup names its article."""
    threads = _flow(elements, [e.sign == "comments" and not e.titles for e in elements])
    best = {}
    for i, element in enumerate(elements):
        if element.name in ("article", "main") and not threads[i]:
            k = best.get(element.name)
            if k is None or element.words > elements[k].words:
                best[element.name] = i
    article, main = best.get("article"), best.get("main")
    if article is None or (main is not None and 3 * elements[article].words < elements[main].words):
        return main
    return article


def penalties(elements: list[Element]) -> tuple[list[float], list[bool]]:
    """Penalty a word of each element by its own sign, and whether it lies in the page's article."""
    article = article_of(elements)
    inside = _flow(elements, [i == article for i in range(len(elements))])
    around, k = set(), article
    while k is not None and k >= 0:
        around.add(k)
        k = elements[k].parent
    out = []
    for i, element in enumerate(elements):
        if article is None:
            spared = 2 * element.words > elements[0].words and (element.sign != "comments" or element.titles > 0)
        else:
            spared = i in around
        if not element.sign or spared or (element.name == "header" and element.sign == "perhaps" and inside[i]):
            out.append(0.0)
        elif element.sign == "perhaps" and (inside[i] or (article is None and element.titles)):
            out.append(SMALL_PENALTY)
        else:
            out.append(PENALTY)
    return out, inside


def _count(batches):
    """(kind, inside, outside) of words and tags on labelled pages."""
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            found, elements = parse(page or "")
            cost, article = penalties(elements)
            other = _flow(elements, [c == PENALTY for c in cost])
            for kind, text, e in found:
                n = len(text.split()) if kind[0] == "w" else 1
                (inside if article[e] and not other[e] else outside)[kind] += n
        kinds = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), *(pa.array([c[k] for k in kinds], pa.int64()) for c in (inside, outside))],
            ["kind", "inside", "outside"],
        )


def learn(pages: DataFrame, max_pages: int = 2_000) -> dict[str, float]:
    """Weight of each kind of token on at most `max_pages` labelled pages. Runs jobs."""
    labelled = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    key = F.xxhash64("html")
    least = [r.k for r in labelled.select(key.alias("k")).distinct().orderBy("k").limit(max_pages).collect()]
    if not least:
        return {}
    # equal pages count once, so copies do not widen the bound
    some = labelled.where(key <= least[-1]).distinct()
    counted = some.mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind")
    rows = counted.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    weights = {r.kind: math.log((r.inside + 0.5) / (r.outside + 0.5)) for r in rows}
    return {k: max(LOW, min(HIGH if k[0] == "w" else TAG_TOP, w)) for k, w in weights.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of highest positive total, the first and shortest of equals; (0, 0) without one."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the page's best run of tokens."""
    found, elements = parse(page or "")
    cost, _ = penalties(elements)
    scores, sums = [], [0.0] * len(elements)
    for kind, text, e in found:
        if kind[0] == "w":
            default = UNSEEN_LINK if elements[e].name == "a" else UNSEEN_WORD
            score = len(text.split()) * weights.get(kind, default)
            sums[e] += score
        else:
            score = weights.get(kind, UNSEEN_TAG if elements[e].name in COSTLY else TAG_TOP)
        scores.append(score)
    for i in range(len(elements) - 1, 0, -1):
        sums[elements[i].parent] += sums[i]
    left = _flow(elements, [c > 0 and total < c * e.words for c, total, e in zip(cost, sums, elements)])
    # what is left out of the text costs next to nothing: an advert inside an article must not end it
    start, stop = best_run([TAG_TOP if left[e] else score for score, (_, _, e) in zip(scores, found)])
    blocks, held = [], []
    for kind, text, e in found[start:stop]:
        if text == "\n" and kind[0] == "t":
            blocks.append("".join(held))
            held = []
        elif not left[e]:
            held.append(text)
        elif kind[0] == "t":
            held.append(" ")
    blocks.append("".join(held))
    clean = (" ".join(html_.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def _extract(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def main_text(pages: DataFrame, max_pages: int = 2_000) -> DataFrame:
    """(page_id, url, text, n_chars) per page. Runs the learning jobs."""
    weights = learn(pages, max_pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(weights), RESULT_SCHEMA)
