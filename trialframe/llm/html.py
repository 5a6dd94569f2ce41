"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks.  Features of a block are its words and link density, those
of its neighbours, and whether it stands in a part that is named as no article text.  The tree is
grown on the small labelled table below.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of

#: HTML elements whose text is never shown as text.
UNSEEN = {"script", "style", "noscript", "template", "title", "textarea", "select", "option", "svg", "iframe", "object", "button", "head", "canvas", "math", "audio", "video"}
#: HTML elements that start and end a block.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements and words of class, id or role that name a part which is no article text.
ASIDE = {"nav", "footer", "header", "aside", "form", "menu", "dialog"}
NAMED = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager hidden copyright contentinfo complementary banner".split())
#: Words with which such a name tells the layout of a part, not its role.
NEUTRAL = {"has", "with", "no", "without", "open", "closed", "layout"}
#: Boundaries that an inner element does not pass.
KEPT = BLOCKS - {"p", "hr"} | {"a"}

#: Features of a block, in the order of the labelled table.
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "aside", "main")
#: The labelled table: features as above, then 1 for article text.
LABELLED = [
    (8, 0.0, 1, 1.0, 40, 0.0, 0, 1, 1), (1, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1), (60, 0.0, 8, 0.0, 55, 0.0, 0, 1, 1), (55, 0.05, 60, 0.0, 12, 0.0, 0, 1, 1),
    (12, 0.0, 55, 0.0, 90, 0.1, 0, 1, 1), (90, 0.1, 12, 0.0, 1, 0.0, 0, 1, 1), (1, 0.0, 90, 0.1, 14, 0.0, 0, 1, 1), (25, 0.3, 40, 0.0, 40, 0.0, 0, 1, 1),
    (3, 0.0, 200, 0.0, 180, 0.0, 0, 1, 1), (180, 0.0, 3, 0.0, 10, 0.0, 0, 1, 1), (6, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (30, 0.0, 9, 0.0, 6, 0.0, 0, 1, 1),
    (2, 1.0, 50, 0.0, 45, 0.0, 0, 1, 1), (7, 1.0, 30, 0.1, 25, 0.0, 0, 1, 1), (70, 0.0, 0, 0.0, 65, 0.0, 0, 0, 1), (65, 0.02, 70, 0.0, 30, 0.0, 0, 0, 1),
    (30, 0.0, 65, 0.02, 4, 1.0, 0, 0, 1), (20, 0.0, 45, 0.0, 50, 0.0, 0, 0, 1), (9, 0.0, 3, 0.9, 75, 0.0, 0, 0, 1), (6, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1), (11, 0.0, 2, 1.0, 30, 0.1, 0, 0, 1), (5, 0.0, 80, 0.0, 60, 0.0, 0, 0, 1),
    (5, 0.0, 40, 0.0, 3, 1.0, 0, 1, 1), (1, 0.0, 30, 0.0, 2, 1.0, 0, 1, 1), (2, 0.0, 1, 1.0, 3, 1.0, 0, 1, 1), (8, 0.0, 2, 1.0, 9, 0.8, 0, 1, 1),
    (12, 0.5, 3, 0.5, 4, 0.9, 0, 1, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1), (3, 1.0, 40, 0.0, 5, 1.0, 0, 1, 1), (20, 0.9, 3, 1.0, 6, 0.4, 0, 1, 1),
    (30, 0.0, 8, 0.0, 3, 1.0, 0, 1, 1), (4, 0.0, 9, 0.0, 2, 1.0, 0, 1, 1), (60, 0.0, 12, 0.0, 5, 1.0, 0, 1, 1), (10, 0.1, 4, 0.0, 1, 1.0, 0, 1, 1),
    (3, 0.0, 15, 0.0, 1, 1.0, 0, 1, 1), (45, 0.2, 3, 0.0, 2, 1.0, 0, 1, 1), (7, 0.0, 6, 0.5, 3, 1.0, 0, 1, 1), (18, 0.0, 2, 0.0, 4, 1.0, 0, 1, 1),
    (14, 0.0, 30, 0.0, 22, 0.1, 0, 0, 1), (110, 0.2, 6, 0.0, 95, 0.1, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0),
    (25, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0), (14, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0), (6, 0.5, 45, 0.0, 0, 0.0, 1, 0, 0), (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0),
    (35, 0.0, 30, 0.0, 35, 0.0, 1, 1, 0), (60, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0), (3, 0.0, 60, 0.0, 35, 0.0, 1, 1, 0), (12, 1.0, 50, 0.0, 60, 0.0, 1, 1, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (4, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0), (5, 0.8, 40, 0.0, 6, 0.9, 0, 0, 0),
    (6, 0.9, 5, 0.8, 0, 0.0, 0, 0, 0), (10, 0.7, 8, 0.8, 7, 0.9, 0, 0, 0), (2, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0), (1, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0),
    (20, 0.6, 4, 1.0, 5, 1.0, 0, 0, 0), (15, 0.9, 30, 0.0, 12, 0.9, 0, 0, 0), (4, 0.5, 0, 0.0, 5, 0.6, 0, 0, 0), (8, 1.0, 100, 0.0, 0, 0.0, 0, 0, 0),
]

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)


def _aside(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element starts a part that is no article text; a ``header`` inside an article holds its title."""
    if name in ASIDE and not (inside and name == "header"):
        return True
    if not attributes.strip() or name in ("body", "html"):
        return False
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
            if parts & NAMED and not parts & NEUTRAL and (name not in ("article", "main") or token.lower() in NAMED):
                return True
    return bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, aside, main) of every text block, in page order.

    Comments, declarations and unseen elements have no text; an element that is never closed ends
    with the one around it; a tag that the page's end cuts is no text.
    """
    found: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()  # names on the stack
    parts: list[str] = []
    linked, at, size = 0, 0, len(page)
    state = (False, False)

    def pop() -> str:
        nonlocal state
        name = stack.pop()[0]
        opened[name] -= 1
        state = stack[-1][1:] if stack else (False, False)
        return name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                found.append((text, n, min(n, linked), *state))
            parts.clear()
        linked = 0

    while at < size:
        lt = page.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at:
            text = _html.unescape(page[at:lt])
            parts.append(text)
            if opened["a"]:
                linked += len(text.split())
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[at : at + 3]):
                break
            parts.append("<")
            at += 1
            continue
        name, closing, at = m[1].lower(), page[at + 1] == "/", m.end()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
        elif name in UNSEEN and not m[2].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if not end and name == "head":
                end = re.compile(r"(?=<body[\s>])", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif name in KEPT and name not in VOID and not m[2].endswith("/"):
            if name in ("li", "dt", "dd", "tr", "td", "th", "a") and stack and stack[-1][0] == name:
                pop()
            state = (state[0] or _aside(name, m[2], state[1]), state[1] or name in ("article", "main"))
            stack.append((name, *state))
            opened[name] += 1
    flush()
    return found


def rows_of(page: list[tuple[str, int, int, bool, bool]]) -> list[tuple]:
    """The features of each block, see FEATURES."""
    own = [(0, 0.0), *((n, k / n) for _, n, k, _, _ in page), (0, 0.0)]
    return [(*own[i + 1], *own[i], *own[i + 2], int(x[3]), int(x[4])) for i, x in enumerate(page)]


def grow(table: Sequence[tuple], depth: int = 6) -> tuple:
    """A decision tree by Gini impurity; leaves are (label,), inner nodes (feature, threshold, low, high)."""
    labels = [r[-1] for r in table]
    ones = sum(labels)
    if depth == 0 or ones in (0, len(labels)):
        return (int(2 * ones >= len(labels)),)
    best = None
    for f in range(len(table[0]) - 1):
        values = sorted({r[f] for r in table})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            cost = 0.0
            for side in ([r[-1] for r in table if r[f] <= cut], [r[-1] for r in table if r[f] > cut]):
                p = sum(side) / len(side)
                cost += len(side) * p * (1 - p)
            best = min(best or (1e9,), (cost, f, cut))
    if best is None:
        return (int(2 * ones >= len(labels)),)
    _, f, cut = best
    return f, cut, grow([r for r in table if r[f] <= cut], depth - 1), grow([r for r in table if r[f] > cut], depth - 1)


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> tuple[str, int, int]:
    """(text, blocks, article blocks)."""
    own = blocks(page or "")
    kept = [x[0] for x, r in zip(own, rows_of(own), strict=True) if decide(tree, r)]
    return "\n".join(kept), len(own), len(kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: Sequence[tuple] = tuple(LABELLED)) -> DataFrame:
    """``keep``, the article text, its code points and the counts of blocks, for every row; nothing is shuffled.

    A null or empty page has an empty text; rows are independent, so repeated ones and null ids are
    rows like others and an empty table gives none.  ``keep`` must not name a column that is added
    (ValueError); other columns are not looked at, whatever their names.
    """
    clear_of(keep, "text", "n_chars", "n_blocks", "n_article_blocks")
    tree = grow(labelled)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(t, len(t), n, k) for t, n, k in (main_text(x, tree) for x in b["__html"])]
            yield pd.concat([b.drop(columns="__html"), pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "n_article_blocks"])], axis=1)

    kept = pages.select(*keep, F.col(html).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema), "text string, n_chars long, n_blocks long, n_article_blocks long"])
    return kept.mapInPandas(batches, schema)
