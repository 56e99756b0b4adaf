"""Main text of web pages by composite text density.

A page becomes a tree.  What the markup itself calls something else than the
article (menus, forms, asides, adverts, reader comments, ...) is pruned, unless it is a
wrapper that holds most of the page's text.  In the rest
each node gets its composite text density: characters per tag, adjusted for the share of
characters and tags in links, after Sun, Song and Liao, "DOM based content extraction via
text density" (SIGIR 2011).  A node's density sum is the sum over its children; of the
nodes that hold blocks, the one with the largest sum holds the main text.  The smallest density on the
path from it to the body is the threshold: subtrees beside that path are content too if they reach
it, and so are the headings before them.  A parent that adds little to the node (it keeps half of
its density) takes its place, with what it adds.  Tags like ``article`` are nodes like any other.

Work is per page and stays in the task that reads the page; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ready_python

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PRUNED = frozenset("head script style noscript template iframe object svg canvas math nav footer aside form button select textarea dialog menu audio video map".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "tfoot": ("tbody",)}
ROOMS = frozenset("ul ol dl table tbody thead tfoot tr body article section main div td th blockquote".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer foot copyright contentinfo complementary cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist replies respond disqus discussion related recommended recommendations widget toolbar pagination pager skip search banner".split())
OUTER_MARKS = frozenset("header masthead topbar".split())
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
# Elements whose compound names (share-price) say nothing; words that turn a mark round (with-sidebar).
TEXTUAL = frozenset("p li dd dt td th blockquote pre figcaption caption span b i em strong a".split())
TURNED = frozenset("with without no not has is".split())
#: How a node is marked: not, by its tag or as hidden, by a name of its own, by a part of a name.
PLAIN, HARD, NAMED, PARTLY = range(4)

_TAG = re.compile(r"<(?:!--(?:.*?-->|>|->|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """A page's tree: per node its tag, parent, what marks it, and its texts and children in order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marked, self.parts = ["html"], [-1], [PLAIN], [[]]
        self._inside_article = [False]
        self._build(source)

    def _open(self, tag: str, attributes: str, above: int) -> int:
        node = len(self.tag)
        inside = self._inside_article[above] or tag in ("article", "main")
        self.tag.append(tag)
        self.parent.append(above)
        if tag in PRUNED or (tag == "header" and not inside):
            self.marked.append(HARD)
        else:
            self.marked.append(self._mark(tag, attributes, inside) if attributes and tag not in NEVER - {"article"} else PLAIN)
        self.parts.append([])
        self._inside_article.append(inside)
        self.parts[above].append(node)
        return node

    @staticmethod
    def _mark(tag: str, attributes: str, inside: bool) -> int:
        found = PLAIN
        marks = MARKS if inside else MARKS | OUTER_MARKS
        for name, a, b, c in _ATTR.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return HARD
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return HARD
            if name not in ("class", "id", "role"):
                continue
            for token in value.split():
                words = [x.lower() for x in _WORD.findall(token)]
                if token.lower() in marks or (len(words) == 1 and words[0] in marks):
                    found = NAMED
                elif found == PLAIN and tag not in TEXTUAL and marks & set(words) and not TURNED & set(words):
                    found = PARTLY
        return found

    def _build(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        tag, parts = self.tag, self.parts
        low = None
        while at < n:
            m = _TAG.search(source, at)
            if not m:
                parts[stack[-1]].append(source[at:])
                break
            if m.start() > at:
                parts[stack[-1]].append(source[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                block = name in BLOCK
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if not block and tag[stack[k]] in BLOCK:
                        break
                continue
            if name == "html":
                continue
            if name in BLOCK:
                # A block ends an open paragraph, and items end their like in the same list or row.
                closes = ENDS.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    above = tag[stack[k]]
                    if above == "p" or above in closes:
                        del stack[k:]
                        if above == "p" and closes:
                            continue
                        if not closes or name not in ("tr", "tbody", "tfoot"):
                            break
                    elif above in ROOMS and not (name in ("tr", "tbody", "tfoot") and above in ("tr", "tbody", "thead")):
                        break
            node = self._open(name, m.group(3) or m.group(6) or "", stack[-1])
            if name in VOID:
                continue
            if name in RAW:
                low = low or source.lower()
                end = low.find(f"</{name}", at) if len(low) == n else source.find(f"</{name}", at)
                at = n if end < 0 else end
                if name in ("title", "textarea"):
                    continue_text = source[m.end() : at]
                    parts[node].append(continue_text)
                close = source.find(">", at)
                at = n if close < 0 else close + 1
                continue
            stack.append(node)


def _own_chars(page: Page, i: int) -> int:
    return sum(len(html.unescape(x).strip()) for x in page.parts[i] if isinstance(x, str))


def _pruned(page: Page) -> list[bool]:
    """The roots of what is left out.

    A wrapper stays if most of the page's text outside of links is in it, and if its name is
    only partly a mark or a main part, an article or a first heading lies in it.
    """
    n = len(page.tag)
    hard, chars, holds = [m == HARD for m in page.marked], [0] * n, [False] * n
    for i in range(1, n):
        hard[i] = hard[i] or hard[page.parent[i]]
    for i in range(n - 1, 0, -1):
        if hard[i] or page.tag[i] == "a":
            continue
        chars[i] += _own_chars(page, i)
        chars[page.parent[i]] += chars[i]
        if holds[i] or (page.marked[i] == PLAIN and page.tag[i] in ("article", "main", "h1")):
            holds[page.parent[i]] = True
    most = chars[0] / 2
    return [m == HARD or (m == NAMED and not (holds[i] and chars[i] > most)) or (m == PARTLY and chars[i] <= most) for i, m in enumerate(page.marked)]


def _densities(page: Page) -> tuple[list[float], list[bool], int]:
    """Each node's density, whether it is pruned, and the body."""
    n = len(page.tag)
    gone = _pruned(page)
    for i in range(1, n):
        gone[i] = gone[i] or gone[page.parent[i]]
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        own = _own_chars(page, i)
        chars[i] += own
        if in_link[i]:
            links[i] += own
        if i:
            up = page.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = links[body] / max(chars[body], 1)
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not gone[i]:
            t, lc, lt = max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
            base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e)
            density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 2.0))
    return density, gone, body


def _blocks(page: Page, roots: set[int], gone: list[bool]) -> Iterator[str]:
    """The texts of blocks inside ``roots``, in page order."""
    run: list[str] = []
    todo: list[tuple[int | str | None, bool]] = [(0, False)]
    while todo:
        item, inside = todo.pop()
        if item is None or (isinstance(item, int) and (page.tag[item] in BLOCK)):
            if run and (text := " ".join("".join(run).split())):
                yield text
            run = []
        if item is None:
            continue
        if isinstance(item, str):
            if inside:
                run.append(html.unescape(item))
            continue
        if gone[item]:
            continue
        if page.tag[item] == "br" and inside:
            run.append("\n")
        inside = inside or item in roots
        if page.tag[item] in BLOCK:
            todo.append((None, inside))
        todo += [(x, inside) for x in reversed(page.parts[item])]
    if text := " ".join("".join(run).split()):
        yield text


def main_text(source: str | None) -> str:
    """The main text of a page; empty if there is none, or no page.  Blocks are joined by newlines."""
    if not isinstance(source, str) or not source:
        return ""
    page = Page(source)
    density, gone, body = _densities(page)
    sums = [0.0] * len(density)
    for i in range(1, len(density)):
        if not gone[i]:
            sums[page.parent[i]] += density[i]
    inside = [False] * len(density)
    for i in range(body, len(density)):
        inside[i] = i == body or (page.parent[i] >= 0 and inside[page.parent[i]])
    blocks = [False] * len(density)
    for i in range(1, len(density)):
        if not gone[i] and page.tag[i] in BLOCK:
            blocks[page.parent[i]] = True
    inner = [i for i in range(body, len(density)) if inside[i] and not gone[i] and (blocks[i] or i == body)]
    best = max(inner, key=lambda i: (sums[i], density[i], -i), default=body)
    path = [best]
    while path[-1] != body and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    while len(path) > 2 and density[path[1]] >= density[path[0]] / 2:
        best, path = path[1], path[1:]
    roots = {best}
    for i in path[1:]:
        heads = []
        for child in page.parts[i]:
            if isinstance(child, int) and not gone[child] and child not in path:
                if density[child] >= threshold:
                    roots.update(heads, {child})
                    heads = []
                elif page.tag[child] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    heads.append(child)
                elif density[child]:
                    heads = []
            elif child in path:
                roots.update(heads)
                heads = []
    return "\n".join(_blocks(page, roots, gone))


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds the main text of every page as ``text_col``, and its length ``n_chars``.

    Null and empty pages, and pages without text, have an empty text.  The whole page is
    read however long it is.  Rows are independent, so repeated rows and empty tables need
    no care; columns named like the new ones are replaced.
    """
    ready_python(pages.sparkSession)

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return sources.map(main_text, na_action=None)

    out = pages.withColumn("__text", run(html_col)).drop(*[c for c in (text_col, "n_chars") if c in pages.columns])
    return out.withColumnRenamed("__text", text_col).withColumn("n_chars", F.char_length(text_col).cast("long"))
