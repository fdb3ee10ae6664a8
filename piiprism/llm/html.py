"""Main text of web pages by consensus host paths.

A page is cut into text blocks, each under a path of containers (tags with their classes, digits generalised); the
page itself is the container of what stands in no other, and its path is empty. Every container of a page is scored by
the text it holds for itself, less what stands in links, and the best one's path is the page's vote, or that of a
container around it that has the rest of the same text. Votes are counted in Spark by host, weighed by score; a host's
winning path (among those whose votes come within a half of the most, the one nearest to the root) is then used to
extract all pages of that host again. A page without the winning path falls back on its own vote.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are no part of the
text wherever they stand; they are known by their tags and by whole tokens of a class, id or role, and an element
that holds the page's main element or all its articles is none of them. Character references are decoded, white space in a block becomes one space, blocks are
joined by two line feeds. Tags that are left open end with their container, as in browsers.

Nulls: null or empty html has no text; pages with a null or odd url vote and read as one host. Ties between paths go to
the heavier, then the shorter, then the first by code point. Repeated rows are pages of their own. Columns other than page_id, url and
html are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe canvas textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside body details dialog div fieldset figure footer form header main menu nav ol section table td ul".split())
#: Containers that are a part of a text, never the whole of one that goes on around them.
PART = frozenset("details figure ol section table td ul".split())
SKIPPED = frozenset("nav header footer aside form menu button select option dialog head label fieldset search".split())
#: Of these, what keeps its articles out of the text (readers' comments, teasers) if it holds no main element.
APART = frozenset("comment comments disqus recommended related reply replies respond".split())
APART_TAGS = SKIPPED - frozenset("dialog fieldset form".split())
#: Words of a class, id or role that mark what is not the article.
OFF = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget alert overlay".split())
#: Words before and after these that name a place or part: site-footer, sidebar-left. A token with any other word, as
#: has-sidebar, comments-open, article-header or form-page, marks nothing.
BEFORE = frozenset("bottom desktop global google left main mobile primary right secondary site sticky sub top".split())
AFTER = frozenset("area bar block body bottom box buttons container content footer header icons inner item left links list main section text top right unit wrap wrapper".split())
#: Bytes of all hosts' winning paths up to which they are sent to every task; beyond, parts that a host's pages are dealt to.
BROADCAST, SALTS = 16 << 20, 32
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCK - frozenset(("html", "body"))
#: A quote counts in a tag only directly after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?>=\s*(?>\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")


@lru_cache(4096)
def _marks(token: str) -> frozenset[str]:
    """Words of OFF that a token of a class, id or role is made of, with words of places around them."""
    words = [w for w in PARTS.split(token.lower()) if len(w) > 1]
    first = next((i for i, w in enumerate(words) if w in OFF), None)
    if first is None or not set(words[:first]) <= BEFORE or not set(words[first:]) <= OFF | AFTER:
        return frozenset()
    return OFF.intersection(words)


def _attributes(text: str) -> tuple[str, bool, bool]:
    """(generalised classes, whether they mark something that is not the article, and that it keeps articles apart)."""
    if not text.strip():
        return "", False, False
    cls, off, apart = "", False, False
    for name, a, b, c in ATTR.findall(text):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            off = True
        elif name in ("class", "id", "role"):
            if name == "class":
                cls = ".".join(sorted(DIGITS.sub("0", value).split()))
            for token in value.split():
                if marks := _marks(token):
                    off, apart = True, apart or bool(marks & APART)
    return cls, off, apart


class Containers:
    """The containers of a page as nodes of a tree; node 0 is the page, and a parent comes before its children."""

    def __init__(self):
        self.parent, self.step, self.depth, self.known = [0], [""], [0], {}

    def child(self, node: int, step: str) -> int:
        new = self.known.setdefault((node, step), len(self.parent))
        if new == len(self.parent):
            self.parent.append(node)
            self.step.append(step)
            self.depth.append(self.depth[node] + 1)
        return new

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return "/".join(reversed(steps))

    def find(self, path: str) -> int | None:
        node = 0
        for step in path.split("/") if path else ():
            node = self.known.get((node, step))
            if node is None:
                return None
        return node


Block = tuple[int, str, int]


def blocks(page: str) -> tuple[list[Block], Containers]:
    """(container, text, characters of it in links) of each text block outside what is skipped, in page order."""
    out, held, articles, tree = _read(page, frozenset())
    keep = frozenset(at for at, (apart, n, mains) in held.items() if mains or (n == articles and not apart))
    if keep:
        out, _, _, tree = _read(page, keep)
    return out, tree


def _read(page: str, keep: frozenset[int]) -> tuple[list[Block], dict[int, list[int]], int, Containers]:
    """(blocks, by position of each skipped element that holds any: [apart, articles, mains], articles of the page,
    containers); elements that begin at a position in keep are not skipped."""
    out: list[Block] = []
    tree = Containers()
    held: dict[int, list[int]] = {}
    articles = mains = 0
    stack: list[tuple[str, int]] = []  # (tag, 0 or where it began if it is skipped with what is inside)
    aside: dict[int, tuple[bool, int, int]] = {}  # by where a skipped element began: whether it keeps articles apart, articles and mains before it
    places: dict[str, list[int]] = {}  # by tag, where open elements of it stand in the stack
    open_blocks: list[int] = []  # and those of BLOCK
    path: list[tuple[int, int]] = [(-1, 0)]  # (depth in stack, container)
    buffer: list[str] = []
    state = {"link": 0, "linked": 0, "skip": 0}

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                out.append((path[-1][1], text, min(state["linked"], len(text))))
            buffer.clear()
        state["linked"] = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, off = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()
                flush()
            if tag == "a":
                state["link"] -= 1
            if off:
                state["skip"] -= 1
                apart, some, more = aside[off]
                if articles > some or mains > more:
                    held[off] = [apart, articles - some, mains - more]
            if path[-1][0] == len(stack):
                path.pop()

    def last(tags: frozenset | set, until: frozenset = frozenset()) -> int | None:
        """Where the innermost open element of some tags stands, unless one of the others stands within it."""
        top = lambda some: max((places[t][-1] for t in some if places.get(t)), default=-1)
        i = top(tags)
        return i if i >= 0 and i > top(until - tags) else None

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        data = page[at : m.start() if m else n]
        if data and not state["skip"]:
            buffer.append(data)
            if state["link"]:
                state["linked"] += len(data)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                buffer.append(" ")
            elif tag == "p" and last({"p"}) is None:
                flush()
            elif tag in BLOCK or not open_blocks or open_blocks[-1] <= (last({tag}) or 0):
                i = last({tag})
                if i is not None:
                    close(i)
        elif m[2]:
            tag, rest = m[2].lower(), m[3] or ""
            if tag in RAW:
                if tag != "svg" or not rest.rstrip().endswith("/"):  # only foreign elements can close themselves
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if tag in ENDS_P:
                i = last({"p"}, CONTAINER)
                if i is not None:
                    close(i)
                flush()
            if tag == "li":
                i = last({"li"}, frozenset(("ul", "ol", "menu")))
                if i is not None:
                    close(i)
            elif tag in ("dt", "dd"):
                i = last({"dt", "dd"}, frozenset(("dl",)))
                if i is not None:
                    close(i)
            elif tag in ("td", "th", "tr"):
                i = last({"td", "th"} if tag != "tr" else {"tr"}, frozenset(("table",)))
                if i is not None:
                    close(i)
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                continue
            cls, off, apart = _attributes(rest)
            off = ((off and tag not in ("html", "body", "article", "main")) or tag in SKIPPED) and at not in keep
            if tag in ("article", "main"):
                articles += tag == "article"
                mains += tag == "main"
            if off and not state["skip"] and tag in BLOCK:
                flush()
            if off:
                state["skip"] += 1
                aside[at] = apart or tag in APART_TAGS, articles, mains
            if tag == "a":
                state["link"] += 1
            if tag in CONTAINER:
                path.append((len(stack), tree.child(path[-1][1], f"{tag}.{cls}" if cls else tag)))
            if tag in BLOCK:
                open_blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, at if off else 0))
    close(0)
    flush()
    return out, held, articles, tree


def vote(found: list[Block], tree: Containers) -> tuple[str, float] | None:
    """(path, score) of a page's best container.

    A block gives its characters outside links to its container, half to the container's parent and so on up to the
    page; an article or main element counts double. Sections of one path are scored together and can beat the article
    that holds them, so the vote goes from the best container up to one around it that has text of its own, if what it
    leaves is a part of a text (PART) or that text is a tenth of the best score; never out of an article or main.
    """
    if not found:
        return None
    own = [0] * len(tree.parent)
    holds = [False] * len(tree.parent)
    for node, text, linked in found:
        own[node] += len(text) - 2 * linked
        holds[node] = True
    score = [float(x) for x in own]
    for node in range(len(score) - 1, 0, -1):
        score[tree.parent[node]] += score[node] / 2
        holds[tree.parent[node]] |= holds[node]

    def tag(node: int) -> str:
        return tree.step[node].split(".")[0]

    weight = [s * (2 if tag(n) in ("article", "main") else 1) for n, s in enumerate(score)]
    top = max((w, -d) for w, d, h in zip(weight, tree.depth, holds, strict=True) if h)
    ties = [n for n, h in enumerate(holds) if h and (weight[n], -tree.depth[n]) == top]
    best = min(ties, key=tree.path) if len(ties) > 1 else ties[0]
    wins = node = best
    while node and tag(node) not in ("article", "main"):
        around = tree.parent[node]
        if own[around] > 0 and (tag(node) in PART or 10 * own[around] >= score[best]):
            wins = around
        node = around
    return tree.path(wins), max(score[best], 0.0)


def inside(found: list[Block], tree: Containers, path: str) -> list[str]:
    """The texts of the container with a path and of all in it."""
    root = tree.find(path)
    if root is None:
        return []
    held = [False] * len(tree.parent)
    held[root] = True
    for node in range(root + 1, len(held)):
        held[node] = held[tree.parent[node]]
    return [text for node, text, _ in found if held[node]]


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: one row for each page that has a container with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, *v) for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) if (v := vote(*blocks(page or "")))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["host", "path", "score"])

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(common.lean(run), "host string, path string, score double")


def consensus(cast: DataFrame) -> DataFrame:
    """host, path: the winning path of each host. Votes count by page, heavier pages a little more; of the paths with
    half of the heaviest path's votes or more, the one with the fewest steps wins."""
    by = cast.groupBy("host", "path").agg(F.round(F.sum(F.log1p("score")), 6).alias("weight"))
    near = by.withColumn("most", F.max("weight").over(Window.partitionBy("host"))).where("2 * weight >= most")
    steps = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return near.groupBy("host").agg(F.min_by("path", F.struct(steps, -F.col("weight"), F.length("path"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    winners = common.written(consensus(votes(pages)), "html-paths")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True):
                found, tree = blocks(page or "")
                text = [] if path is None else inside(found, tree, path)
                if not text and found:
                    text = inside(found, tree, vote(found, tree)[0])
                texts.append("\n\n".join(text))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST:  # the pages stay where they are
        chosen = named.join(F.broadcast(winners), "host", "left")
    else:  # a host's pages are dealt over SALTS tasks
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chosen = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return chosen.select("page_id", "url", "html", "path").mapInArrow(common.lean(run), f"page_id {kind}, url string, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
