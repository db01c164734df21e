"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block the cost of calling it content and of
calling it boilerplate, which become the capacities from the source and to the sink. Smoothness edges tie neighbouring
blocks, more so in the same container, and each block to the one before it in its container, whatever lies between.
The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

SLICE_BYTES = 8 << 20
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may follow in a tag; a quoted value is found by its closing quote. No part of it can match in two ways.
PART = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RAW = {"script", "style", "template", "textarea", "title", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo mrow ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
#: Elements that aren't graphics: they end an unclosed one.
BREAKOUT = set("blockquote body div dl dt dd h1 h2 h3 h4 h5 h6 hr li main ol p pre section table ul article".split())
#: Elements that a new one of the key ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AWAY = {"nav", "header", "footer", "aside", "button", "select", "dialog", "menu", "fieldset", "label", "svg"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of classes and ids by which what isn't the main text is marked, those that sections of a text may have as well,
#: and those of headers, which belong to the text inside it. An id made of a heading's words is no mark for UNSURE ones.
BOUND = r"(?:^|[\s_-])(?:{})(?:$|[\s_-]|\d)"
STRONG = re.compile(
    BOUND.format(
        r"ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|"
        r"sidebar|widgets?|related|recommend(?:ed|ations)?|share|sharing|social|comments?|commentlist|replies|reply|respond|disqus|footer|masthead|topbar|pagination|pager|toolbar|copyright|skip"
    ),
    re.I,
)
UNSURE = re.compile(BOUND.format(r"banner|sponsor(?:ed)?|promo(?:tion)?s?|consent|notice|menu|related|recommend(?:ed|ations)?|share|sharing|social|replies|reply|respond|copyright|skip"), re.I)
WEAK = re.compile(BOUND.format(r"side|rail|tags?|search|legal|alert|foot|overlay|discussion"), re.I)
HEADS = re.compile(BOUND.format(r"header|head"), re.I)
#: Classes that tell what a page has or hasn't, and frames around the main text and others.
ABOUT = re.compile(r"(?:has|with|no|without|is|tag|category)[_-]", re.I)
FRAME = re.compile(r"(?:article|content|main|post|entry|story|body)[_-].*(?:wrap|wrapper|container|layout|grid|row)$", re.I)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|entry|story|body|text|blogpost|prose)(?:$|[\s_-]|\d)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}

# Weights of the block classifier: the score is content's log odds.
# Two marks (a strong one counts twice) or an element that is never text outweigh all that speaks for content.
BIAS, IN_ARTICLE, IN_MAIN, MARKED_GOOD, MARKED_BAD, AWAY_TAG = 0.2, 3.0, 1.5, 1.5, -6.0, -12.0
LINKED, LENGTH, SENTENCE, HEADING, CONTROL = -4.0, 0.6, 0.4, 0.3, -1.0
#: On a page that nothing marks the main text of, but that has blocks of LONG_WORDS: of a block outside lists, tables and headings.
BARE, LONG_WORDS = -1.4, 25
#: Of a short block that says whose the page is.
RIGHTS = -3.0
#: Smoothness of neighbours, and what is added in the same container; both shrink with the gap between containers.
#: APART: of a block and the one before it in its container, with others between.
NEAR, SAME, APART = 0.4, 0.5, 0.2


class Block:
    """depth: containers around it; home: the number of the outer one of the last two; shared: those in common with the block before.

    linked and marked: the words in links and in inline elements that are marked.
    """

    __slots__ = ("parts", "linked", "marked", "size", "depth", "home", "shared", "good", "bad", "article", "main", "away", "heading", "item", "plain")

    def __init__(self, depth: int, home: int, shared: int, state: tuple, tag: str):
        self.parts, self.linked, self.marked, self.size = [], 0, 0, 0
        self.depth, self.home, self.shared = depth, home, shared
        self.article, self.main, self.good, self.bad, self.away = *state[:4], state[4] + state[5]
        self.heading, self.item = tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("li", "option")
        self.plain = not self.heading and tag not in ("li", "dt", "dd", "td", "th", "caption", "pre", "blockquote", "figcaption")


def mark_of(names: dict[str, str], tag: str, inside: bool) -> tuple[int, bool]:
    """How surely an element's class and id mark it as other than main text (0 to 2), and whether they mark it as such."""
    if tag in ("html", "body") or not ("class" in names or "id" in names):
        return 0, False
    split = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names.get(k, "")) for k in ("class", "id")]
    classes = " ".join(w for w in split[0].split() if not ABOUT.match(w) and not FRAME.match(w))
    own = "" if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or FRAME.match(split[1]) else split[1]
    if STRONG.search(classes) or STRONG.search(own) and not UNSURE.search(own):
        return 2, False
    if WEAK.search(classes) or UNSURE.search(own) or not inside and (WEAK.search(own) or HEADS.search(f"{classes} {own}")):
        return 1, False
    return 0, bool(POSITIVE.search(" ".join(split)))


def element_state(state: tuple, tag: str, attributes: str) -> tuple:
    """(article, main, good, bad, away, forms) inside an element."""
    article, main, good, bad, away, forms = state
    names = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = names.get("role", "").lower()
    inside = bool(article or main or good)
    marks, is_good = mark_of(names, tag, inside)
    if tag == "main" or role == "main":  # there is one, whatever its frame is called
        main, bad, away, forms = main + 1, 0, 0, 0
    if tag == "article" and not (bad or away or marks):
        # An article within comments or a sidebar doesn't lead back to the main text; a form around it is the page's.
        article, forms = article + 1, 0
    bad, good = bad + marks, good + is_good
    forms += tag == "form"
    if tag in AWAY and not (tag == "header" and inside) or role in ROLES:
        away += 1
    if "hidden" in re.split(r"[\s=]", attributes.lower()) or names.get("aria-hidden") == "true" or HIDDEN.search(names.get("style", "")):
        away += 1
    return article, main, good, bad, away, forms


def skipped(page: str, at: int) -> int:
    """The position behind a comment, CDATA section, declaration or processing instruction."""
    for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
        if page.startswith(begin, at):
            found = page.find(close, at + (2 if begin == "<!--" else len(begin)))
            if found >= 0:
                return found + len(close)
            if begin == "<!--":
                return len(page)
    return len(page)


def tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """The position behind the tag whose name ends at ``at``.

    A quote without a closing one ends with the next >, as the tag does. ``quotes`` has each quote's last place.
    """
    end = len(page)
    while at < end:
        at = PART.match(page, at).end()
        if at >= end:
            return end + 1
        if page[at] == ">":
            return at + 1
        if quotes[page[at]] <= at:
            found = page.find(">", at)
            return found + 1 if found >= 0 else end + 1
        value = page.find(page[at], at + 1)
        # A value with a tag in it has lost its closing quote.
        broken = page.find("<", at, value)
        if broken >= 0 and (early := page.find(">", at, broken)) >= 0:
            return early + 1
        at = value + 1
    return end + 1


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, without scripts, styles and comments."""
    out: list[Block] = []
    # Of each open element: tag and state; of the container that it is or is in: state, tag, number, the one around it, depth.
    stack: list[tuple] = [("", (0,) * 6, (0,) * 6, "", 0, -1, 1)]
    is_open = Counter()
    number, block, links, low = 0, None, 0, 1

    def close_down_to(k: int) -> None:
        nonlocal links, low
        for element in stack[k:]:
            is_open[element[0]] -= 1
            links -= element[0] == "a"
        del stack[k:]
        low = min(low, stack[-1][6])

    def text(raw: str) -> None:
        nonlocal block, low
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            _, _, state, tag, _, home, depth = stack[-1]
            block = Block(depth, home, min(low, depth), state, tag)
            low = depth
            out.append(block)
        raw = html.unescape(raw)
        block.parts.append(raw)
        size = len(raw.split())
        block.size += size
        block.linked += size if links else 0
        block.marked += size if stack[-1][1][3:] != stack[-1][2][3:] else 0

    pos, end = 0, len(page)
    quotes = {q: page.rfind(q) for q in "\"'"}
    raw_end = {}
    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        text(page[pos:at])
        first = page[at + 1 : at + 2]
        if first in ("!", "?"):
            pos = skipped(page, at)
            continue
        closing = first == "/"
        m = NAME.match(page, at + 1 + closing)
        if not m:
            if closing:  # as browsers do, a comment up to the next >
                pos = page.find(">", at) + 1 or end
            else:
                text("<")
                pos = at + 1
            continue
        begin = m.end()
        pos = tag_end(page, begin, quotes)
        tag, attributes = m[0].lower(), page[begin : pos - 1]
        if closing:
            if tag not in INLINE:
                block = None
            if is_open[tag] > 0:
                close_down_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if is_open["svg"] > 0 and tag in BREAKOUT:
            close_down_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "svg"))
        if tag not in INLINE:
            block = None
        shut = attributes.endswith("/")
        if tag in RAW and not shut:
            if raw_end.get(tag, pos) >= pos:  # there may be one
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                raw_end[tag] = close.start() if close else -1
                # Scripts and styles without an end go on to the page's end; the others' contents are read.
                if close or tag in ("script", "style"):
                    pos = close.end() if close else end
            continue
        if tag in VOID or shut and tag not in ("p", "div", "span"):
            continue
        if tag in CLOSES or tag not in INLINE and stack[-1][0] == "p":
            ends = CLOSES.get(tag, set()) | ({"p"} if tag not in INLINE else set())
            if stack[-1][0] in ends:
                close_down_to(len(stack) - 1)
        number += 1
        _, state, *around = stack[-1]
        state = element_state(state, tag, attributes)
        stack.append((tag, state, *around) if tag in INLINE else (tag, state, state, tag, number, around[2], around[4] + 1))
        is_open[tag] += 1
        links += tag == "a"
    return out


RIGHTS_TEXT = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|all rights reserved", re.I)


def score(block: Block, page_has_article: bool, bare: bool = False) -> float:
    """The classifier's log odds that a block is content."""
    value = BIAS + LINKED * block.linked / max(block.size, 1) + LENGTH * min(math.log1p(block.size), 4)
    if block.article:
        value += IN_ARTICLE
    elif page_has_article:
        value -= 2 * IN_ARTICLE
    value += IN_MAIN * bool(block.main) + MARKED_GOOD * bool(block.good) + MARKED_BAD * min(block.bad, 2) + AWAY_TAG * min(block.away, 1)
    if block.size and block.marked == block.size:
        value += 2 * MARKED_BAD
    value += BARE * (bare and block.plain)
    if block.size < LONG_WORDS and RIGHTS_TEXT.search("".join(block.parts)):
        value += RIGHTS
    last = block.parts[-1].rstrip()[-1:] if block.parts else ""
    value += SENTENCE * (last in ".!?…。") + HEADING * block.heading + CONTROL * block.item * (1 if block.linked else 0.5)
    return value


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the source's side. A positive cost ties a node to the source, a negative one to the sink.

    A node whose cost outweighs all its edges keeps its side in some minimum cut; its edges then become costs of its
    neighbours, and so on. The nodes that are left fall apart into small graphs, each cut by the maximum flow.
    """
    n = len(costs)
    costs, ties = list(costs), [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            ties[a][b] = ties[a].get(b, 0.0) + c
            ties[b][a] = ties[b].get(a, 0.0) + c
    weight = [sum(t.values()) for t in ties]
    side: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(costs[i]) >= weight[i])
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        side[i] = costs[i] > 0
        for j, c in ties[i].items():
            if side[j] is None:
                costs[j] += c if side[i] else -c
                weight[j] -= c
                if abs(costs[j]) >= weight[j]:
                    queue.append(j)
    for i in range(n):
        if side[i] is None:
            part, seen = [i], {i}
            for a in part:
                for b in ties[a]:
                    if side[b] is None and b not in seen:
                        seen.add(b)
                        part.append(b)
            number = {a: k for k, a in enumerate(part)}
            inner = [(number[a], number[b], c) for a in part for b, c in ties[a].items() if a < b and b in number]
            for a, x in zip(part, flow_sides([costs[a] for a in part], inner)):
                side[a] = x
    return [bool(x) for x in side]


def flow_sides(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut by blocking flows: all shortest paths of one length at a time."""
    n = len(costs)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def tie(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, c in enumerate(costs):
        tie(source, i, c, 0.0) if c > 0 else tie(i, sink, -c, 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], reached = 0, [source]
        for a in reached:
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    reached.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
            elif at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    at[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The content blocks' text, white space in a block as one space, joined by one space."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    has = any(b.article for b in blocks)
    bare = not any(b.article or b.main or b.good for b in blocks) and any(b.size - b.linked >= LONG_WORDS for b in blocks)
    costs = [score(b, has, bare) for b in blocks]
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            apart = before.depth + block.depth - 2 * block.shared
            edges.append((i - 1, i, (NEAR + SAME * (block.depth > 1 and block.depth == before.depth and block.home == before.home)) / (1 + apart)))
        if block.depth > 1 and last.get(block.home, i - 1) < i - 1:
            edges.append((last[block.home], i, APART))
        last[block.home] = i
    # Whatever pulls the same way can't be cut: only runs with both signs need the flow.
    label = [c > 0 for c in costs]
    if any(label) and not all(label):
        label = minimum_cut(costs, edges)
    return " ".join(t for b, keep in zip(blocks, label) if keep and (t := " ".join("".join(b.parts).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Any white space within a block becomes one space. A null, empty or textless page has an empty text; a
    broken one is read as far as it goes, with unclosed elements open to its end. A page of any length is read by
    one task, in time that grows with its length. Rows with the same page_id each give a row. Other
    columns are ignored; an empty table gives an empty result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            texts = [main_text(h) for h in piece["html"].to_pylist()]
            ids, urls = piece["page_id"].combine_chunks(), piece["url"].combine_chunks()
            yield pa.RecordBatch.from_pydict({"page_id": ids, "url": urls, "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")
