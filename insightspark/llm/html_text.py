"""Main text of web pages by consensus of their host.

Every page's containers are scored by their own running text.  Pages of a host vote
on the generalised tag-class path of their best container, weighted by its
score; Spark sums the votes.  Each page is then extracted again from the
containers at its host's winning path; a page without that path uses its own
best container.  A region is widened to what surrounds it as long as that adds running text.

Defined cases: null or empty html gives an empty text; broken and truncated
markup is read as far as it goes; a null url or one without a host forms a host of
its own; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch
from insightspark.session import write_once

# Fixed names of HTML elements, by what they are for.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output progress q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr img".split()
)
_NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe button select textarea input svg canvas object embed audio"
    " video menu dialog noembed noframes xmp title map datalist".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES_ITEM = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",),
}
_ITEM_SCOPE = frozenset("ul ol dl table html body article section div main".split())
_CONTAINERS = frozenset("article main section div td body html blockquote center".split())
# Last words of class, id and role names that mark what surrounds an article.
_SURROUNDING = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead banner header cookie cookies consent gdpr notice"
    " notices alert alerts popup modal overlay ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion"
    " share sharing social related recommended recommendations newsletter subscribe signup login search pagination pager toolbar skip"
    " skiplink complementary contentinfo".split()
)
# The same for what readers wrote, which may be longer than the article.
_READERS = frozenset("comment comments commentlist respond replies disqus".split())
# Words of layout: a name is judged by what stands before them.
_LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column container content footer form group header heading holder icon icons inner"
    " item items left link links list main media outer panel posts primary region right row secondary section slot stories text title top unit"
    " widget widgets wrap wrapper".split()
)
# Whole names that mark surroundings, first words that only tell a state of the page, and owners of a header within the text.
_WHOLE_NAMES = frozenset("widget hidden visually-hidden sr-only d-none".split())
_STATES = frozenset("has with no not without js supports".split())
_TEXT_HEADERS = frozenset("article blog chapter content entry hentry news post recipe section story".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_LOOSE = re.compile(r"<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FRAME = frozenset(["", "html", "body"])
_WHOLE = frozenset(["article", "main"])
# So many characters in containers right in the frame are running text, not a scrap beside the article.
RUNNING = 80
# The share of the best container's text below which the host's path does not stand for a page alone,
# and how many pages of the host make a path a template.
FAIR = 0.5
TEMPLATE = 2
# The share of a page's running text that a name alone does not drop.
MAIN = 0.8
# In place of a marked element's number: dropped whatever the page holds.
_GONE = -2


class Node:
    """A container: its step on the path, what it stands in, and where it lies among all blocks.

    Only the step is kept, so deep nesting takes memory in proportion; ``length`` is that of the whole path.
    """

    __slots__ = ("step", "length", "around", "tag", "first", "last", "parent", "dropped", "own", "links")

    def __init__(self, step: str, around: Node | None, tag: str, first: int, parent: int, dropped: bool):
        self.step, self.around, self.tag, self.first, self.last = step, around, tag, first, -1
        self.length = around.length + 1 + len(step) if around else 0
        self.parent, self.dropped, self.own, self.links = parent, dropped, 0.0, 0

    @property
    def path(self) -> str:
        steps, node = [], self
        while node.around:
            steps.append(node.step)
            node = node.around
        return "".join(f"/{step}" for step in reversed(steps))


class Marked:
    """An element whose name marks surroundings: its running text, and the marked element around it."""

    __slots__ = ("around", "running")

    def __init__(self, around: int):
        self.around, self.running = around, 0.0


def name_marks(name: str) -> frozenset[str]:
    """The words of surroundings that one class, id or role name ends with, words of layout left out."""
    if name.lower() in _WHOLE_NAMES:
        return frozenset([name.lower()])
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in _STATES:
        return frozenset()
    if words[-1] == "header" and words[0] in _TEXT_HEADERS:
        return frozenset()
    for end in range(len(words), 0, -1):
        joined = words[end - 2] + words[end - 1] if end > 1 else ""
        for word in (words[end - 1], joined):
            if word in _SURROUNDING or word in _READERS:
                return frozenset([word])
        if words[end - 1] not in _LAYOUT:
            break
    return frozenset()


def element_marks(tag: str, values: dict[str, str], article: bool) -> frozenset[str]:
    """The words of surroundings in an element's names.

    Inside an article "header" marks nothing, and neither does the id of a section,
    which names its subject, unless it holds what readers wrote.
    """
    found: set[str] = set()
    for key in ("class", "id", "role"):
        words = {w for name in values.get(key, "").split() for w in name_marks(name)}
        if article:
            words -= {"header"}
            if key == "id" and tag == "section":
                words &= _READERS
        found |= words
    return frozenset(found)


def _generalised(tag: str, names: str) -> str:
    """The tag with its classes, digits left out, so pages of one template agree."""
    words = sorted({w for w in (_DIGITS.sub("", n).strip("-_") for n in names.lower().split()) if w})
    return ".".join([tag, *words])


def parse_page(text: str) -> tuple[list[tuple[str, bool]], list[Node]]:
    """Blocks in page order as (text, belongs to the surroundings), and all containers.

    A block is the text between two block elements or line breaks.  A name never makes the
    element that holds the main share of the page's running text surroundings, unless an article or
    main has text beside it or the name tells of readers' comments; such a page is read twice.
    """
    blocks, nodes, spared = _parsed(text, frozenset())
    return _parsed(text, spared)[:2] if spared else (blocks, nodes)


def _main_marks(marked: list[Marked], total: float, articles: float) -> frozenset[int]:
    """Numbers of the marked elements that hold the main share of the page's running text."""
    if articles > 0:
        return frozenset()
    for mark in reversed(marked):
        if mark.around >= 0:
            marked[mark.around].running += mark.running
    return frozenset(i for i, mark in enumerate(marked) if mark.running > 0 and mark.running >= MAIN * total)


def _parsed(text: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool]], list[Node], frozenset[int]]:
    """Blocks, containers and the marked elements to spare, which are numbered in page order."""
    blocks: list[tuple[str, bool]] = []
    nodes: list[Node] = [Node("", None, "", 0, -1, False)]
    # Open elements: tag, container, surroundings, inside a link, inside an article, innermost marked element.
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, -1)]
    # How many elements of each tag are open.
    opened: Counter[str] = Counter()
    # An element dropped for good has the mark _GONE, and so has all in it.
    marked: list[Marked] = []
    total = articles = 0.0
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked, total, articles
        if parts:
            words = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if words:
                _, node, dropped, _, article, mark = stack[-1]
                blocks.append((words, dropped))
                running = max(0, len(words) - linked)
                if not dropped:
                    nodes[node].own += running
                    nodes[node].links += linked
                if mark != _GONE:
                    total += running
                    if dropped:
                        marked[mark].running += running
                    elif article:
                        articles += running
            linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag, node = stack[-1][:2]
            if tag not in _INLINE:
                end_block()
            if node != stack[-2][1]:
                nodes[node].last = len(blocks)
            stack.pop()
            opened[tag] -= 1

    at, size = 0, len(text)
    while at < size:
        start = text.find("<", at)
        if start < 0:
            start = size
        if start > at:
            piece = text[at:start]
            parts.append(piece)
            if stack[-1][3]:
                linked += len(piece)
        if start == size:
            break
        found = _TOKEN.match(text, start) or _LOOSE.match(text, start)
        if not found:
            parts.append("<")
            at = start + 1
            continue
        at = found.end()
        tag = found["tag"] if "tag" in found.re.groupindex else None
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag in _INLINE and stack[depth][0] not in _INLINE:
                    break
            if tag not in _INLINE:
                end_block()
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                end_block()
            continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in _INLINE:
                    break
        ended = 0
        for depth in range(len(stack) - 1, 0, -1) if tag in _CLOSES_ITEM else ():
            if stack[depth][0] in _CLOSES_ITEM[tag]:
                ended = depth
            elif stack[depth][0] in _ITEM_SCOPE:
                break
        if ended:
            close(ended)
        if tag not in _INLINE:
            end_block()
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(found["attrs"])}
        _, node, dropped, link, article, mark = stack[-1]
        article = article or tag in _WHOLE
        if tag not in ("html", "body", "article", "main"):
            gone = (
                tag in _NEVER
                or (tag == "header" and not article)
                or "hidden" in values
                or values.get("aria-hidden", "").lower() == "true"
            )
            words = element_marks(tag, values, article) if tag not in HEADINGS and tag != "p" and mark != _GONE else ()
            if gone or not _READERS.isdisjoint(words):
                dropped, mark = True, _GONE
            elif words:
                marked.append(Marked(mark))
                if len(marked) - 1 in spared:
                    mark = len(marked) - 1
                else:
                    dropped, mark = True, len(marked) - 1
        if tag in _CONTAINERS:
            nodes.append(Node(_generalised(tag, values.get("class", "")), nodes[node], tag, len(blocks), node, dropped))
            node = len(nodes) - 1
        stack.append((tag, node, dropped, link or tag == "a", article, mark))
        opened[tag] += 1
        if tag in _RAW:
            # Raw text ends only at its own closing tag.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(text, at)
            at = end.start() if end else size
            parts.clear()
    close(1)
    end_block()
    nodes[0].last = len(blocks)
    return blocks, nodes, frozenset() if spared else _main_marks(marked, total, articles)


def container_scores(nodes: list[Node]) -> list[float]:
    """Running text of a container outside links, with a share of what its inner containers have.

    An inner container's text counts less than own text, so an inner container
    that holds most of the article wins; articles and mains count more.
    """
    total = [n.own - n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if not nodes[i].dropped:
            total[nodes[i].parent] += 0.8 * max(total[i], 0.0)
    return [
        0.0 if n.dropped else t * (1.5 if n.tag in ("article", "main") else 1.0) for n, t in zip(nodes, total)
    ]


def subtree_sums(nodes: list[Node]) -> tuple[list[float], list[int]]:
    """Running text and links of every container with all inside it."""
    own, links = [n.own for n in nodes], [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        own[nodes[i].parent] += own[i]
        links[nodes[i].parent] += links[i]
    return own, links


def widened(nodes: list[Node], at: int, sums: tuple[list[float], list[int]], frame: bool = True) -> int:
    """The largest container around ``at`` that adds more running text than links, up to the outermost article or main.

    An article or main is taken whole.  The page's frame is taken, if ``frame``, when it has
    text of its own or its containers add running text.
    """
    own, links = sums
    line = [at]
    while nodes[line[-1]].parent >= 0:
        line.append(nodes[line[-1]].parent)
    whole = [k for k, i in enumerate(line) if nodes[i].tag in _WHOLE]
    for i in line[1 : whole[-1] + 1] if whole else line[1:]:
        n, more, linked = nodes[i], own[i] - own[at], links[i] - links[at]
        if n.tag in _WHOLE:
            fits = more + linked > 0
        elif n.tag in _FRAME:
            fits = frame and (n.own > n.links or more - linked >= RUNNING)
        else:
            fits = more > linked
        at = i if fits else at
    return at


def at_path(nodes: list[Node], path: str | None) -> list[int]:
    """The containers at ``path``; only those whose path is as long are spelled out, one of each parent and step."""
    if not path:
        return []
    known: dict[tuple[int, str], bool] = {}
    found = []
    for i, n in enumerate(nodes):
        if n.length == len(path) and path.endswith(n.step):
            key = (n.parent, n.step)
            if key not in known:
                known[key] = n.path == path
            if known[key]:
                found.append(i)
    return found


def best_container(nodes: list[Node], sums: tuple[list[float], list[int]]) -> tuple[int, float]:
    """The container with the best score, widened, and that score."""
    scores = container_scores(nodes)
    best = max(range(len(nodes)), key=lambda i: (scores[i], -i))
    return (widened(nodes, best, sums) if scores[best] > 0 else best), scores[best]


def page_vote(text: str) -> tuple[str, float]:
    """The path a page votes for and the weight of its vote; no path without any text."""
    _, nodes = parse_page(text)
    best, score = best_container(nodes, subtree_sums(nodes))
    return (nodes[best].path, score) if score > 0 else ("", 0.0)


def page_texts(text: str, path: str | None) -> tuple[str, str | None, str | None]:
    """The blocks of all containers at ``path``, widened within the page's frame, or else of the page's best one.

    Where those hold no fair share of the best container's text, also the best
    container's path and the text of both.
    """
    blocks, nodes = parse_page(text)
    # Once a page, however many containers lie at the path.
    sums = subtree_sums(nodes)
    best, score = best_container(nodes, sums)
    chosen = [nodes[widened(nodes, i, sums, frame=False)] for i in at_path(nodes, path) if not nodes[i].dropped]

    def places(some: list[Node]) -> set[int]:
        return {i for first, last in {(n.first, n.last) for n in some} for i in range(first, last) if not blocks[i][1]}

    def joined(kept: set[int]) -> str:
        return "\n".join(blocks[i][0] for i in sorted(kept))

    own = places([nodes[best]] if score > 0 else [nodes[0]])
    kept = places(chosen)
    if not kept:
        return joined(own), None, None
    size, most = (sum(len(blocks[i][0]) for i in x) for x in (kept, own))
    if own <= kept or size >= FAIR * most:
        return joined(kept), None, None
    return joined(kept), nodes[best].path, joined(kept | own)


def page_text(text: str, path: str | None) -> str:
    return page_texts(text, path)[0]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """host, path, votes (the sum of weights) and voters (the number of pages)."""

    def vote(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole):
                votes = [page_vote(x or "") for x in batch.column(1).to_pylist()]
                yield record_batch(schema, [batch.column(0), [p for p, _ in votes], [round(s) for _, s in votes]])

    votes = map_arrow(pages.select(host_of(F.col("url")).alias("host"), "html"), "host string, path string, weight bigint", vote)
    return votes.filter("weight > 0").groupBy("host", "path").agg(F.sum("weight").alias("votes"), F.count(F.lit(1)).alias("voters"))


def host_paths(votes: DataFrame) -> DataFrame:
    """host, path: the path with the largest sum of votes, ties by path."""
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path"))["path"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.

    The winning paths are written, one row per host, so the join with them follows from their size,
    and so are the other templates' paths, which only pages with little text at the winning path need.
    """
    votes = write_once(host_votes(pages), "host-votes")
    winners = write_once(host_paths(votes), "host-paths")
    others = write_once(
        votes.filter(F.col("voters") >= TEMPLATE)
        .join(winners.withColumnRenamed("path", "winner"), "host")
        .filter("path <> winner")
        .select(F.concat("host", F.lit(" "), "path").alias("template"), F.lit(True).alias("known")),
        "host-templates",
    )
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")

    def extract(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole):
                texts = [page_texts(x or "", p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield record_batch(schema, [batch.column(0), batch.column(1), batch.column(4), *map(list, zip(*texts))])

    found = map_arrow(
        rows.select("page_id", "url", "html", "path", "host"),
        "page_id bigint, url string, host string, text string, own_path string, both string",
        extract,
    )
    # Pages without another path get keys that match nothing and spread out.
    template = F.coalesce(F.concat("host", F.lit(" "), "own_path"), F.xxhash64("page_id", "url", F.length("text")).cast("string"))
    text = F.when(F.col("known"), F.col("both")).otherwise(F.col("text"))
    return (
        found.withColumn("template", template)
        .join(others, "template", "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("bigint"))
    )
