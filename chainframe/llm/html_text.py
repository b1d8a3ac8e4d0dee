"""Main text of web pages by consensus host paths.

Every container of a page (``CONTAINERS``) is scored: how much of the page's
content its path covers, and if that is all of it, how low it lies.  All scores
vote for the containers' generalised paths (tags and classes, numbers
replaced).  Spark adds the votes up per host, and each page is extracted again
with the path that won on its host: from the first to the last container of
that path with content, and from the page's ``h1`` on if that comes before.  A page without
the path, or with less than ``LEAST_SHARE`` of its content there, is extracted
with the lowest path that covers all its content.

Content is every block that is no boilerplate, short blocks that are nothing
but links excepted.  Boilerplate is told by its element or role, or by a class
or id one of whose names says nothing else (``site-footer`` does, ``no-sidebar``
does not).  Names do not drop an element that holds most of the page's text
(unless an article or main with an h1 stands beside it), or the article, the
main element or the first h1 of a page that shows none elsewhere; if no other
text is left, names drop nothing.

The winners are sent to the executors if they are at most ``MOST_BROADCAST``
hosts, and joined by host beyond that.

Defined cases: null or empty html has an empty text; a null url has the host
''; rows that repeat are extracted alike and vote each; of equal votes the
lowest path wins, then the first in order; markup that never ends reaches to
the end of the page; a page may be of any length; an empty table gives an empty
result.  Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

MOST_BROADCAST = 50_000
#: A block shorter than this that is all links, no heading, is no content.
LINKS_MOST = 200
#: A page keeps its own path if the host's has less of its content.
LEAST_SHARE = 0.75
#: What a path loses for each level that it lies above the page's best.
PER_LEVEL = 0.25

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas video audio select noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that one of the listed start tags ends.
ENDS_P = BLOCKS - {"caption", "html", "body", "head", "legend", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table ul ol dl td th article section div main body html aside nav header footer form".split())
CONTAINERS = frozenset("article main section div td body".split())
# What is no part of an article.
DROPPED = frozenset("head nav header footer aside form menu button dialog fieldset".split()) | RAW
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promoted promotion "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead footer sidebar aside rail widget widgets "
    "comment comments commentlist disqus respond replies discussion "
    "cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations teaser tags tagcloud".split()
)
#: Words that may stand beside those in a name without changing what it says.
NEUTRAL_WORDS = frozenset("site page main top bottom left right primary secondary global mobile box block list item items area section wrapper wrap container inner outer content bar links link posts articles stories form thread js".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-a-zA-Z0-9_:.@]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*)((?>[^"'>]+|"[^"]*"|'[^']*')*+)>""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NUMBER = re.compile("[0-9]+")


class Node:
    """A container: its generalised path and its blocks, as a range."""

    __slots__ = ("parent", "path", "first", "last", "depth")

    def __init__(self, parent: Node | None, path: str):
        self.parent, self.path = parent, path
        self.first = self.last = 0
        self.depth = parent.depth + 1 if parent else 0


class Blocks:
    """The blocks of text of a page that are no boilerplate."""

    def __init__(self):
        self.texts: list[str] = []
        self.content: list[bool] = []
        self.title: int | None = None  # the first h1

    def add(self, text: str, content: bool, title: bool) -> None:
        if title and self.title is None:
            self.title = len(self.texts)
        self.texts.append(text)
        self.content.append(content)


def _unwanted(attributes: dict[str, str]) -> bool:
    if attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return False


def _suspected(attributes: dict[str, str]) -> bool:
    """Whether one of the names in class or id consists of boilerplate words, neutral ones beside them."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & DROPPED_WORDS and words <= DROPPED_WORDS | NEUTRAL_WORDS:
            return True
    return False


class Part:
    """An element that its words may drop (tag None), or an article, main or h1."""

    __slots__ = ("above", "tag", "chars", "number")

    def __init__(self, above: Part | None, tag: str | None, number: int):
        self.above, self.tag, self.chars, self.number = above, tag, 0, number


def parse(page: str) -> tuple[Blocks, list[Node]]:
    """The blocks of text that are no boilerplate, and the containers with their ranges of blocks, the page last."""
    blocks, nodes, parts = _parse(page, frozenset())
    kept = _kept(parts) if any(x.tag is None for x in parts) else None
    return _parse(page, kept)[:2] if kept else (blocks, nodes)


def _kept(parts: list[Part]) -> frozenset[int]:
    """The numbers of the elements to keep in spite of their words; the first part is the page."""

    total = parts[0].chars
    kept: set[int] = set()
    seen: set[int] = set()

    def keep_around(part: Part | None) -> None:
        while part is not None and part.number not in seen:
            seen.add(part.number)
            if part.tag is None:
                kept.add(part.number)
            part = part.above

    def shown() -> list[bool]:
        out: list[bool] = []
        for x in parts:  # each after what it lies in
            out.append((x.above is None or out[x.above.number]) and (x.tag is not None or x.number in kept))
        return out

    titled: set[int] = set()  # articles and mains that show an h1
    for x, free in zip(parts, shown(), strict=True):
        if x.tag == "h1" and x.chars and free:
            while (x := x.above) is not None and x.number not in titled:
                if x.tag in ("article", "main"):
                    titled.add(x.number)
    around = []  # how many of them each part lies in
    for x in parts:
        around.append((around[x.above.number] if x.above else 0) + (x.number in titled))
    kept.update(x.number for x in parts if x.tag is None and 2 * x.chars > total and around[x.number] == len(titled))
    mains, articles, heads = ([x for x in parts if x.tag == tag and x.chars] for tag in ("main", "article", "h1"))
    visible = shown()
    if not any(visible[x.number] for x in mains + articles):
        for x in mains or articles:
            keep_around(x)
        visible = shown()
    if heads and not any(visible[x.number] for x in heads):
        keep_around(heads[0])
        visible = shown()
    if total and total == sum(x.chars for x in parts[1:] if not visible[x.number] and visible[x.above.number]):
        kept.update(x.number for x in parts if x.tag is None)
    return frozenset(kept)


def _parse(page: str, kept: frozenset[int]) -> tuple[Blocks, list[Node], list[Part]]:
    """The blocks, the containers and the parts; elements with a listed word stay if their number is kept."""
    blocks = Blocks()
    parts = [Part(None, "", 0)]
    part: Part | None = parts[0]  # null within what is dropped for more than words
    root = Node(None, "")
    nodes: list[Node] = []
    stack: list[tuple[str, Node | None, bool, Part | None]] = []  # tag, container, dropped, part
    here, dropped = root, False
    run: list[str] = []
    linked = False  # in a link that this block opened
    heading = ""  # the heading's element
    plain = False  # this block has text that is in no link

    def end_block() -> None:
        nonlocal linked, plain
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.add(text, plain or bool(heading) or len(text) >= LINKS_MOST, heading == "h1")
        linked = plain = False

    def pop() -> None:
        nonlocal here, dropped, part, linked, heading
        tag, node, _, _ = stack.pop()
        if tag in BLOCKS:
            end_block()
            if tag in HEADINGS:
                heading = ""
        elif tag == "a":
            linked = False
        if node is not None:
            node.last = len(blocks.texts)
            here = node.parent
        dropped, part = stack[-1][2:] if stack else (False, parts[0])

    def close(tags: tuple[str, ...], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in within:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and part is not None:
            part.chars += len(page[at:lt].strip())
        if lt > at and not dropped:
            run.append(page[at:lt])
            plain = plain or (not linked and any(map(str.isalnum, page[at:lt])))
        if lt >= n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            if not dropped:
                run.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            end = page.find(">", lt)
            if end < 0:
                break
            head = re.match("</?([a-zA-Z][a-zA-Z0-9:-]*)", page[lt : lt + 64])
            tag, rest, at = head[1].lower(), "", end + 1
        else:
            tag, rest, at = m[1].lower(), m[2], m.end()
        if nxt == "/":
            if tag == "p" and not any(s[0] == "p" for s in stack):
                end_block()
            else:
                close((tag,), frozenset(("html", "body")) - {tag} if tag not in BLOCKS else frozenset())
            continue
        if tag in BLOCKS:
            end_block()
        if tag == "br" or tag == "hr":
            if not dropped:
                run.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                close_at = page.find(">", end.end()) if end else -1
                at = n if close_at < 0 else close_at + 1
            continue
        if tag in ENDS_P:
            close(("p",), SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE - {"td", "th"} if tag in ("tr", "td", "th", "tbody", "tfoot") else SCOPE)
        attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(rest)} if rest.strip(" /\n") else {}
        bad = dropped or tag in DROPPED or (bool(attributes) and tag not in ("html", "body") and _unwanted(attributes))
        if part is not None:
            if tag in DROPPED or (bad and not dropped) or (dropped and bool(attributes) and _unwanted(attributes)):
                part = None
            else:
                if attributes and tag not in ("html", "body") and _suspected(attributes):
                    part = Part(part, None, len(parts))
                    parts.append(part)
                    bad = bad or part.number not in kept
                if tag in ("article", "main", "h1"):
                    part = Part(part, tag, len(parts))
                    parts.append(part)
        node = None
        if not bad and tag in CONTAINERS:
            classes = ".".join(sorted(_NUMBER.sub("N", c) for c in attributes.get("class", "").lower().split()))
            node = Node(here, f"{here.path}>{tag}" + (f".{classes}" if classes else ""))
            node.first = len(blocks.texts)
            nodes.append(node)
            here = node
        stack.append((tag, node, bad, part))
        dropped = bad
        if tag in HEADINGS:
            heading = tag
        elif tag == "a":
            linked = "href" in attributes
    while stack:
        pop()
    end_block()
    root.last = len(blocks.texts)
    nodes.append(root)
    for x in reversed(parts[1:]):  # later ones lie in earlier ones
        x.above.chars += x.chars
    return blocks, nodes, parts


def scores(blocks: Blocks, nodes: list[Node]) -> dict[str, tuple[float, float, int]]:
    """Per path: its score, the share of the page's content that it covers, its depth.

    The lowest path with all the content scores 1, those above it lose
    ``PER_LEVEL`` a level, and the others score the share that they cover.
    """
    content = [0]
    for text, counts in zip(blocks.texts, blocks.content, strict=True):
        content.append(content[-1] + (len(text) if counts else 0))
    within: dict[str, tuple[int, int]] = {}
    for x in nodes:
        within[x.path] = (within.get(x.path, (0, 0))[0] + content[x.last] - content[x.first], x.depth)
    if not content[-1]:
        return {}
    lowest = max(d for n, d in within.values() if n == content[-1])
    return {p: (max(0.0, 1 - PER_LEVEL * (lowest - d)) if n == content[-1] else n / content[-1], n / content[-1], d) for p, (n, d) in within.items() if n}


def extract(page: str, winner: str | None) -> str:
    blocks, nodes = parse(page)
    own = scores(blocks, nodes)
    if not own:  # nothing but links, or no text
        return "\n\n".join(blocks.texts)
    if winner not in own or own[winner][1] < LEAST_SHARE:
        winner = min(own, key=lambda p: (-own[p][0], -own[p][2], p))
    same = [x for x in nodes if x.path == winner and any(blocks.content[x.first : x.last])]  # never one inside another, so in page order
    first, last = same[0].first, same[-1].last
    if blocks.title is not None:
        first = min(first, blocks.title)
    return "\n\n".join(blocks.texts[first:last])


def votes(page: str) -> list[tuple[str, int, int]]:
    """(path, votes in millionths, depth) of all scored containers."""
    return [(p, round(s * 1e6), d) for p, (s, _, d) in scores(*parse(page)).items() if s > 0]


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host, the lowest of equals, then the first in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(h, *v) for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) if page for v in votes(page)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "path", "votes", "depth"])

    voted = pages.select("host", "html").mapInArrow(count, "host string, path string, votes long, depth int")
    counted = voted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.max("depth").alias("depth"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("depth"), F.col("path"))).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    winners = written(winning_paths(rows), "html-winners")
    schema = f"id {kind}, url string, text string, n_chars long"
    shared = None
    if winners.count() <= most_broadcast:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["path"] for r in winners.toLocalIterator()})
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    else:
        rows = rows.join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            paths = [shared.value.get(h) for h in batch.column("host").to_pylist()] if shared is not None else batch.column("path").to_pylist()
            texts = [extract(page, path) if page else "" for page, path in zip(batch.column("html").to_pylist(), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return rows.select("id", "url", "html", "host", "path").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages)
