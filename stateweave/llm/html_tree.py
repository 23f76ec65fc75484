"""HTML extraction: a graphical model over the page's element tree, with content marginals by sum-product."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
import pyarrow as pa

from stateweave.llm.common import append_column

# The element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
#: Elements without running text that hold others; left out to their own end tag, and one without it is no more than a tag.
CONTROLS = frozenset("noscript template svg canvas object select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot caption legend option summary".split())
#: A new element of the first kind ends open ones of the second, up to the third.
SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id, role and label attributes that name what a region is for.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion"
    " dialog disclaimer footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay"
    " pagination paywall popup promo promoted promotion related recommended replies reply respond responses search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets alert copyright complementary"
    " contentinfo".split()
)
#: Those of them that also stand in anchors and labels inside an article.
ANCHOR_WORDS = frozenset("discussion disclaimer form header legal notice related reply responses search share sharing social tags".split())
#: Words before one that say what a layout has beside it, not what it is.
LAYOUT_WORDS = frozenset("has with no without".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: How a block of reader comments is headed that has no name.
COMMENTS_TITLE = re.compile(r"\W*(?:\d+\s+)?(?:comments?|replies|responses|leave a (?:comment|reply))\W*(?:\d+\W*)?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("head nav header footer aside form dialog menu".split())
CONTENT_TAGS = frozenset(("article", "main"))
FRAME_TAGS = frozenset(("#root", "html", "body"))
#: Elements made for running text; others (div, section, list and table parts) say nothing by their tag.
TEXT_TAGS = frozenset("#text p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dd".split())

#: Pages the model is fitted on, about, chosen by a hash.
TRAINING_PAGES = 2000
#: Pseudo-counts with which the words and tags above enter the fitted counts.
PRIOR = 50.0
SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass
class Node:
    """An element; ``pieces`` are its own texts, block children excepted, in order with the children."""

    tag: str
    attributes: str
    parent: int
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of its text, descendants included
    linked: int = 0  # of which inside links
    own: int = 0  # of its text outside block children
    title: str = ""  # of a heading, its text; of another element, that of the heading it begins with
    purpose: str = ""  # what its tag, attributes and title name


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page as a tree (node 0 is the root), and (node, text) in page order.

    Inline elements belong to the block around them.  Comments, declarations
    and the text of scripts, styles and controls are left out, unclosed tags
    end where HTML ends them (a control without its end tag leaves nothing out),
    and a cut-off tag at the end of the page is no text.
    """
    nodes = [Node("#root", "", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones with the block they are in
    out: list[tuple[int, str]] = []
    links, at = 0, 0
    ends: dict[int, int] | None = None  # where the controls end, once one is met

    def text(raw: str) -> None:
        if raw:
            node = stack[-1][1]
            if nodes[node].tag in FRAME_TAGS and not raw.isspace():
                # Loose text is an element of its own.
                nodes.append(Node("#text", "", node))
                nodes[node].children.append(len(nodes) - 1)
                node = len(nodes) - 1
            out.append((node, raw))
            if nodes[node].tag in HEADINGS and len(nodes[node].title) < 100:
                nodes[node].title += raw[:100]
            n = len(raw) - raw.count(" ")
            nodes[node].own += n
            if links:
                nodes[node].linked += n

    def close(index: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[index:])
        del stack[index:]

    def block_break() -> None:
        out.append((stack[-1][1], "\n"))

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", rest)
            text(rest[: cut.start()] if cut else rest)
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK:
                        close(i)
                        block_break()
                    else:
                        # An inline end tag never closes the blocks inside it.
                        if all(t not in BLOCK for t, _ in stack[i + 1 :]):
                            close(i)
                        else:
                            links -= tag == "a"
                            del stack[i]
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                at = _raw_end(page, tag, at)
            continue
        if tag in CONTROLS:
            if not m[3].endswith("/"):
                ends = _control_ends(page) if ends is None else ends
                at = ends.get(at, at)
            continue
        if tag in VOID:
            if tag == "hr":
                block_break()
            elif tag == "br":
                text(" ")
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in SIBLING:
            ended, bounds = SIBLING[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in ended:
                    close(i)
        if tag in BLOCK:
            parent = stack[-1][1]
            nodes.append(Node(tag, m[3], parent))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
            block_break()
        else:
            links += tag == "a"
            if len(stack) < 10_000:
                stack.append((tag, stack[-1][1]))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.chars += node.own
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            above = nodes[node.parent]
            above.linked += node.linked
            if node.tag in HEADINGS and above.children[0] == i and above.tag not in HEADINGS:
                above.title = node.title
    _name(nodes)
    return nodes, out


def _raw_end(page: str, tag: str, at: int) -> int:
    """Behind the end tag of a raw text; without one HTML takes the rest of the page."""
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _control_ends(page: str) -> dict[int, int]:
    """Behind the start tag of each control that has an end tag of its own: behind that one."""
    out: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            at = _raw_end(page, tag, at)
        elif tag in CONTROLS and m[1]:
            if starts.get(tag):
                out[starts[tag].pop()] = at
        elif tag in CONTROLS and not m[3].endswith("/"):
            starts.setdefault(tag, []).append(at)
    return out


def _names(node: Node) -> tuple[bool, bool, bool, bool]:
    """What the tag, attributes and title of an element name: hidden, boilerplate, perhaps boilerplate, content."""
    if not node.attributes and not node.title:
        return False, node.tag in BOILER_TAGS and node.tag != "header", False, node.tag in CONTENT_TAGS
    strong, weak, hidden = [], [], False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            hidden = True
            continue
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        words = [w for before, w in zip(["", *words], words) if before not in LAYOUT_WORDS]
        if name not in ("id", "aria-label"):
            strong += words
        elif node.tag not in TEXT_TAGS:  # an anchor of a line is no purpose
            weak += words
    own = BOILER_WORDS.intersection(strong) or BOILER_WORDS.intersection(weak) - ANCHOR_WORDS
    commented = node.tag not in HEADINGS and bool(node.title) and COMMENTS_TITLE.fullmatch(" ".join(node.title.split())) is not None
    boiler = node.tag in BOILER_TAGS - {"header"} or bool(own) or commented
    content = node.tag in CONTENT_TAGS or not CONTENT_WORDS.isdisjoint(strong + weak)
    return hidden, boiler, not boiler and not BOILER_WORDS.isdisjoint(weak), content


def _name(nodes: list[Node]) -> None:
    """Give each element its purpose.

    A region named for something else that holds most of the page's running text
    and its largest content region, or is a form, only stands around it.
    """
    names = [_names(node) for node in nodes]
    plain = [node.chars - node.linked for node in nodes]
    regions = [i for i, (_, boiler, _, content) in enumerate(names) if content and (not boiler or nodes[i].tag in CONTENT_TAGS)]
    holds, at = set(), max(regions, key=lambda i: (plain[i], -i), default=0)
    while at > 0:
        at = nodes[at].parent
        holds.add(at)
    for i, (node, (hidden, boiler, perhaps, content)) in enumerate(zip(nodes, names)):
        around = 2 * plain[i] >= plain[0] > 0 and (i in holds or node.tag == "form")
        if node.tag in FRAME_TAGS:
            node.purpose = "frame"
        elif hidden:
            node.purpose = "boiler"
        elif (boiler or perhaps) and around:
            node.purpose = "around"
        elif boiler and node.tag in CONTENT_TAGS:
            node.purpose = "doubtful"
        elif boiler:
            node.purpose = "boiler"
        elif node.tag == "header":
            node.purpose = "header"
        elif content:
            node.purpose = "content"
        else:
            node.purpose = "perhaps" if perhaps else "none"


def features(node: Node) -> tuple[str, list[str]]:
    """What is seen of an element: its purpose; its tag, length of text and share of links, in a few grades."""
    length = min(6, int(math.log2(1 + node.own) / 1.5))
    links = int(4 * node.linked / node.chars) if node.chars else 0
    return node.purpose, [f"tag={node.tag}"] * (node.tag in TEXT_TAGS) + [f"length={length}", f"links={links}"]


#: States of an element: part of the frame around regions, of the content, of a region that serves something else.
FRAME, CONTENT, OTHER = range(3)


def seeds(nodes: list[Node]) -> list[int]:
    """Labels that a page gives by itself: regions named for something else, then article and main regions, and the frame."""
    out = []
    for node in nodes:
        above = out[node.parent] if node.parent >= 0 else FRAME
        named = features(node)[0]
        other = above == OTHER or named == "boiler" or named in ("header", "perhaps") and above == FRAME  # an article's header is its heading
        other = other or named == "doubtful" and above == CONTENT  # an article inside another, named for something else
        out.append(FRAME if node.tag in FRAME_TAGS else OTHER if other else CONTENT if node.tag in CONTENT_TAGS else above)
    return out


COUNTS = StructType([StructField("what", StringType()), StructField("state", IntegerType()), StructField("n", DoubleType())])


def fit(pages: DataFrame, html_column: str = "html", key: str = "page_id", limit: int = TRAINING_PAGES) -> dict[str, list[float]]:
    """Log potentials from labelled pages: each feature given the state, and a child's state given its parent's.

    Labels come from the pages' own article and main regions.  About ``limit``
    pages are read, chosen by a hash of id and page where they lie; the table of
    counts has one row for each feature and state, whatever the number of pages.
    """
    n = pages.count()
    share = int((1 << 30) * min(1.0, limit / max(1, n)))
    labelled = F.col(html_column).contains("<article") | F.col(html_column).contains("<main")
    sample = pages.where(labelled & (F.pmod(F.xxhash64(key, html_column), F.lit(1 << 30)) < share)).select(F.col(html_column).alias("html"))

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                nodes, _ = parse(page or "")
                labels = seeds(nodes)
                for node, state in zip(nodes, labels):
                    named, seen = features(node)
                    total.update((f, state) for f in seen)
                    if node.parent >= 0:
                        total[_edge(labels[node.parent], named), state] += 1
        rows = [{"what": w, "state": s, "n": float(n)} for (w, s), n in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("what", pa.string()), ("state", pa.int32()), ("n", pa.float64())]))

    counts = {w: n[:] for w, n in _PRIOR.items()}
    for r in sample.mapInArrow(count, COUNTS).groupBy("what", "state").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["what"], [0.0] * 3)[r["state"]] += r["n"]
    return _potentials(counts)


def _edge(parent: int, named: str) -> str:
    return f"parent={parent},{named}"


#: Pseudo-counts of a child's state by its parent's and by its purpose, with which the fixed words and tags enter.
#: Learned counts come on top of them.
_PRIOR = {
    _edge(FRAME, "frame"): [PRIOR, 0.0, 0.0],
    _edge(FRAME, "none"): [PRIOR, PRIOR, PRIOR / 5],
    _edge(FRAME, "content"): [PRIOR / 5, PRIOR, 0.0],
    _edge(FRAME, "header"): [PRIOR / 50, 0.0, PRIOR],
    _edge(FRAME, "around"): [PRIOR, PRIOR / 5, 0.0],
    _edge(FRAME, "doubtful"): [0.0, PRIOR, PRIOR / 5],
    _edge(FRAME, "perhaps"): [PRIOR / 5, PRIOR / 5, PRIOR],
    _edge(CONTENT, "doubtful"): [0.0, PRIOR / 5, PRIOR],
    _edge(CONTENT, "perhaps"): [0.0, PRIOR, PRIOR / 50],
    _edge(CONTENT, "frame"): [0.0, 0.0, PRIOR],
} | {
    _edge(CONTENT, named): [0.0, PRIOR, 0.0] for named in ("none", "content", "header", "around")
} | {
    _edge(parent, named): [0.0, 0.0, PRIOR]
    for parent in (FRAME, CONTENT, OTHER)
    for named in ("none", "content", "header", "around", "doubtful", "perhaps", "boiler", "frame")
    if parent == OTHER or named == "boiler"
}
#: The most that a parent's state and a name together may say for or against a state, in nats.
NAMED = 5.0
#: Nats that leave a state no chance.
GIVEN = 1e4
#: The most that one feature may say for or against a state, in nats.
WEAK = 0.5


def _potentials(counts: dict[str, list[float]]) -> dict[str, list[float]]:
    """Smoothed log potentials, all of them bounded.

    Names weigh up to ``NAMED``.  Other regions may look like content (comments
    do) and have any number of lines, so of the features only links tell the two
    apart, and little each.
    """
    kinds: dict[str, list[float]] = {}
    for what, n in counts.items():
        total = kinds.setdefault(what.split("=")[0], [0.0] * 3)
        for s, x in enumerate(n):
            total[s] += x
    out = {}
    for what, n in counts.items():
        kind = what.split("=")[0]
        if kind == "parent":
            logs = [math.log((x + 0.01) / (sum(n) + 0.03)) for x in n]
            out[what] = [max(x, max(logs) - NAMED) for x in logs]
            continue
        logs = [math.log((x + 1) / (t + 20)) for x, t in zip(n, kinds[kind])]
        logs[OTHER] = max(logs[OTHER], logs[CONTENT])
        if kind != "links":
            logs[CONTENT] = logs[OTHER]
        middle = (max(logs) + min(logs)) / 2
        out[what] = [max(-WEAK, min(WEAK, x - middle)) for x in logs]
    return out


def evidence(node: Node, potentials: dict[str, list[float]]) -> list[float]:
    """What an element's own features say for each state; the root, html and body are the frame by what they are."""
    if node.tag in FRAME_TAGS:
        return [0.0, -GIVEN, -GIVEN]
    seen = [p for p in map(potentials.get, features(node)[1]) if p]
    return [sum(p[s] for p in seen) for s in range(3)]


def marginals(nodes: list[Node], potentials: dict[str, list[float]]) -> list[float]:
    """The probability that each element is content: messages from the leaves to the root and back."""
    states = range(3)
    belief, pairs = [], []
    for node in nodes:
        belief.append(evidence(node, potentials))
        pairs.append([potentials[_edge(s, node.purpose)] for s in states])
    up: list[list[float]] = [[0.0] * 3 for _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        own, pair = belief[i], pairs[i]
        up[i] = [_log_sum([pair[s][t] + own[t] for t in states]) for s in states]
        above = belief[nodes[i].parent]
        for s in states:
            above[s] += up[i][s]
    out = []
    for i, node in enumerate(nodes):
        own, pair = belief[i], pairs[i]
        if i:
            rest = [x - y for x, y in zip(belief[node.parent], up[i])]
            for t in states:
                own[t] += _log_sum([rest[s] + pair[s][t] for s in states])
        out.append(math.exp(own[CONTENT] - _log_sum(own)))
    return out


def _log_sum(values: list[float]) -> float:
    high = max(values)
    return high + math.log(sum(math.exp(v - high) for v in values))


def main_text(page: str, potentials: dict[str, list[float]]) -> str:
    nodes, pieces = parse(page)
    keep = [m >= 0.5 for m in marginals(nodes, potentials)]
    blocks, line, last = [], [], -1
    for node, piece in [*pieces, (-1, "\n")]:
        if node != last or piece == "\n":
            joined = SPACE.sub(" ", html.unescape("".join(line))).strip()
            if joined:
                blocks.append(joined)
            line, last = [], node
        if piece != "\n" and node >= 0 and keep[node]:
            line.append(piece)
    return "\n".join(blocks)


def extract(pages: DataFrame, potentials: dict[str, list[float]], html_column: str = "html", result: str = "text") -> DataFrame:
    """Add ``result``: the text of the elements more likely content than not, a block a line.

    White space inside a block becomes one space and blocks are trimmed; empty
    ones are left out.  A null or empty page, or one without content, gives the
    empty text.  Pages are read one by one, so repeated rows, ties and empty
    tables need nothing; an input column named ``result`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(potentials)
    return append_column(pages, html_column, result, StringType(), lambda values: [main_text(v, shared.value) for v in values])
