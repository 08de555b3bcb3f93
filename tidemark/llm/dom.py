"""A forgiving HTML parser that gives element nodes in page order, as flat lists."""

from __future__ import annotations

import html as _html
import re

#: A tag's attributes. Only a quote that follows an equals sign opens a value; one that is never closed opens none.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
#: Markup: comments, raw-text elements, declarations, end tags, start tags with their attributes. What the page's end
#: cuts is markup, too. Every alternative consumes what it reads, so that no page makes matching slower than linear.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg)(?=[\s/>]|\Z)" + r"(?P<within>" + _REST + r")(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + _REST + r")(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE) for t in "script style title textarea noscript template iframe svg".split()}
_ATTRS = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open paragraph.
CLOSES_P = BLOCKS - {"caption", "html", "head", "body", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "select"}
#: Open elements that a start tag ends, and where the search for them stops.
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Markup inside running text that gets no node of its own.
PLAIN = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup tt u var wbr".split())
_P_STOPS = frozenset("button table td th caption object html".split())

BREAK = None


class Nodes:
    """Nodes of a page in the order of their start; node 0 is the page itself, and
    text that stands at its root is in an implied body, the last node.

    A node's subtree is the range from its number to ``end``. ``segments`` are
    (node, text) in page order, with (node, BREAK) where a block begins or ends.
    """

    __slots__ = ("tag", "parent", "depth", "end", "tokens", "hidden", "segments")

    def __init__(self):
        self.tag, self.parent, self.depth, self.end = ["#page"], [-1], [0], [1]
        self.tokens, self.hidden, self.segments = [()], [False], []


def parse(page: str) -> Nodes:
    """The nodes of a page, however broken its markup is."""
    out = Nodes()
    tags, parents, depths, ends, segments = out.tag, out.parent, out.depth, out.end, out.segments
    stack = [(0, "#page")]  # (node, tag); plain elements share their parent's node
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    at = 0

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def push(node: int, tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((node, tag))

    def pop_to(k: int) -> None:
        for node, tag in stack[k:]:
            if tag in BLOCKS:
                segments.append((node, BREAK))
            if ends[node] == 0:
                ends[node] = len(tags)
            if node or tag != "#page":
                places[tag].pop()
        del stack[k:]

    def text(raw: str) -> None:
        if raw:
            segments.append((stack[-1][0], _html.unescape(raw) if "&" in raw else raw))

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        raw = m["raw"]
        if raw is not None:
            # An svg may be empty by its own end; any other raw element runs to its end tag.
            if raw.lower() != "svg" or not m["within"].endswith("/"):
                closing = _CLOSING[raw.lower()].search(page, at)
                at = closing.end() if closing else len(page)
            continue
        tag = m["tag"]
        if tag is None:
            name = m["end"]
            k = last((name.lower(),)) if name is not None else 0
            if k:
                pop_to(k)
            continue
        if at == len(page) and page[-1] != ">":
            break  # the page's end cuts the tag
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            segments.append((stack[-1][0], " " if tag == "br" else ""))
            continue
        if tag in CLOSES_P:
            k = last(("p",))
            if k > last(_P_STOPS):
                pop_to(k)
        if tag in SIBLINGS:
            ended, stops = SIBLINGS[tag]
            while (k := last(ended)) > last(stops):
                pop_to(k)
                if tag != "tr":
                    break
        if tag in PLAIN:
            push(stack[-1][0], tag)
            continue
        node = len(tags)
        attrs = m["attrs"]
        tags.append(tag), parents.append(stack[-1][0]), depths.append(len(stack)), ends.append(0)
        found = ()
        if attrs and "=" in attrs:
            found = tuple(w for a in _ATTRS.finditer(attrs) for w in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a[2] or a[3] or a[4] or "").lower()))
        out.tokens.append(found)
        out.hidden.append(bool(attrs) and _HIDDEN.search(attrs) is not None)
        if tag in BLOCKS:
            segments.append((node, BREAK))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            ends[node] = node + 1
        else:
            push(node, tag)
    pop_to(0)
    if any(node == 0 and t and not t.isspace() for node, t in segments):
        body = len(tags)
        tags.append("body"), parents.append(0), depths.append(1), ends.append(body + 1)
        out.tokens.append(()), out.hidden.append(False)
        out.segments = [(body if node == 0 else node, t) for node, t in segments]
    ends[0] = len(tags)
    return out


def blocks(segments) -> str:
    """Text of segments: white space in a block becomes one space, blocks are joined by line ends."""
    out, run = [], []
    for _, text in segments:
        if text is BREAK:
            if run:
                block = " ".join("".join(run).split())
                if block:
                    out.append(block)
                run = []
        else:
            run.append(text)
    if run:
        block = " ".join("".join(run).split())
        if block:
            out.append(block)
    return "\n".join(out)
