"""HTML to leaf blocks: runs of text without a block-level border, with the elements around them.

Reading is by one pass of regular expressions and forgiving: unclosed paragraphs, list items and cells end
where the next one begins, stray end tags are ignored, an unclosed comment, script, style or tag takes the
rest of the page, of other elements without text (video, svg, select) that aren't closed only the tag goes.
Time is linear in the page: open elements are found by the places of their names, what all ancestors say is
kept with each open element and passed on to those within it, and a missing end tag is looked for once."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

#: Elements that begin and end blocks.
BLOCK = frozenset("address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template textarea title iframe object svg select noembed noframes xmp applet audio video canvas".split())
#: Of these, elements whose content is no markup, so that without an end tag they have no end.
RAW = frozenset("script style xmp iframe noembed noframes textarea".split())
#: Tags that say nothing about a block, as every one has them or they only style text.
PLAIN = frozenset("html body b i em strong code span".split())
#: An opening tag of the key ends an open element of the value, up to the nearest of the stops.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table article section div body html main aside nav header footer form td th blockquote".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in DROPPED}


@dataclass
class Around:
    """What the open elements say, all of them: ``tags`` but plain ones and ``marks`` (of those that are asked for), whether
    there is any mark, the nearest tag, and ``path``, a number of the order of tags and marks that is 0 without any."""

    tags: frozenset[str] = frozenset()
    marks: frozenset[str] = frozenset()
    marked: bool = False
    near: str = "body"
    path: int = 0


@dataclass
class Block:
    text: str
    around: Around
    linked: int = 0
    #: Whether any element is open around it.
    bare: bool = False


@dataclass
class _Open:
    tag: str
    around: Around


def _marks(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for _, *values in _ATTRIBUTE.findall(attributes):
        out += [t.lower() for t in _TOKEN.findall(next((v for v in values if v), ""))]
    return tuple(out)


def blocks(html: str | None, tags: frozenset[str] | None = None, marks: frozenset[str] | None = None) -> list[Block]:
    """``tags`` and ``marks``: those that blocks shall tell of their ancestors, all if not given. A page may have as many
    marks as elements, so readers of pages ask for those that they know."""
    found: list[Block] = []
    if not html:
        return found
    stack: list[_Open] = []
    #: Positions in the stack of the open elements of each name, and of all that border blocks.
    places: dict[str, list[int]] = defaultdict(list)
    borders: list[int] = []
    endless: set[str] = set()
    parts: list[str] = []
    around: Around | None = None
    bare, linked = False, 0
    outside = Around()
    paths: dict[tuple, int] = {}

    def add(raw: str) -> None:
        nonlocal around, bare, linked
        if around is None and not raw.isspace():
            around, bare = stack[-1].around if stack else outside, not stack
        parts.append(raw)
        if places["a"]:
            linked += len(raw)

    def flush() -> None:
        nonlocal around, linked
        if parts and around is not None:
            raw = "".join(parts)
            if text := " ".join(unescape(raw).split()):
                found.append(Block(text, around, min(100, 100 * linked // max(len(raw), 1)), bare))
        parts.clear()
        around, linked = None, 0

    def push(name: str, attributes: str) -> None:
        places[name].append(len(stack))
        if name in BLOCK:
            borders.append(len(stack))
        up = stack[-1].around if stack else outside
        own = frozenset(_marks(attributes)) if attributes else frozenset()
        plain = name in PLAIN
        if plain and not own:
            stack.append(_Open(name, up))
            return
        told = own if marks is None else own & marks
        inner = up.tags if plain or name in up.tags or (tags is not None and name not in tags) else up.tags | {name}
        path = paths.setdefault((up.path, "" if plain else name, own), len(paths) + 1)
        more = up.marks if up.marks >= told else up.marks | told
        stack.append(_Open(name, Around(inner, more, up.marked or bool(own), up.near if plain else name, path)))

    def pop_to(index: int) -> None:
        for x in stack[index:]:
            places[x.tag].pop()
            if x.tag in BLOCK:
                borders.pop()
        del stack[index:]

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        if not (nxt.isalpha() or nxt == "/"):
            add("<")
            at = lt + 1
            continue
        tag = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if tag is None:
            # "</" and no name is a comment; a tag without an end takes the rest.
            end = html.find(">", lt) if nxt == "/" else -1
            at = size if end < 0 else end + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in DROPPED and not closing:
            parts.append(" ")
            if attributes.endswith("/") and name == "svg" or name in endless:
                continue
            end = _END_OF[name].search(html, at)
            if end is not None:
                at = end.end()
            elif name in RAW and not attributes.endswith("/"):
                at = size
            else:
                endless.add(name)
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
        if closing:
            k = last(HEADINGS if name in HEADINGS else (name,))
            if k >= 0 and (name in BLOCK or not borders or k > borders[-1]):
                pop_to(k)
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            ended = ("p", *ENDS.get(name, ()))
            stop = last(STOPS.difference(ended))
            cut = [own[k] for t in ended if (own := places.get(t)) and (k := bisect_right(own, stop)) < len(own)]
            if cut:
                pop_to(min(cut))
        if not attributes.endswith("/") or name in BLOCK:
            push(name, attributes)
    flush()
    return found
