"""Web pages as sequences of leaf blocks: what text stands in which block element, and the path of tags above it.

One pass over the page in linear time, whatever its markup: comments, declarations, scripts and styles give no text, unclosed
elements end where HTML lets them end (a new ``p``, list item or cell ends the one before; an outer end tag ends all within),
end tags without a start are ignored. Block elements part the text; inline elements and ``br`` don't. Character references are
decoded, white space inside a block becomes one space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

# The block elements of HTML, those without an end tag, and those whose content is no markup.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 "
    "h3 h4 h5 h6 head header hgroup html ins legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td "
    "template tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Raw elements whose content is text of the page's parts, not code.
TEXT_RAW = frozenset(("textarea", "title"))
#: What a start tag ends when it stands on top of the open elements; any other block ends an open ``p``.
ENDS = {
    "li": frozenset(("p", "li")), "dt": frozenset(("p", "dt", "dd")), "dd": frozenset(("p", "dt", "dd")), "td": frozenset(("p", "td", "th")),
    "th": frozenset(("p", "td", "th")), "tr": frozenset(("p", "td", "th", "tr")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup")),
    "tbody": frozenset(("p", "td", "th", "tr", "thead", "tbody")), "tfoot": frozenset(("p", "td", "th", "tr", "thead", "tbody")),
}
_P = frozenset(("p",))
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


@lru_cache(1 << 14)
def _named(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of class, id, role and label."""
    out = [f"<{tag}>"]
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        if name.lower() == "hidden":
            out.append("hidden")
        out += [w.lower() for w in _LETTERS.findall(_HUMP.sub(r"\1 \2", value))]
    return tuple(dict.fromkeys(out))


@dataclass
class Page:
    """Open elements as a tree of nodes (0 is above all), and leaf blocks in page order."""

    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    nodes: list[int] = field(default_factory=list)
    inline: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)


def parse(html: str | None) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}
    runs: list[str] = []
    inline: list[str] = []
    linked, in_link = 0, False

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(runs).split()) if runs else ""
        if text:
            page.nodes.append(stack[-1][1])
            page.inline.append(tuple(inline))
            page.texts.append(text)
            page.link_chars.append(linked)
        runs.clear()
        inline.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        text = unescape(text) if "&" in text else text
        runs.append(text)
        if in_link:
            linked += len(text.strip())

    def push(tag: str, attributes: str) -> None:
        above = stack[-1][1]
        page.parents.append(above)
        page.depths.append(page.depths[above] + 1)
        page.names.append(_named(tag, attributes))
        stack.append((tag, len(page.names) - 1))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    html = html or ""
    at, size, last_end = 0, len(html), html.rfind(">")
    while at < size:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        if start > at:
            say(html[at:start])
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        if start > last_end:
            if mark.isascii() and (mark.isalpha() or mark == "/"):
                break
            say("<")
            at = start + 1
            continue
        found = _TAG.match(html, start)
        if found is None:
            if mark == "/":
                at = html.find(">", start) + 1
            else:
                say("<")
                at = start + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in RAW and not closing:
            ending = _RAW_END[tag].search(html, at)
            stop = ending.start() if ending else size
            if tag in TEXT_RAW:
                end_block()
                push(tag, attributes)
                say(html[at:stop])
                end_block()
                pop()
            at = stop
        elif tag in RAW or tag == "br":
            runs.append(" ")
        elif tag == "hr":
            end_block()
        elif tag in VOID:
            pass
        elif tag in BLOCKS or "-" in tag:
            end_block()
            if closing:
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            else:
                ended = ENDS.get(tag, _P)
                while stack[-1][0] in ended:
                    pop()
                push(tag, attributes)
        else:
            if tag == "a":
                in_link = not closing
            if not closing and attributes:
                inline.extend(_named(tag, attributes)[1:])
    end_block()
    return page
