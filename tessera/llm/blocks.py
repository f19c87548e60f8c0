"""Leaf blocks of raw HTML: text runs between block-level tags, with the path
of open elements and the share of linked characters."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements that stay inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without content that stand inside a line.
IN_LINE_VOID = frozenset("area embed img input param source track".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style".split())
#: Elements that may stand in a paragraph without ending it.
EMBEDDED = frozenset("template noscript iframe object svg canvas textarea select".split())
#: Elements that end an open paragraph or list item of their kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
            "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in HIDDEN}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tokens of the open elements, outermost first: tag and words of class, id, role
    linked: float  # share of characters inside links


def _element(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs and "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            out += ["." + w for w in _NAME.findall((a or b or c).lower())]
    return tuple(out)


def leaf_blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in order.  Comments, declarations, scripts and
    styles give nothing; formulas stay inside their line, and other embedded
    elements are steps of a path, with or without an end tag; images and inputs
    leave their line whole, and a line break is white space; character references
    are decoded; white space inside a block becomes one space; a block of white
    space alone is none."""
    stack: list[tuple[str, ...]] = []
    pieces: list[str] = []
    links = in_link = 0
    at, size = 0, len(page)
    path: tuple[str, ...] | None = None

    def flush():
        nonlocal pieces, links, path
        text = " ".join(html.unescape("".join(pieces)).split())
        block = Block(text, path or (), min(1.0, links / max(1, len(text)))) if text else None
        pieces, links, path = [], 0, None
        return block

    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that is broken by a stray quote: up to its '>'
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                if path is None and not piece.isspace():
                    path = tuple(t for e in stack for t in e)
                pieces.append(piece)
                if in_link:
                    links += len(piece)
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                if (block := flush()) is not None:
                    yield block
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in HIDDEN:
            if not m.group(3).endswith("/"):
                end = _HIDDEN_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag in INLINE or tag in IN_LINE_VOID:
            in_link = 1 if tag == "a" else in_link
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if (block := flush()) is not None:
            yield block
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] in SIBLINGS[tag]:
                    del stack[i:]
                    break
        elif stack and stack[-1][0] == "p" and tag not in EMBEDDED:
            stack.pop()  # a block element ends an open paragraph
        if tag not in VOID and not m.group(3).endswith("/"):
            stack.append(_element(tag, m.group(3)))
    if (block := flush()) is not None:
        yield block
