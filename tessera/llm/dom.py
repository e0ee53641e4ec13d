"""The leaf blocks of an HTML page: runs of text without a block-level tag
inside, each with its ancestors. Markup may be broken; nothing raises."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Comments, declarations, and the beginnings of tags.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)""", re.S)
#: A quoted value, which may hold ">", or a tag's end. A quote that nothing closes is a sign like others.
_END = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')|>""")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's block-level, void and raw-text elements, and start tags that end an open one.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_LIMITS = frozenset("ul ol dl table article section aside nav main div body".split())


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    links: int
    """Characters of the text inside links."""


def _names(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the attributes that say what an element is for."""
    out = []
    for m in _ATTR.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name == "hidden" or name == "style" and "none" in value:
            out.append("hidden!")
        elif name != "style":
            out += [t.lower() for t in _TOKEN.findall(value)]
    return tuple(dict.fromkeys(out))


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = link_depth = paragraphs = 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), min(links, len(text))))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                links += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal link_depth, paragraphs
        for name, _ in stack[k:]:
            link_depth -= name == "a"
            paragraphs -= name == "p"
        del stack[k:]

    at, top = 0, html.rfind(">") + 1
    while at < top:
        m = _TAG.search(html, at, top)
        if not m:
            break
        add(html[at : m.start()])
        at, name = m.end(), m.group(2)
        if name is None:
            if m.group().startswith("<!--") and not m.group().endswith("-->"):
                at = len(html)
            continue
        end = next((e for e in _END.finditer(html, at) if e.group() == ">"), None)
        if end is None:  # a quoted value that runs over all tags left
            end = re.compile(">").search(html, at)
        attributes, at = html[at : end.start()], end.end()
        name = name.lower()
        if name in BLOCK:
            end_block()
        if m.group(1):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None and not (name not in BLOCK and any(x in BLOCK for x, _ in stack[k + 1 :])):
                pop_to(k)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else len(html)
            parts.append(" ")
            continue
        if name in VOID:
            if name != "wbr":
                parts.append(" ")
            continue
        if attributes.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK and paragraphs:  # a block ends an open paragraph and what is open in it
            pop_to(max(i for i, (x, _) in enumerate(stack) if x == "p"))
        for i in range(len(stack) - 1, -1, -1) if name in CLOSES else ():
            if stack[i][0] in CLOSES[name]:
                pop_to(i)
                break
            if stack[i][0] in _LIMITS:
                break
        link_depth += name == "a"
        paragraphs += name == "p"
        named = _names(attributes) if attributes else ()
        stack.append((name, (*named, "hidden!") if name == "template" else named))
    add(html[max(at, top) :] if at < len(html) else "")
    end_block()
    return out
