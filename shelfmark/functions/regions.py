"""Regions of HTML pages, as the tokenizer of the HTML standard reads them.

Only what a scan for references needs is kept: where attribute values,
comments and raw text are. Start tags switch how their content is read (script
data, raw text, decoded text, plain text), but not inside SVG or MathML, where
integration points and breaking tags return to HTML.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: How the content of an element is read. Raw text decodes no character references.
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))
DECODED = frozenset(("title", "textarea"))
#: Foreign content, where it returns to HTML, and the tags that break out of it.
FOREIGN = frozenset(("svg", "math"))
SVG_POINTS = frozenset(("foreignobject", "desc", "title"))
MATH_POINTS = frozenset(("mi", "mo", "mn", "ms", "mtext"))
ANNOTATIONS = frozenset(("text/html", "application/xhtml+xml"))
BREAKING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr"
    " ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BREAKING_FONT = frozenset(("color", "face", "size"))
#: Attributes that a reader follows, and link relations that name pages.
FOLLOWED = {("a", "href"), ("area", "href"), ("form", "action"), ("button", "formaction"), ("input", "formaction")}
PAGE_RELS = frozenset(("next", "prev", "canonical", "alternate"))


class Region(NamedTuple):
    start: int
    end: int
    kind: str  # attribute, comment, foreign style or the element's name
    raw: bool  # character references are not decoded here
    loads: bool  # a URL here loads a resource


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    closes: bool
    self_closing: bool
    attributes: list[tuple[str, int, int, str]]  # name, span, value


_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z]|/[^>])")
_NAME = re.compile(r"[^\t\n\f\r />]+")
_ATTRIBUTE = re.compile(
    r"[\t\n\f\r /]*(?:(?P<end>>)|(?P<name>=?[^\t\n\f\r />=]*)"
    r"(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<open>[\"'])|(?P<bare>[^\t\n\f\r >]*)))?)"
)
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)


def _tag(html: str, at: int) -> _Tag | None:
    """The tag that begins at a place; none if the page ends inside it."""
    closes = html[at + 1] == "/"
    name = _NAME.match(html, at + 1 + closes)
    attributes: dict[str, tuple[str, int, int, str]] = {}
    here = name.end()
    while True:
        m = _ATTRIBUTE.match(html, here)
        if m["end"]:
            slash = html[m.end() - 2] == "/" and m.end() - 2 >= here
            return _Tag(at, m.end(), name[0].lower(), closes, slash, list(attributes.values()))
        if m["open"] or m.end() >= len(html) or m.end() == here:
            return None
        value = next((v for v in (m["double"], m["single"], m["bare"]) if v is not None), "")
        # Of attributes of one name the first counts.
        attributes.setdefault(m["name"].lower(), (m["name"].lower(), m.start("name"), m.end(), value))
        here = m.end()


def _script_end(html: str, at: int) -> int:
    """Where a script's end tag begins: not inside a commented script element."""
    commented = doubled = False
    while m := _SCRIPT_MARK.search(html, at):
        at = m.end()
        if m[0] == "<!--":
            if not commented:
                commented = True
                at -= 2  # its dashes can end it
        elif m[0] == "-->":
            commented = doubled = False
        elif m[1]:
            if not doubled:
                return m.start()
            doubled = False
        elif commented:
            doubled = True
    return len(html)


def _content_end(html: str, at: int, name: str) -> int:
    if name == "script":
        return _script_end(html, at)
    if name == "plaintext":
        return len(html)
    end = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(html, at)
    return end.start() if end else len(html)


def _tokens(html: str) -> Iterator[tuple[str, object]]:
    """("comment", span), ("tag", tag) and, after a send of an element's name, ("content", span)."""
    at = 0
    while m := _MARK.search(html, at):
        if m[0] == "<!--":
            # The dashes that begin a comment can end it at once.
            abrupt = re.compile(r"-?>").match(html, m.end())
            end = abrupt or _COMMENT_END.search(html, m.end())
            at = end.end() if end else len(html)
            yield "comment", (m.start(), at)
        elif m[0][-1].isalpha() and m[0][1] not in "!?":
            tag = _tag(html, m.start())
            if tag is None:
                return
            at = tag.end
            switched = yield "tag", tag
            if switched:
                end = _content_end(html, at, switched)
                yield "content", (at, end)
                at = end
        else:
            close = html.find(">", m.end() - (m[0][1] == "/"))
            end = close + 1 if close >= 0 else len(html)
            at = end
            if not re.match(r"<!doctype", html[m.start() : m.start() + 9], re.I):
                yield "comment", (m.start(), end)


def loads(tag: str, attribute: str, values: dict[str, str]) -> bool:
    """Does a URL at this attribute load a resource (or does the reader follow it)?"""
    if (tag, attribute) in FOLLOWED:
        return False
    if (tag, attribute) != ("link", "href"):
        return True
    rels = values.get("rel", "").lower().split()
    return not rels or bool(re.match(r"\s*text/css\b", values.get("type", ""), re.I)) or not PAGE_RELS.issuperset(rels)


def _is_point(namespace: str, tag: _Tag) -> bool:
    if namespace == "svg":
        return tag.name in SVG_POINTS
    encoding = next((v for n, _, _, v in tag.attributes if n == "encoding"), "")
    return tag.name in MATH_POINTS or tag.name == "annotation-xml" and encoding.strip().lower() in ANNOTATIONS


def html_regions(html: str, base: int = 0, inside: bool = False) -> list[Region]:
    """The regions of a page in order, without overlap. The rest is markup text, where references decode and load nothing.

    The content of ``noscript`` is read again as markup: readers without
    scripts see it so. ``inside`` says that ``html`` is such content; another
    ``noscript`` in it ends where it ends, so reading goes on afresh there.
    """
    found: list[Region] = []
    frames: list[tuple[str, str, bool]] = []  # open foreign elements and points: name, namespace, foreign
    style_at = -1  # where an open style of foreign content begins
    tokens, reply = _tokens(html), None
    while True:
        try:
            kind, token = tokens.send(reply)
        except StopIteration:
            break
        reply = None
        if kind == "comment":
            if style_at < 0:
                found.append(Region(base + token[0], base + token[1], "comment", True, False))
            continue
        if token.closes:
            if token.name == "style" and style_at >= 0:
                found.append(Region(base + style_at, base + token.start, "foreign style", False, True))
                style_at = -1
            last = next((k for k in reversed(range(len(frames))) if frames[k][0] == token.name), None)
            if last is not None:
                del frames[last:]
            continue
        names = {n: v for n, _, _, v in token.attributes}
        if style_at < 0:
            found += [
                Region(base + start, base + end, "attribute", False, loads(token.name, n, names)) for n, start, end, _ in token.attributes
            ]
        if frames and frames[-1][2]:
            breaks = token.name in BREAKING or token.name == "font" and not BREAKING_FONT.isdisjoint(names)
            if not breaks:
                namespace = frames[-1][1]
                if not token.self_closing:
                    frames.append((token.name, namespace, not _is_point(namespace, token)))
                    if token.name == "style" and style_at < 0:
                        style_at = token.end
                continue
            while frames and frames[-1][2]:
                frames.pop()
        if token.name in FOREIGN:
            if not token.self_closing:
                frames.append((token.name, token.name, True))
        elif token.name == "noscript" and inside:
            frames, style_at = [], -1
        elif token.name in RAW or token.name in DECODED:
            _, (start, end) = tokens.send(token.name)
            if token.name == "noscript":
                found += html_regions(html[start:end], base + start, inside=True)
                style_at = -1
            elif token.name in RAW:
                found.append(Region(base + start, base + end, token.name, True, token.name == "style"))
                style_at = -1
    if style_at >= 0:
        found.append(Region(base + style_at, base + len(html), "foreign style", False, True))
    return sorted(found)
