"""Scanners over markdown, HTML, style sheets and scripts.

Patterns with look-behind, callbacks or balanced brackets run as Arrow-batched
UDFs, one pass per body; everything else is in :mod:`.classify`.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classify import is_fetchable
from .keys import capture_key, decode_xml, repair_original
from .regions import html_regions
from .urls import parts

#: Link forms of markdown, in order of precedence.
LINK = re.compile(
    r"(!?)\[([^\]]+)\]\(((?:\([^()\s]*\)|[^()\s])+)\)"
    r"|^[ \t]*\[([^\]]+)\]:[ \t]*(\S+)"
    r"|<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]+)</a>"
    r"|<(https?://[^>\s]+)>"
    r"|(?<![(\"/<\]])https?://(?:\([^()\s<>\"'\]]*\)|[^\s()<>\"'\]])+",
    re.MULTILINE,
)
#: A replay reference (host, timestamp, flag, original).
REFERENCE = re.compile(
    r"((?:https?:)?//web\.archive\.org)?/web/(\d{4,14})([a-z]{1,3}_)?/([^\"'\s<>\\]+)"
)
#: What marks the archive's own additions to a page.
_TOOLBAR = re.compile(
    r"<!--\s*BEGIN WAYBACK TOOLBAR INSERT\s*-->[\s\S]*?<!--\s*END WAYBACK TOOLBAR INSERT\s*-->", re.I
)
_ASSET = re.compile(r"^(?:(?:https?:)?//(?:web-static\.)?archive\.org/(?:_?static|includes)/|/_?static/)", re.I)
_INLINE = re.compile(r"__wm\.|archive_analytics|window\.RufflePlayer\s*=")
_SCRIPT_SRC = re.compile(
    r"<script\b[^>]*\ssrc\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>[\s\S]*?</script>[ \t]*\n?", re.I
)
_SCRIPT = re.compile(r"<script\b(?![^>]*\ssrc\s*=)[^>]*>([\s\S]*?)</script>[ \t]*\n?", re.I)
_LINK_HREF = re.compile(r"<link\b[^>]*\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*/?>[ \t]*\n?", re.I)
_END = re.compile(r"<!--\s*End Wayback Rewrite JS Include\s*-->[ \t]*\n?", re.I)

LINKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("form", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
STRINGS = T.ArrayType(T.StringType())
REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("count", T.IntegerType())])


def links_of(markdown: str | None) -> list[dict]:
    """All links of a markdown text in document order, with their form."""
    forms = ((3, "inline", 2), (5, "reference", 4), (6, "html", 7), (8, "autolink", 8), (0, "bare", 0))
    out = []
    for pos, m in enumerate(LINK.finditer(markdown or "")):
        group, form, text = next(f for f in forms if f[0] == 0 or m[f[0]] is not None)
        form = "image" if form == "inline" and m[1] == "!" else form
        out.append({"pos": pos, "form": form, "url": m[group], "text": m[text]})
    return out


@F.pandas_udf(LINKS)
def markdown_links(texts: pd.Series) -> pd.Series:
    return texts.map(links_of)


def trim_unbalanced(text: str) -> str:
    """Cut at the first closing bracket that nothing opened."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return text[:i]
    return text


def archive_urls_of(markdown: str | None) -> list[str]:
    """Replay URLs in a text, to the first space, quote, bracket or unbalanced parenthesis."""
    found = re.finditer(r"https?://web\.archive\.org/web/[^ \t\n\r<>\"'`\]]*", markdown or "", re.I)
    return [trim_unbalanced(m[0]) for m in found]


@F.pandas_udf(STRINGS)
def archive_urls(texts: pd.Series) -> pd.Series:
    return texts.map(archive_urls_of)


@F.pandas_udf(T.StringType())
def trimmed(texts: pd.Series) -> pd.Series:
    return texts.map(trim_unbalanced, na_action="ignore")


def _without(html: str) -> str:
    bare = lambda v: v[1:-1] if v[:1] in "\"'" else v
    html = _TOOLBAR.sub("", html)
    html = _SCRIPT_SRC.sub(lambda m: "" if _ASSET.search(bare(m[1])) else m[0], html)
    html = _LINK_HREF.sub(lambda m: "" if _ASSET.search(bare(m[1])) else m[0], html)
    html = _SCRIPT.sub(lambda m: "" if _INLINE.search(m[1]) else m[0], html)
    return _END.sub("", html)


@F.pandas_udf(T.StringType())
def without_chrome(pages: pd.Series) -> pd.Series:
    """A replayed page without what the archive put into it; provenance comments stay."""
    return pages.map(_without, na_action="ignore")


#: What the audit's strip takes out, in order: pattern, and whether every place goes or the first alone.
AUDIT_CHROME = [
    (r"<script[^>]*src=[\"'][^\"']*(?:archive\.org\/includes\/analytics|\/_static\/js\/)[^\"']*[\"'][\s\S]*?<!--\s*End Wayback Rewrite JS Include\s*-->", False),
    (r"<!--\s*BEGIN WAYBACK TOOLBAR INSERT\s*-->[\s\S]*?<!--\s*END WAYBACK TOOLBAR INSERT\s*-->", False),
    (r"<!--(?:(?!-->)[\s\S])*?FILE ARCHIVED ON(?:(?!-->)[\s\S])*-->", True),
    (r"<!--\s*playback timings(?:(?!-->)[\s\S])*-->", True),
    (r"<script[^>]*src=[\"'][^\"']*\/_static\/js\/[^\"']*[\"'][^>]*>\s*<\/script>", True),
    (r"<link[^>]*href=[\"'][^\"']*\/_static\/css\/[^\"']*[\"'][^>]*\/?>", True),
    (r"<script[^>]*>[^<]*__wm\.(?:init|wombat|bt)\([\s\S]*?<\/script>", True),
]
#: A word of each pattern, in any case: where it is missing, the pattern cannot match and is not tried.
_AUDIT_WORDS = (
    "end wayback rewrite js include", "end wayback toolbar insert", "file archived on", "playback timings", "/_static/js/", "/_static/css/", "__wm."
)
_AUDIT = [(word, re.compile(p, re.I), 0 if every else 1) for word, (p, every) in zip(_AUDIT_WORDS, AUDIT_CHROME, strict=True)]


def audit_stripped(html: str) -> str:
    """A page without what the audit does not count as the page's own."""
    known = html.lower()
    for word, pattern, places in _AUDIT:
        if word in known:
            html = pattern.sub("", html, count=places)
    return html


@F.pandas_udf(T.StringType())
def audit_strip(pages: pd.Series) -> pd.Series:
    """The audit's strip, which drops provenance as well."""
    return pages.map(audit_stripped, na_action="ignore")


def requisites(html: Column) -> Column:
    """array<struct<pos, timestamp, flag, original, key>> of the flagged references of a page, unique by key."""
    pattern = r"(?:https?://web\.archive\.org)?/web/(\d{4,14})(im_|cs_|js_|oe_)/([^\"'\s<>\\]+)"
    group = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    found = F.arrays_zip(group(1).alias("t"), group(2).alias("f"), group(3).alias("o"))

    def item(x: Column, i: Column) -> Column:
        original = repair_original(_entities(_balanced(x["o"])))
        return F.struct(
            i.alias("pos"),
            x["t"].alias("timestamp"),
            x["f"].alias("flag"),
            original.alias("original"),
            capture_key(x["t"], original).alias("key"),
        )

    items = F.filter(F.transform(found, item), lambda x: (x["original"] != "") & is_fetchable(x["original"]))
    first = lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: y["key"] == x["key"])
    return F.filter(items, first)


def _entities(text: Column) -> Column:
    from .classify import decode_entities

    return decode_entities(text, spaces=False)


def _balanced(text: Column) -> Column:
    """:func:`trim_unbalanced` as an expression: characters while brackets stay balanced."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        goes = acc["open"] & (depth >= 0)
        return F.struct(
            depth.alias("depth"), (acc["length"] + F.when(goes, 1).otherwise(0)).alias("length"), goes.alias("open")
        )

    cut = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["length"])
    return F.when(F.contains(text, F.lit(")")), F.substr(text, F.lit(1), cut)).otherwise(text)


#: Attributes that hold URLs.
_URL_ATTRIBUTES = frozenset(("href", "src", "srcset", "action", "poster"))


def _unescape(text: str) -> str:
    for pattern, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&apos;", "'"), ("&quot;", '"')):
        text = re.sub(pattern, char, text, flags=re.I)
    return text


def _repaired(rest: str) -> str | None:
    whole = re.sub(r"^(https?):/(?!/)", r"\1://", rest, flags=re.I)
    if re.match(r"https?://[^/]", whole, re.I):
        return whole
    if re.match(r"//[^/]", whole):
        return "https:" + whole
    return "http://" + whole if re.match(r"[\w-]+(\.[\w-]+)+([:/?#]|\Z)", whole, re.ASCII) else None


def _literals(script: str):
    """(start, end, reference, rest) of string literals that are one absolute replay URL, from the quote to the quote."""
    for m in REFERENCE.finditer(script):
        quote = script[m.start() - 1 : m.start()] if m.start() else ""
        if quote not in ("'", '"') or not (m[1] or "").startswith("http"):
            continue
        end = m.start(4)
        while end < len(script) and script[end] not in "\r\n\\" and script[end] != quote:
            end += 1
        if script[end : end + 1] == quote:
            yield m.start(), end, m, script[m.start(4) : end]


def reference_keys(body: str | None) -> list[str]:
    """Keys that a body's replay references may resolve to, with entities decoded or not."""
    keys = {}
    for m in REFERENCE.finditer(body or ""):
        raw = trim_unbalanced(m[4])
        for form in (raw, _unescape(raw)):
            if original := _repaired(form):
                keys[f"{m[2]}/{original}"] = None
    for _, _, m, rest in _literals(body or ""):
        if original := _repaired(rest):
            keys[f"{m[2]}/{original}"] = None
    return list(keys)


@F.pandas_udf(STRINGS)
def referenced(bodies: pd.Series) -> pd.Series:
    return bodies.map(reference_keys)


def _spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with (start, end, new) put in place, in order."""
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


#: Elements whose content the rewriter reads as raw text.
_RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_VALUE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


class _Localiser:
    """Turns replay references whose capture is held into root-relative ones; counts them.

    A page is scanned once, region by region: attribute values that hold URLs,
    style sheets, scripts without a source, and comments, which are pages again.
    """

    def __init__(self, held):
        self.held, self.count = frozenset(held if held is not None else ()), 0

    def refs(self, text: str, decode: bool = False, follow: bool = False) -> str:
        edits = []
        for m in REFERENCE.finditer(text):
            raw = trim_unbalanced(m[4])
            original = _repaired(_unescape(raw) if decode else raw)
            if original is not None and (follow or f"{m[2]}/{original}" in self.held) and m[1]:
                edits.append((m.start(), m.end(), f"/web/{m[2]}{m[3] or ''}/{m[4]}"))
        self.count += len(edits)
        return _spliced(text, edits)

    def script(self, text: str) -> str:
        edits = []
        for start, end, m, rest in _literals(text):
            original = _repaired(rest)
            if original is not None and f"{m[2]}/{original}" in self.held:
                edits.append((start, end, f"/web/{m[2]}{m[3] or ''}/{rest}"))
        self.count += len(edits)
        return _spliced(text, edits)

    def value(self, tag: str, name: str, value: str) -> str:
        if name not in _URL_ATTRIBUTES and name != "style" and not name.startswith("data-"):
            return value
        return self.refs(value, decode=True, follow=(tag, name) in (("a", "href"), ("area", "href"), ("form", "action")))

    def scan(self, html: str) -> str:
        edits, at = [], 0
        while m := _OPEN.search(html, at):
            at = m.end()
            if m[1] is None:
                edits.append((m.start() + 4, m.end(), self.scan(html[m.start() + 4 : m.end()])))
                continue
            tag, names = m[1].lower(), set()
            for v in _VALUE.finditer(m[2]):
                names.add(v[1].lower())
                start = m.start(2) + v.start(2)
                edits.append((start, start + len(v[2]), self.value(tag, v[1].lower(), v[2])))
            if tag in _RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                end = close.start() if close else len(html)
                if tag == "style":
                    edits.append((at, end, self.refs(html[at:end])))
                elif tag == "script" and "src" not in names:
                    edits.append((at, end, self.script(html[at:end])))
                at = end
        return _spliced(html, edits)

    def page(self, html: str) -> str:
        return self.scan(_without(html))


def rewrite_body(kind: str | None, body: str | None, held) -> dict | None:
    """{text, count} of a body rewritten by its dialect; other dialects pass through."""
    if body is None:
        return None
    work = _Localiser(held)
    text = {"html": work.page, "css": work.refs, "js": work.script}.get(kind, str)(body)
    return {"text": text, "count": work.count}


@F.pandas_udf(REWRITTEN)
def rewritten(kinds: pd.Series, bodies: pd.Series, held: pd.Series) -> pd.DataFrame:
    found = [rewrite_body(*x) or {"text": None, "count": None} for x in zip(kinds, bodies, held, strict=True)]
    return pd.DataFrame(found, columns=["text", "count"])


#: Extensions of what pages load, and the mark of a replay path on any host.
RESOURCE_EXTENSION = r"\.(?:m?js|css|woff2?|ttf|otf|eot|png|jpe?g|gif|svg|ico|webp|bmp|mp4|webm|ogg|mp3|wav|m4a|flv|swf|json)$"
_EXTENSION = re.compile(RESOURCE_EXTENSION, re.I)
_REPLAY_ELSEWHERE = re.compile(r"https?:\/\/[^\s\"'<>)]+\/web\/\d{4,14}", re.I)

SCAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("region", T.StringType()),
            T.StructField("key", T.StringType()),
            T.StructField("resource", T.BooleanType()),
        ]
    )
)


def _placed(kind: str | None, body: str):
    """Each replay reference of a body with the region that it begins in, if any."""
    regions, r = html_regions(body) if kind == "html" else [], 0
    for m in REFERENCE.finditer(body):
        while r < len(regions) and regions[r].end <= m.start():
            r += 1
        inside = r < len(regions) and regions[r].start <= m.start()
        yield m, regions[r] if inside else None


def scan_body(kind: str | None, body: str | None) -> list[dict]:
    """Replay references of a text body in order: region, key, and whether they load a resource.

    Attribute values, text and styles of foreign content are decoded before
    their key is derived, raw text (scripts, style sheets, comments) is not. Outside attributes a flag
    or a resource extension makes a reference a resource.
    """
    out = []
    for m, region in _placed(kind, body or ""):
        decodes = kind == "html" and not (region and region.raw)
        raw = trim_unbalanced(m[4])
        original = _repaired(_unescape(raw) if decodes else raw)
        if original is None:
            continue
        told = m[3] in ("im_", "cs_", "js_", "oe_") or bool(_EXTENSION.search(re.sub(r"[?#].*", "", original, flags=re.S)))
        attribute = region is not None and region.kind == "attribute"
        place = region.kind if region else "text" if kind == "html" else kind or "text"
        out.append(
            {"pos": m.start(), "region": place, "key": f"{m[2]}/{original}", "resource": region.loads if attribute else told}
        )
    return out


@F.pandas_udf(SCAN)
def scanned(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([scan_body(*x) for x in zip(kinds, bodies, strict=True)], dtype=object)


#: A place in a line: what is shown of it, and the ends of an unbroken word, looked for that far.
_SHOWN, _WORD = 40, 300
_WORD_BEFORE = re.compile(r"[^\s\"'<>()\\=]*\Z")
_WORD_AFTER = re.compile(r"[^\s\"'<>)\\]*")


def excerpt(text: str, start: int, end: int) -> str:
    """Text around a place on one line; marks show what was cut or cannot be shown."""
    window = slice(max(0, start - _SHOWN), end + _SHOWN)
    marks = "\u2026" * (window.start > 0), "\u2026" * (window.stop < len(text))
    return marks[0] + re.sub(r"[^\x20-\x7e]", "\u00b7", text[window]) + marks[1]


def token_around(text: str, start: int, end: int) -> str:
    """The unbroken word that holds a place, to a bounded distance on each side."""
    before = _WORD_BEFORE.search(text[max(0, start - _WORD) : start])
    after = _WORD_AFTER.match(text, end, end + _WORD)
    return before[0] + text[start:end] + after[0]


BARE = T.ArrayType(
    T.StructType(
        [T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("excerpt", T.StringType())]
    )
)


def bare_hits_of(body: str | None) -> list[dict]:
    """Mentions of the archive's host that are no replay reference, with the word and the text around."""
    body = body or ""
    taken = [m.span() for m in REFERENCE.finditer(body)]
    out, r = [], 0
    for m in re.finditer(r"archive\.org", body, re.I):
        while r < len(taken) and taken[r][1] <= m.start():
            r += 1
        if r == len(taken) or m.start() < taken[r][0]:
            out.append({"pos": m.start(), "token": token_around(body, *m.span()), "excerpt": excerpt(body, *m.span())})
    return out


@F.pandas_udf(BARE)
def bare_hits(bodies: pd.Series) -> pd.Series:
    return bodies.map(bare_hits_of)


ESCAPES = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("original", T.StringType()),
            T.StructField("key", T.StringType()),
            T.StructField("flag", T.StringType()),
            T.StructField("resource", T.BooleanType()),
            T.StructField("region", T.StringType()),
            T.StructField("excerpt", T.StringType()),
        ]
    )
)


def escapes_of(kind: str | None, body: str | None) -> list[dict]:
    """What a remastered text body still says of the archive, in order of place.

    ``archive-org``: a replay reference with the archive's host, its key
    (null if it repairs to no URL; without fragment) and whether its place
    loads a resource. ``archive-org-bare``: the host's name outside of those.
    ``absolute-web-escape``: a replay path on another host. References from
    the root are what a remastered body should hold, and are none.
    """
    body, out, taken = body or "", [], []
    name = "archive.org"
    for m, region in _placed(kind, body):
        if not m[1]:
            continue
        raw = trim_unbalanced(m[4])
        original = _repaired(_unescape(raw) if kind == "html" and not (region and region.raw) else raw)
        url = body[m.start() : m.start(4) + len(raw)]
        taken.append((m.start(), m.start() + len(url)))
        at = m.start() + m[1].index(name)
        out.append(
            {
                "pos": at,
                "kind": "archive-org",
                "url": url,
                "original": raw,
                "key": None if original is None else f"{m[2]}/{original}".partition("#")[0],
                "flag": m[3],
                "resource": kind == "css" or bool(region and region.loads),
                "region": region.kind if region else "text" if kind == "html" else kind or "text",
                "excerpt": excerpt(body, at, at + len(name)),
            }
        )
    none = dict.fromkeys(("original", "key", "flag", "region"))
    r = 0
    for m in re.finditer(r"archive\.org", body, re.I):
        while r < len(taken) and taken[r][1] <= m.start():
            r += 1
        if r == len(taken) or m.start() < taken[r][0]:
            found = {"pos": m.start(), "kind": "archive-org-bare", "url": token_around(body, *m.span()), "excerpt": excerpt(body, *m.span())}
            out.append(none | found | {"resource": False})
    for m in _REPLAY_ELSEWHERE.finditer(body):
        if name not in m[0].lower():
            out.append(none | {"pos": m.start(), "kind": "absolute-web-escape", "url": m[0], "resource": False, "excerpt": excerpt(body, *m.span())})
    return sorted(out, key=lambda x: x["pos"])


@F.pandas_udf(ESCAPES)
def escapes(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([escapes_of(*x) for x in zip(kinds, bodies, strict=True)], dtype=object)


def has_resource_extension(url: Column) -> Column:
    """Does the path of a URL end like something that pages load? False for what is no URL."""
    return F.coalesce(parts(url)["path"].rlike("(?i)" + RESOURCE_EXTENSION), F.lit(False))


def listed_keys(xml: Column) -> Column:
    """Object keys of a bucket listing, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<Key>(.*?)</Key>"), F.lit(1)), decode_xml)


def next_token(xml: Column) -> Column:
    """The continuation token of a listing that goes on; null where it ends."""
    token = F.regexp_extract(xml, r"(?s)<NextContinuationToken>(.*?)</NextContinuationToken>", 1)
    return F.when(xml.rlike(r"(?i)<IsTruncated>\s*true\s*</IsTruncated>") & (token != ""), decode_xml(token))


#: How far a link target in prose reaches.
_TARGET = re.compile(r"https?://(?:\([^()\s\"'<>\]]*\)|[^\s\"'<>()\]])+")
PLACES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("url", T.StringType()),
            T.StructField("form", T.StringType()),
        ]
    )
)
EDITS = "array<struct<start:int,end:int,text:string>>"


def _prose(markdown: str):
    """(start, end) of what is outside code fences; a fence that nothing closes is prose."""
    at = 0
    while (fence := markdown.find("```", at)) >= 0:
        close = markdown.find("```", fence + 3)
        if close < 0:
            break
        yield at, fence
        at = close + 3
    yield at, len(markdown)


def targets_of(markdown: str | None) -> list[dict]:
    """Link targets outside code fences, but not those that stand as link text."""
    markdown, out = markdown or "", []
    for low, high in _prose(markdown):
        for m in _TARGET.finditer(markdown, low, high):
            if m.end() == high or markdown[m.end()] != "]":
                out.append({"start": m.start(), "end": m.end(), "url": m[0], "form": "target"})
    return out


def places_of(markdown: str | None) -> list[dict]:
    """The place of the URL inside each link of a markdown text, in any form."""
    out = []
    for m in LINK.finditer(markdown or ""):
        link = links_of(m[0])[0] if m[5] is None else {"url": m[5], "form": "reference"}
        start = m.start() + m[0].index(link["url"])
        out.append({"start": start, "end": start + len(link["url"]), "url": link["url"], "form": link["form"]})
    return out


@F.pandas_udf(PLACES)
def link_targets(texts: pd.Series) -> pd.Series:
    return texts.map(targets_of)


@F.pandas_udf(PLACES)
def link_places(texts: pd.Series) -> pd.Series:
    return texts.map(places_of)


@F.pandas_udf(T.StringType())
def spliced(texts: pd.Series, edits: pd.Series) -> pd.Series:
    """Texts with their (start, end, text) put in place; without edits they stay."""

    def one(text: str | None, own) -> str | None:
        if text is None or own is None or not len(own):
            return text
        return _spliced(text, sorted((e["start"], e["end"], e["text"]) for e in own))

    return pd.Series([one(*x) for x in zip(texts, edits, strict=True)], dtype=object)
