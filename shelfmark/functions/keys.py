"""Capture keys, digests, paths and replay URLs as column expressions.

A capture key is ``<timestamp>/<original URL>``: 4 to 14 digits kept as text,
the URL verbatim. All functions are null for null input unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import parts

ARCHIVE = "https://web.archive.org/web/"
#: Flags of page requisites.
REQUISITE_FLAGS = ("im_", "cs_", "js_", "oe_")
_SRI = r"^sha256-[A-Za-z0-9+/]{43}=\z"


def capture_key(timestamp: Column, url: Column) -> Column:
    return F.concat(timestamp, F.lit("/"), url)


def key_timestamp(key: Column) -> Column:
    return F.split_part(key, F.lit("/"), F.lit(1))


def key_original(key: Column) -> Column:
    """What follows the first slash; null without one."""
    at = F.instr(key, "/")
    return F.when(at > 0, F.substr(key, at + 1))


def capture_hash(key: Column) -> Column:
    """Lower-case hex sha256 of the key's UTF-8 bytes."""
    return F.sha2(key, 256)


def capture_path(key: Column) -> Column:
    h = capture_hash(key)
    return F.concat(F.lit("cap/"), F.substr(h, F.lit(1), F.lit(2)), F.lit("/"), h)


def meta_path(key: Column) -> Column:
    h = capture_hash(key)
    return F.concat(F.lit("meta/"), F.substr(h, F.lit(1), F.lit(2)), F.lit("/"), h, F.lit(".json"))


def sri(content: Column) -> Column:
    """``sha256-`` and the base64 digest of bytes or text."""
    return F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2(content, 256))))


def is_sri(value: Column) -> Column:
    return F.coalesce(value.rlike(_SRI), F.lit(False))


def body_path(content_hash: Column) -> Column:
    """Path of a body by its SRI digest; null where the digest is malformed."""
    h = F.lower(F.hex(F.unbase64(F.substr(content_hash, F.lit(8)))))
    return F.when(is_sri(content_hash), F.concat(F.lit("cap/"), F.substr(h, F.lit(1), F.lit(2)), F.lit("/"), h))


def strip_fragment(key: Column) -> Column:
    return F.split_part(key, F.lit("#"), F.lit(1))


def _bare_host(text: Column) -> Column:
    """Dotted labels of word characters and hyphens, to the end or a mark. Flat patterns: a host of any length is one run."""
    labels = text.rlike(r"^[\w-]++\.[\w-][\w.-]*+(?<!\.)([:/?#]|\z)")
    return labels & ~text.rlike(r"^[\w.-]*?\.\.")


def repair_url(rest: Column) -> Column:
    """A URL with a host from what a replay path embeds, or null.

    Collapsed schemes get their slash back, ``//host`` is https, a bare dotted host http.
    """
    whole = F.regexp_replace(rest, r"^(?i)(https?):/(?!/)", "$1://")
    return (
        F.when(whole.rlike(r"^(?i)https?://[^/]"), whole)
        .when(whole.rlike(r"^//[^/]"), F.concat(F.lit("https:"), whole))
        .when(_bare_host(whole), F.concat(F.lit("http://"), whole))
    )


def repair_original(original: Column) -> Column:
    """The weaker repair of requisites: never null, bare hosts stay."""
    whole = F.regexp_replace(original, r"^(https?):/(?!/)", "$1://")
    return F.when(F.startswith(whole, F.lit("//")), F.concat(F.lit("https:"), whole)).otherwise(whole)


def parse_replay(url: Column) -> Column:
    """struct(timestamp, flag, original) of a replay URL with a two-letter flag at most; null if it is none."""
    pattern = r"^https?://web\.archive\.org/web/(\d{4,14})([a-z]{2}_)?/([^\n]+)\z"
    part = lambda k: F.regexp_extract(url, pattern, k)
    return F.when(
        url.rlike(pattern),
        F.struct(part(1).alias("timestamp"), part(2).alias("flag"), repair_original(part(3)).alias("original")),
    )


def parse_path(path: Column) -> Column:
    """struct(timestamp, flag, original, key, archive_url) of a request path; null if it is no capture."""
    pattern = r"^/(?:web/)?(\d{4,14})([a-z]{1,3}_)?/([^\n]+)\z"
    part = lambda k: F.regexp_extract(path, pattern, k)
    original = repair_url(part(3))
    return F.when(
        path.rlike(pattern) & original.isNotNull(),
        F.struct(
            part(1).alias("timestamp"),
            F.nullif(part(2), F.lit("")).alias("flag"),
            original.alias("original"),
            capture_key(part(1), original).alias("key"),
            F.concat(F.lit(ARCHIVE), part(1), part(2), F.lit("/"), original).alias("archive_url"),
        ),
    )


def parse_archive_url(url: Column) -> Column:
    """:func:`parse_path` of a full replay URL, whose host may be in any case."""
    path = F.regexp_extract(url, r"^(?i)https?://web\.archive\.org/web(/[^\n]+)\z", 1)
    return parse_path(path)


def replay_url(key: Column, flag: Column | None = None) -> Column:
    mark = F.coalesce(flag, F.lit("")) if flag is not None else F.lit("")
    return F.concat(F.lit(ARCHIVE), key_timestamp(key), mark, F.lit("/"), key_original(key))


def raw_url(key: Column) -> Column:
    """The replay of the raw bytes; null for what is no capture key."""
    return F.when(key.rlike(r"^\d{4,14}/[^\n]+"), replay_url(key, F.lit("id_")))


def clean_port(url: Column) -> Column:
    out = F.regexp_replace(url, r"^(http://[^/:]+):80(?=/|\z)", "$1")
    return F.regexp_replace(out, r"^(https://[^/:]+):443(?=/|\z)", "$1")


def match_key(url: Column) -> Column:
    """Comparison form: no default port, scheme, ``www.``, root dot or trailing slashes; lower case."""
    out = F.regexp_replace(clean_port(url), r"^(?i)https?://", "")
    out = F.regexp_replace(out, r"^(?i)www\.", "")
    out = F.regexp_replace(out, r"^([^/]+?)\.(?=/|\z)", "$1")
    return F.lower(F.regexp_replace(out, r"/+\z", ""))


def hostname(url: Column) -> Column:
    """The host as browsers show it, without its port; empty where a scheme has none, null if the URL does not parse."""
    return parts(url)["host"]


def pathname(url: Column) -> Column:
    """The path as browsers show it; null if the URL does not parse."""
    return parts(url)["path"]


def in_domain(url: Column, domain: str) -> Column:
    host = hostname(url)
    return F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False))


def content_type(stored: Column) -> Column:
    """A content type as served: an empty one is the octet stream."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.lit("application/octet-stream"))


def infer_flag(own: Column, resource_type: Column) -> Column:
    """The reference's own flag, else one by resource type."""
    kind = F.lower(resource_type)
    guess = (
        F.when(kind == "image", "im_").when(kind == "stylesheet", "cs_").when(kind == "script", "js_").otherwise("oe_")
    )
    return F.coalesce(F.nullif(own, F.lit("")), guess)


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def short_date(timestamp: Column) -> Column:
    """``Feb 26 2009`` of a timestamp of 8 digits or more, else the text itself."""
    day = F.try_to_timestamp(F.substr(timestamp, F.lit(1), F.lit(8)), F.lit("yyyyMMdd"))
    return F.when(timestamp.rlike(r"^\d{8}") & day.isNotNull(), F.date_format(day, "MMM d yyyy")).otherwise(timestamp)


#: Bytes that a request line cannot carry as they are, besides controls and bytes from 0x7F on.
_ESCAPED = " \"#%'<>\\^`{}"


def format_path(key: Column) -> Column:
    """``/`` and the key, with bytes that a request line cannot carry as %XX of their UTF-8 form."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    special = lambda c: (F.ascii(c) < 0x20) | (F.ascii(c) >= 0x7F) | F.contains(F.lit(_ESCAPED), c)
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.concat(F.lit("/"), F.array_join(F.transform(chars, lambda c: F.when(special(c), escaped(c)).otherwise(c)), ""))


def decode_path(path: Column) -> Column:
    """What :func:`format_path` made, decoded; other %XX sequences stay."""
    hexed = F.regexp_extract_all(path, F.lit(r"(%[0-9A-Fa-f]{2})|([^%]+|%)"), F.lit(0))
    value = lambda t: F.conv(F.substr(t, F.lit(2), F.lit(2)), 16, 10).cast("int")
    known = [ord(c) for c in _ESCAPED]
    ours = lambda t: t.rlike(r"^%[0-9A-Fa-f]{2}\z") & ((value(t) <= 0x1F) | (value(t) >= 0x7F) | value(t).isin(known))
    part = lambda t: F.when(ours(t), F.upper(F.substr(t, F.lit(2)))).otherwise(F.hex(F.encode(t, "UTF-8")))
    joined = F.array_join(F.transform(hexed, part), "")
    return F.when(F.contains(path, F.lit("%")), F.decode(F.unhex(joined), "UTF-8")).otherwise(path)


def to_doc(value: Column) -> Column:
    """struct(url, key) of a replay URL or a bare capture key; null for anything else."""
    replay = parse_replay(value)
    bare = value.rlike(r"^\d{4,14}/[\s\S]+\z")
    return F.when(
        replay.isNotNull(), F.struct(value.alias("url"), capture_key(replay["timestamp"], replay["original"]).alias("key"))
    ).when(bare, F.struct(replay_url(value).alias("url"), value.alias("key")))


def chrome_host(url: Column, host: str) -> Column:
    """A replay URL on another host; what is no replay URL stays."""
    return F.regexp_replace(url, r"^(?i)https?://web\.archive\.org(?=/web/)", f"https://{host}")


def host_of(url: Column) -> Column:
    """The host that a host policy is looked up by: lower case, no root dot; null if it does not parse."""
    return F.regexp_replace(hostname(url), r"\.\z", "")


def header_safe(value: Column) -> Column:
    """A header value: visible ASCII stays, any other byte becomes %XX of the UTF-8 form."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    plain = lambda c: c.rlike(r"^[\x20-\x7e]\z")
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(chars, lambda c: F.when(plain(c), c).otherwise(escaped(c))), "")


def normal_prefix(prefix: Column) -> Column:
    """An object prefix without slashes at its ends; empty for none."""
    return F.regexp_replace(F.coalesce(prefix, F.lit("")), r"^/+|/+\z", "")


def checkpoint_path(endpoint: Column, bucket: Column, prefix: Column) -> Column:
    """Where a verification of one target keeps its checkpoint: 32 hex digits of the target's digest.

    Quotes and backslashes in the three parts are escaped as JSON does.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [quoted(F.regexp_replace(endpoint, r"/+\z", "")), quoted(bucket), quoted(normal_prefix(prefix))]
    target = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(F.lit(".verify/"), F.substr(F.sha2(target, 256), F.lit(1), F.lit(32)), F.lit(".json"))


def without_mirror_host(body: Column, authority: str) -> Column:
    """A body in which a mirror's own authority is replaced by a neutral mark, so that mirrors compare equal."""
    return F.replace(body, F.lit(authority), F.lit("<mirror-host>"))


def decode_xml(text: Column) -> Column:
    """XML entities, the ampersand last, so that ``&amp;lt;`` stays ``&lt;``."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def backoff(attempt: Column, first: int, most: int | None = None) -> Column:
    """Milliseconds to wait before a repeat: ``first`` doubled for each attempt after the first, at most ``most``."""
    wait = (F.lit(first) * F.pow(F.lit(2.0), attempt - 1)).cast("long")
    return F.least(wait, F.lit(most).cast("long")) if most else wait


def metadata_safe(content_type: Column) -> Column:
    """May a content type travel as object metadata: no line ends, at most 1,000 bytes as a JSON string?"""
    quoted = F.octet_length(F.to_json(F.struct(content_type.alias("v")))) - F.lit(len('{"v":}'))
    return F.coalesce(~content_type.rlike(r"[\r\n]") & (quoted <= 1_000), F.lit(True))
