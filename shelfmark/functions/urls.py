"""Parts of URLs as browsers read them (the WHATWG URL standard, without a base).

Plain http(s) URLs are read by expressions in the JVM. The others, with blanks
or backslashes, user names, odd characters, numeric, bracketed, percent-encoded
or international hosts, and other schemes, go through one Arrow pass.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes with an authority of their own rules, and their default ports.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
#: Characters that no host may have, and those that no domain may have besides.
_NOT_IN_HOST = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
_NOT_IN_DOMAIN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
#: What a path shows percent-encoded.
_PATH_ENCODED = re.compile(r"[\x00-\x20\"#<>?^`{}\x7f-\U0010ffff]")
_DOT = re.compile(r"(?:\.|%2e){1,2}", re.I)
#: Full stops of other scripts, and characters that international hosts ignore.
_STOPS = dict.fromkeys(map(ord, "\u3002\uff0e\uff61"), ".")
_IGNORED = dict.fromkeys([0xAD, 0x34F, *range(0x180B, 0x1810), 0x200B, 0x2060, 0x2064, *range(0xFE00, 0xFE10), 0xFEFF])
#: Characters that keep their own form although case folding would change them.
_KEPT = "\u00df\u03c2\u200c\u200d"

PARTS = T.StructType(
    [
        T.StructField("scheme", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)


def _label(label: str) -> str | None:
    """A label of an international host in ASCII; null if it may not be one."""
    if label.isascii():
        if not label.startswith("xn--"):
            return label
        try:
            shown = label[4:].encode().decode("punycode")
        except UnicodeError:
            return None
        return label if shown and not shown.isascii() and _label(shown) == label else None
    mapped = "".join(c if c in _KEPT else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in label)
    mapped = unicodedata.normalize("NFC", mapped)
    if mapped.isascii():
        return _label(mapped)
    kinds = [unicodedata.category(c) for c in mapped]
    joins = {"\u200c", "\u200d"}
    if kinds[0][0] == "M" or any(k[0] == "C" and c not in joins or k[0] == "Z" for c, k in zip(mapped, kinds, strict=True)):
        return None
    return "xn--" + mapped.encode("punycode").decode()


def _number(part: str) -> int | None:
    """A part of a numeric host: decimal, 0x hexadecimal or octal."""
    if re.fullmatch(r"0[xX][0-9a-fA-F]*", part):
        return int(part[2:] or "0", 16)
    if re.fullmatch(r"0[0-7]+", part):
        return int(part, 8)
    return int(part) if re.fullmatch(r"0|[1-9][0-9]*", part) else None


def _ipv4(host: str) -> str | None:
    parts = host.removesuffix(".").split(".")
    values = [_number(p) if len(p) < 40 else None for p in parts]
    if len(parts) > 4 or None in values or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(parts)):
        return None
    whole = values[-1] + sum(v << 8 * (3 - k) for k, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(whole))


def _ipv6(inside: str) -> str | None:
    try:
        packed = ipaddress.IPv6Address("" if "%" in inside else inside).packed
    except ValueError:
        return None
    short = ":".join(f"{packed[k] << 8 | packed[k + 1]:x}" for k in range(0, 16, 2))
    # The first of the longest runs of two zeros or more is left out.
    runs = sorted(re.finditer(r"(?<![0-9a-f])0(?::0)+(?![0-9a-f])", short), key=lambda m: (m.start() - m.end(), m.start()))
    if runs:
        short = short[: runs[0].start()].removesuffix(":") + "::" + short[runs[0].end() :].removeprefix(":")
    return f"[{short}]"


def host_of(written: str, special: bool) -> str | None:
    """A host as browsers show it; null if the URL fails because of it."""
    if written.startswith("["):
        return _ipv6(written[1:-1]) if written.endswith("]") else None
    if not special:
        if _NOT_IN_HOST.search(written):
            return None
        return re.sub(r"[\x00-\x1f\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), written)
    shown = unquote_to_bytes(written).decode("utf-8", "replace") if "%" in written else written
    if shown.isascii() and "xn--" not in (host := shown.lower()):
        pass
    else:
        labels = [_label(x) if x else x for x in shown.translate(_STOPS).translate(_IGNORED).lower().split(".")]
        if None in labels:
            return None
        host = ".".join(labels)
    if not host or _NOT_IN_DOMAIN.search(host):
        return None
    last = host.removesuffix(".").rpartition(".")[2]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(host)
    return host


def _path(written: str, special: bool) -> str:
    """The path with its dot segments walked and characters encoded."""
    if special:
        written = written.replace("\\", "/")
    out: list[str] = []
    segments = written.removeprefix("/").split("/")
    for k, segment in enumerate(segments):
        last = k + 1 == len(segments)
        if _DOT.fullmatch(segment):
            if segment.lower().replace("%2e", ".") == "..":
                out = out[:-1]
            if last:
                out.append("")
        else:
            out.append(_PATH_ENCODED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), segment))
    return "/" + "/".join(out)


def parse_url(url: str | None) -> tuple[str, str, int | None, str] | None:
    """(scheme, host, port, path) of an absolute URL; null for what is none.

    The host is empty where the scheme has none, the port null where it is
    the scheme's own.
    """
    if url is None:
        return None
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    scheme, colon, rest = text.partition(":")
    if not colon or not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme):
        return None
    scheme = scheme.lower()
    special = scheme in SPECIAL
    rest = rest.partition("#")[0].partition("?")[0] if special or rest.startswith("/") else rest
    slashes = "/\\" if special else "/"
    if special and scheme != "file":
        rest = rest.lstrip(slashes)
    elif len(rest) > 1 and rest[0] in slashes and rest[1] in slashes:
        rest = rest[2:]
    elif special or rest.startswith("/"):
        return scheme, "", None, _path(rest, special)
    else:  # what follows is no hierarchy
        opaque = re.split("[?#]", rest, maxsplit=1)[0]
        return scheme, "", None, re.sub(r"[\x00-\x1f\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), opaque)
    end = re.search(r"[/\\]" if special else "/", rest)
    authority, path = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    if scheme == "file" and re.fullmatch(r"[A-Za-z][:|]", authority):
        return scheme, "", None, _path("/" + authority[0] + ":" + path, True)
    _, at, place = authority.rpartition("@")
    named = re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?", place) or re.fullmatch(r"([^:]*)(?::([0-9]*))?", place)
    if not named:
        return None
    written, digits = named[1], (named[2] or "").lstrip("0") or ("0" if named[2] else "")
    if not written and (at or named[2] is not None or special and scheme != "file"):
        return None
    if len(digits) > 5 or digits and (int(digits) > 65535 or scheme == "file"):
        return None
    host = host_of(written, special) if written else ""
    if host is None:
        return None
    if scheme == "file" and host == "localhost":
        host = ""
    port = int(digits) if digits and int(digits) != SPECIAL.get(scheme) else None
    return scheme, host, port, _path(path, special) if path or special else ""


@F.pandas_udf(PARTS)
def _odd_parts(urls: pd.Series) -> pd.DataFrame:
    found = [parse_url(u) or (None,) * 4 for u in urls]
    frame = pd.DataFrame(found, columns=["scheme", "host", "port", "path"])
    return frame.astype({"port": "Int32"})


#: Plain URLs: letters, digits, dots and hyphens as host, and a path without characters that change.
_PLAIN = r"^(?i)https?://[a-z0-9.-]+(?:/[a-z0-9/_~!$&'()*+,;=:@%.\[\]|-]*+)?(?:[?#]|\z)"
#: Its last label begins with a letter (so it is no number).
_NAMED = r"^(?i)https?://(?:[^/?#]*\.)?[a-z][a-z0-9-]*\.?(?:[/?#]|\z)"
#: What keeps a URL from being plain: ASCII forms of international labels, dot segments, breaks.
_CHANGES = r"(?i)^https?://[^/?#]*xn--|^[^?#]*/(?:\.|%2e){1,2}(?:[/?#]|\z)|[\t\n\r]|[\x00-\x20]\z"


def parts(url: Column) -> Column:
    """struct(scheme, host, port, path) of a URL; null if it does not parse."""
    clean = url.rlike(_PLAIN) & url.rlike(_NAMED) & ~url.rlike(_CHANGES)
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)", k)
    plain = F.struct(
        F.lower(part(1)).alias("scheme"),
        F.lower(part(2)).alias("host"),
        F.lit(None).cast("int").alias("port"),
        F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/")).alias("path"),
    )
    odd = _odd_parts(F.when(~clean, url))
    return F.when(clean, plain).when(odd["scheme"].isNotNull(), odd)
