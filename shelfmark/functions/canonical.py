"""Canonical JSON: keys sorted at every level, no white space, numbers as scripts of browsers write them."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _units(key: str) -> bytes:
    """Keys are ordered by their UTF-16 code units."""
    return key.encode("utf-16-be", "surrogatepass")


def _order(key: str) -> tuple[bool, int, bytes]:
    """Scripts list keys that are array indices first, by number."""
    index = key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < (1 << 32) - 1
    return (not index, int(key) if index else 0, _units(key))


def _number(value: float) -> str:
    if value != value or value in (float("inf"), float("-inf")):
        return "null"
    if value.is_integer() and abs(value) < 1e21:
        return str(int(Decimal(repr(value))))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    shown, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = shown[:point] + "." + shown[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + shown
    else:
        text = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def _written(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(value[k])}" for k in sorted(value, key=_order)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    text = json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else "".join(f"\\u{ord(c):04x}" if "\ud800" <= c <= "\udfff" else c for c in text)


def canonical(text: str | None, **changed: object) -> str | None:
    """A JSON text in canonical form, with some of an object's fields changed; null for what is no JSON.

    Of keys that stand twice the last counts; numbers are doubles. Nesting
    beyond what the interpreter's stack holds counts as no JSON.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=float, parse_constant=_no_constant)
        return _written({**value, **changed} if changed and isinstance(value, dict) else value)
    except (ValueError, RecursionError):
        return None


def _no_constant(name: str) -> None:
    raise ValueError(name)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def with_content(sidecars: pd.Series, hashes: pd.Series, lengths: pd.Series) -> pd.Series:
    """Sidecars in JSON that name another body; those without a new hash stay as they are."""
    rows = zip(sidecars, hashes, lengths, strict=True)
    return pd.Series(
        [t if not isinstance(h, str) else canonical(t, contentHash=h, contentLength=float(n)) for t, h, n in rows], dtype=object
    )
