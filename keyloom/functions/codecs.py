"""Value codecs: typed attribute JSON, ordered keys, score keys, number text."""

from __future__ import annotations

import math
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 32
TAGS = {"S", "N", "B", "BOOL", "NULL", "SS", "NS", "BS", "L", "M"}


class BadValue(ValueError):
    """An attribute value without exactly one known tag, or nested too deep."""


def check_value(value: dict, depth: int = 0) -> dict:
    """A typed attribute value as given, if it is one: exactly one tag, nesting within DEEPEST."""
    if depth > DEEPEST:
        raise BadValue("nested too deep")
    if not isinstance(value, dict) or len(value) != 1 or next(iter(value)) not in TAGS:
        raise BadValue(f"not exactly one tag: {value}")
    tag, body = next(iter(value.items()))
    if tag == "N":
        Decimal(body)
    for inner in body.values() if tag == "M" else body if tag == "L" else ():
        check_value(inner, depth + 1)
    return value


def attribute(json: Column, name: str, tag: str) -> Column:
    """One attribute of a typed JSON item as a Column: S string, N decimal, BOOL boolean, B binary, SS/NS arrays, L/M JSON text."""
    raw = F.get_json_object(json, f"$['{name}']['{tag}']")
    if tag == "N":
        return raw.cast("decimal(38,18)")
    if tag == "BOOL":
        return raw.cast("boolean")
    if tag == "B":
        return F.unbase64(raw)
    if tag in ("SS", "NS"):
        return F.from_json(raw, "array<string>") if tag == "SS" else F.transform(F.from_json(raw, "array<string>"), lambda x: x.cast("decimal(38,18)"))
    return raw


def attribute_present(json: Column, name: str) -> Column:
    """A typed null is present."""
    return F.get_json_object(json, f"$['{name}']").isNotNull()


def to_typed_json(columns: dict[str, tuple[Column, str]]) -> Column:
    """Typed JSON of columns by name with their tags; null columns are absent."""
    entries = []
    for name, (column, tag) in columns.items():
        body = F.base64(column) if tag == "B" else column.cast("string") if tag in ("S", "N") else column
        entries.append(F.when(column.isNotNull(), F.struct(body.alias(tag))).alias(name))
    return F.to_json(F.struct(*entries))


@F.pandas_udf(T.StringType())
def canonical_number(text: pd.Series) -> pd.Series:
    """Decimal text without exponent, plus sign or needless zeros; null for what is no number."""

    def one(s):
        try:
            d = format(Decimal(s), "f")
        except Exception:
            return None
        d = d.rstrip("0").rstrip(".") if "." in d else d
        return "0" if d in ("-0", "") else d

    return text.map(one)


def number_key(text: str) -> bytes:
    """Bytes that sort as the numbers do: sign, exponent, digits; those of negative numbers inverted."""
    sign, digits, exponent = Decimal(text).normalize().as_tuple()
    if not any(digits):
        return b"\x01"
    scale = len(digits) + exponent
    body = struct.pack(">i", scale + (1 << 30)) + bytes(d + 1 for d in digits) + b"\x00"
    return b"\x00" + bytes(255 - b for b in body) if sign else b"\x02" + body


def text_key(value: bytes) -> bytes:
    """Bytes that sort as the value does and end by themselves: zero bytes escaped, then a terminator."""
    return value.replace(b"\x00", b"\x00\xff") + b"\x00\x01"


def score_key(score: float) -> bytes:
    """8 bytes that sort as the scores do; -0 is 0."""
    if math.isnan(score):
        raise BadValue("no score")
    bits = struct.unpack(">Q", struct.pack(">d", score + 0.0 if score != 0 else 0.0))[0]
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def score_text(score: float) -> str:
    """Shortest text of a score, without an exponent."""
    if math.isinf(score):
        return "inf" if score > 0 else "-inf"
    return str(int(score)) if score == int(score) and abs(score) < 1e17 else format(Decimal(repr(score)), "f")


@F.pandas_udf(T.BinaryType())
def number_keys(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else number_key(x))


@F.pandas_udf(T.BinaryType())
def score_keys(score: pd.Series) -> pd.Series:
    return score.map(lambda x: None if x is None or x != x else score_key(x))
