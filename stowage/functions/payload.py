"""Literal replacement inside serialized values and JSON, for the few cells that need Python.

Only string *values* change; keys, numbers and layout are copied. Byte lengths of serialized
strings are written anew. A serialized value that holds any object other than ``stdClass`` is left
alone as a whole. Nothing is ever instantiated: a scan marks where the string values lie.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.columns import (
    TRIM_CHARS, check_pairs, is_serialized, may_match, replace_pairs,
)

RESULT = "value string, hits long, kind string"

# Deepest nesting the two formats accept.
MAX_JSON_DEPTH = 512
MAX_SERIALIZED_DEPTH = 4096

_COUNT = rb"([0-9]{1,18})"
_SCALAR = re.compile(
    rb"(?:N|b:[01]|i:[+-]?[0-9]+|[rR]:[0-9]+"
    rb"|d:(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NAN));"
)
_STRING = re.compile(rb"s:" + _COUNT + rb':"')
_ARRAY = re.compile(rb"a:" + _COUNT + rb":\{")
_CLASS = re.compile(rb"([OCE]):" + _COUNT + rb':"')
_BODY = re.compile(rb'":' + _COUNT + rb":\{")
_OUTER = re.compile(
    rb'N;\Z|[aOE]:[0-9]+:|s:[0-9]+:(?=.*"[\x00-\x7f]\Z)|[bid]:[0-9.E+-]+;', re.DOTALL
)
_JSON_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_BLANKS = b" \t\n\r\0\x0b"


def _string_values(cell: bytes):
    """Positions of string values in one serialized value: ``(spans, opaque)``, None if broken.

    A span is (token start, content start, content end). ``slots`` holds, per open container, how
    many keys and values are still due; an even number means that a key comes next.
    """
    spans, slots, opaque, pos = [], [], False, 0
    while True:
        key_due = bool(slots) and slots[-1] % 2 == 0
        inner = None
        if found := _SCALAR.match(cell, pos):
            if key_due and cell[pos : pos + 1] != b"i":
                return None
            pos = found.end()
        elif found := _STRING.match(cell, pos):
            end = found.end() + int(found[1])
            if cell[end : end + 2] != b'";':
                return None
            if not key_due:
                spans.append((pos, found.end(), end))
            pos = end + 2
        elif key_due:
            return None
        elif found := _ARRAY.match(cell, pos):
            inner, pos = int(found[1]), found.end()
        elif found := _CLASS.match(cell, pos):
            name_end = found.end() + int(found[2])
            opaque |= found[1] != b"O" or cell[found.end() : name_end].lower() != b"stdclass"
            if found[1] == b"E":
                if cell[name_end : name_end + 2] != b'";':
                    return None
                pos = name_end + 2
            elif body := _BODY.match(cell, name_end):
                if found[1] == b"O":
                    inner, pos = int(body[1]), body.end()
                else:
                    pos = body.end() + int(body[1]) + 1
                    if cell[pos - 1 : pos] != b"}":
                        return None
            else:
                return None
        else:
            return None
        if slots:
            slots[-1] -= 1
        if inner is not None:
            slots.append(2 * inner)
            if len(slots) > MAX_SERIALIZED_DEPTH:
                return None
        while slots and not slots[-1]:
            if cell[pos : pos + 1] != b"}":
                return None
            pos += 1
            slots.pop()
        if not slots:
            return spans, opaque


class _Number(str):
    """A JSON number kept as it was written."""


def _reject(constant: str):
    raise ValueError(constant)


def _too_deep(cell: bytes) -> bool:
    if cell.count(b"[") + cell.count(b"{") <= MAX_JSON_DEPTH:
        return False
    level = deepest = 0
    for char in _JSON_STRING.sub(b"", cell):
        level += (char in b"[{") - (char in b"]}")
        deepest = max(deepest, level)
    return deepest > MAX_JSON_DEPTH


def _json_text(text: str) -> str:
    encoded = json.dumps(text, ensure_ascii=False)
    return encoded.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def _replace_json(cell: bytes, pairs) -> tuple[bytes, int, bool] | None:
    """The re-encoded text, its hits and whether a serialized value lies inside; None if not JSON."""
    hits, guarded = 0, False

    def encode(node) -> str:
        nonlocal hits, guarded
        if isinstance(node, _Number):
            return node
        if isinstance(node, str):
            value, found, kind = replace_cell(node.encode(), pairs)
            hits += found
            guarded |= kind in ("serialized", "opaque")
            return _json_text(value.decode())
        if isinstance(node, dict):
            return "{" + ",".join([_json_text(k) + ":" + encode(v) for k, v in node.items()]) + "}"
        if isinstance(node, list):
            return "[" + ",".join([encode(v) for v in node]) + "]"
        return json.dumps(node)

    try:
        if _too_deep(cell):
            return None
        node = json.loads(
            cell.decode(), parse_int=_Number, parse_float=_Number, parse_constant=_reject
        )
        return encode(node).encode(), hits, guarded
    except ValueError:  # not JSON, not UTF-8, or half of a surrogate pair
        return None


def replace_cell(cell: bytes, pairs: Sequence[tuple[bytes, bytes]]) -> tuple[bytes, int, str]:
    """One cell's new bytes, the number of hits and what the cell was taken for."""
    kind = "plain"
    trimmed = cell.strip(_BLANKS)
    if trimmed != b"b:0;" and (_OUTER.match(trimmed) or cell.startswith(b"C:")):
        scan = _string_values(cell)
        if scan is None:
            kind = "plain" if cell.startswith(b"C:") else "malformed"
        elif scan[1]:
            return cell, 0, "opaque"
        else:
            parts, hits, done = [], 0, 0
            for token, start, end in scan[0]:
                value, found, _ = replace_cell(cell[start:end], pairs)
                hits += found
                parts += [cell[done:token], b's:%d:"' % len(value), value]
                done = end
            return (b"".join(parts) + cell[done:] if hits else cell), hits, "serialized"
    elif cell.lstrip(_BLANKS)[:1] in (b"{", b"["):
        decoded = _replace_json(cell, pairs)
        if decoded is not None:
            value, hits, guarded = decoded
            if hits or guarded:
                return (value if hits else cell), hits, "json"
            kind = "json"
    hits = 0
    for old, new in pairs:
        if found := cell.count(old):
            cell, hits = cell.replace(old, new), hits + found
    return cell, hits, kind


def _replace_text(text: str, pairs) -> tuple[str, int, str]:
    try:
        value, hits, kind = replace_cell(text.encode(), pairs)
        return value.decode(), hits, kind
    except (RecursionError, UnicodeError):  # one bad cell must not fail the task; it stays, and is counted as such
        return text, 0, "opaque"


def payload_udf(pairs: Sequence[tuple[str, str]]):
    """Arrow-batched replacement, ``struct<value, hits, kind>``; NULL cells cost nothing."""
    encoded = [(old.encode(), new.encode()) for old, new in check_pairs(pairs)]

    def replace_cells(cells: pd.Series) -> pd.DataFrame:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        rows = [
            (None, None, None) if text is None else _replace_text(text, encoded) for text in cells
        ]
        return pd.DataFrame(rows, columns=["value", "hits", "kind"]).astype({"hits": "Int64"})

    replace_cells.__annotations__ = {"cells": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(replace_cells, RESULT)


UNMATCHED, PLAIN, STRUCTURED = 0, 1, 2


def route(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Where a cell goes: nothing can match, plain text, or Python; NULL for NULL.

    Looks at the first two characters before anything that has to copy the whole cell.
    """
    head = F.substring(F.ltrim(col, F.lit(TRIM_CHARS)), 1, 2)
    first = F.substring(head, 1, 1)
    serialized = (
        first.isin(*"aOEsbidN") & F.substring(head, 2, 1).isin(":", ";") & is_serialized(col)
    )
    shaped = first.isin("{", "[") | serialized | F.startswith(col, F.lit("C:"))
    return (
        F.when(~may_match(col, pairs), UNMATCHED)
        .when(shaped, STRUCTURED)
        .when(col.isNotNull(), PLAIN)
    )


def structured_replace(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """``struct<value, hits, kind>`` for one text column; NULL stays NULL.

    Cells that cannot match never leave the JVM, and plain text is replaced there too. The Python
    function sees NULL for all of those, because a condition around it does not keep rows away.
    ``kind`` is one of unmatched, plain, serialized, json, opaque, malformed.
    """
    pairs = check_pairs(pairs)
    way = route(col, pairs)
    plain = replace_pairs(col, pairs)

    def result(value: Column, hits: Column, kind: str) -> Column:
        return F.struct(value.alias("value"), hits.alias("hits"), F.lit(kind).alias("kind"))

    return (
        F.when(way == UNMATCHED, result(col, F.lit(0).cast("long"), "unmatched"))
        .when(way == PLAIN, result(plain["value"], plain["hits"], "plain"))
        .when(way == STRUCTURED, payload_udf(pairs)(F.when(way == STRUCTURED, col)))
    )


def register_sql(spark, name: str, pairs: Sequence[tuple[str, str]]) -> None:
    """Make the replacement callable from SQL as ``name(cell)``."""
    spark.udf.register(name, payload_udf(pairs))
