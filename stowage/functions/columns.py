"""Column functions: text in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from both ends before text is tested for a serialized shape.
TRIM_CHARS = " \t\n\r\0\x0b"

# Characters escaped in a SQL string literal and the text each becomes, backslash first.
SQL_ESCAPES = [
    ("\\", "\\\\"),
    ("'", "\\'"),
    ('"', '\\"'),
    ("\0", "\\0"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\x1a", "\\Z"),
]

# Byte units, each 1024 times the one before.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

GZIP_MAGIC = bytearray(b"\x1f\x8b")


def named(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------- literal replacement


def check_pairs(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    checked = [(str(old), str(new)) for old, new in pairs]
    for old, new in checked:
        if not old:
            raise ValueError("the text to replace must not be empty")
        if old == new:
            raise ValueError(f"nothing to do: {old!r} would be replaced by itself")
    return checked


def stage_hits(before: Column, after: Column, old: str, new: str) -> Column:
    """How often ``old`` was found when ``before`` became ``after``."""
    old_bytes, new_bytes = len(old.encode()), len(new.encode())
    if old_bytes != new_bytes:  # the change in length already tells how often it matched
        grown = F.octet_length(after) - F.octet_length(before)
        return (grown / F.lit(new_bytes - old_bytes)).cast("long")
    removed = F.replace(before, F.lit(old), F.lit(""))
    return ((F.octet_length(before) - F.octet_length(removed)) / F.lit(old_bytes)).cast("long")


def replace_pairs(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacement, pair by pair on the previous pair's output: ``struct<value, hits>``."""
    value, hits = col, F.lit(0).cast("long")
    for old, new in check_pairs(pairs):
        replaced = F.replace(value, F.lit(old), F.lit(new))
        hits = hits + stage_hits(value, replaced, old, new)
        value = replaced
    hits = F.when(col.isNotNull(), hits)
    return F.struct(value.alias("value"), hits.alias("hits"))


def may_match(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """False only where no pair can change the cell.

    A match needs one of the texts in the raw cell, or a backslash, behind which a JSON escape may
    hide one. A later pair can match text that an earlier one produced only if that one matched.
    """
    gate = F.contains(col, F.lit("\\"))
    for old, _ in pairs:
        gate = gate | F.contains(col, F.lit(old))
    return gate


_BLANK = r"[ \t\n\r\x00\x0B]"
# One look at the untrimmed text: blanks, then a value's opening, and for text its closing quote too.
_SERIALIZED = (
    rf"(?s)^{_BLANK}*+(?:N;{_BLANK}*+\z"
    r"|[aOE]:[0-9]++:[^;}]*+[;}]"
    rf"|s:[0-9]++:(?=[^;}}]*+[;}}]).*\"[\x00-\x7f&&[^ \t\n\r\x00\x0B]]{_BLANK}*+\z"
    r"|[bid]:[0-9.E+-]++;)"
)


def is_serialized(col: Column) -> Column:
    """Whether trimmed text has the outer shape of a length-prefixed serialized value."""
    return col.rlike(_SERIALIZED)


# ---------------------------------------------------------------- paths


def parent_dir(path: Column) -> Column:
    """Everything before the last ``/``; empty at the top level."""
    tail = F.length(F.substring_index(path, "/", -1)) + 1
    return F.left(path, F.greatest(F.length(path) - tail, F.lit(0)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def path_and_ancestors(path: Column) -> Column:
    """``a/b/c`` gives ``[a, a/b, a/b/c]``; the empty root path gives ``['']``."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def top_segment(path: Column) -> Column:
    """First non-empty segment, NULL when there is none."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1))


def confine_path(path: Column, base: str) -> Column:
    """``path`` below ``base`` with every empty, ``.`` and ``..`` segment dropped."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda s: ~s.isin("", ".", ".."))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(kept, "/"))


# ---------------------------------------------------------------- names and text


# Scheme, user and port apart. The URL parser of the JVM knows no host with a "_" or beyond ASCII.
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def host_label(url: Column) -> Column:
    """Host of a URL reduced to ``[a-z0-9.-]`` (any case), or ``site``."""
    # The kept characters and the stand-in.
    host = F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"[^A-Za-z0-9.-]", "")
    # "0" counts as empty, as it does for the names this must agree with
    return F.coalesce(F.when(~host.isin("", "0"), host), F.lit("site"))


def snapshot_name(url: Column, at: Column, seed: Column) -> Column:
    """``<host>-<yyyyMMdd-HHmmss>-<8 characters drawn from the seed>``."""
    token = F.substring(F.sha2(seed.cast("string"), 256), 1, 8)
    return F.concat_ws("-", host_label(url), F.date_format(at, "yyyyMMdd-HHmmss"), token)


def safe_charset(name: Column) -> Column:
    """A character-set name cut to ``[A-Za-z0-9_]``, or ``utf8mb4``."""
    # The kept characters and the stand-in.
    cleaned = F.regexp_replace(name, r"[^A-Za-z0-9_]", "")
    return F.coalesce(F.when(~cleaned.isin("", "0"), cleaned), F.lit("utf8mb4"))


def clean_list(items: Column) -> Column:
    """Trimmed, non-empty, distinct strings, first occurrences in order."""
    trimmed = F.transform(items, lambda s: F.btrim(F.coalesce(s, F.lit("")), F.lit(TRIM_CHARS)))
    return F.array_distinct(F.filter(trimmed, lambda s: s != ""))


def sql_literal(col: Column, escape: bool = True) -> Column:
    """``NULL`` or the value's text, quoted; text of numbers and times needs no escapes."""
    text = col.cast("string")
    for char, escaped in SQL_ESCAPES if escape else []:
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def quote_ident(col: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(col, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------- numbers


def human_size(size: Column) -> Column:
    """Bytes as text: divided by 1024 up to TB, one decimal below 10, none otherwise. Sizes beyond 64 bits may come as decimals."""
    wide = "decimal(38,0)"
    size = F.coalesce(size.try_cast("long").cast(wide), size.cast(wide), F.lit(0).cast(wide))
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = size / F.lit(float(1024**power))
        shown = F.when(
            scaled < 10, F.format_string("%.1f", F.round(scaled, 1).cast("double"))
        ).otherwise(F.round(scaled, 0).cast(wide).cast("string"))
        text = F.when(size >= 1024**power, F.concat(shown, F.lit(" " + unit))).otherwise(text)
    return text


def percent_done(index: Column, total: Column, done: Column) -> Column:
    share = F.floor(index / F.greatest(total, F.lit(1)) * 100).cast("int")
    return F.when(done, F.lit(100)).otherwise(share)


def _version_parts(version: Column) -> Column:
    numeric = F.regexp_extract(version, r"^[0-9]+(?:\.[0-9]+)*", 0)
    return F.transform(F.split(numeric, r"\."), lambda p: p.try_cast("int"))


def version_newer(left: Column, right: Column) -> Column:
    """Whether dotted ``left`` is newer than ``right``, part by part; suffixes are cut first."""
    return _version_parts(left) > _version_parts(right)


# ---------------------------------------------------------------- digests


def crc32_hex(content: Column) -> Column:
    """CRC-32 as eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def is_gzip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(GZIP_MAGIC)


# ---------------------------------------------------------------- predicates


def manifest_supported(
    format_name: Column, version: Column, expected: str, newest: int = 1
) -> Column:
    """The manifest's format is the expected one and its version, 0 when absent, not too new."""
    return F.coalesce(
        (format_name == expected) & (F.coalesce(version.try_cast("int"), F.lit(0)) <= newest),
        F.lit(False),
    )
