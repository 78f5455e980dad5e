"""Tables as SQL text: writing INSERT statements and reading them back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.columns import named, quoted_name, sql_literal
from stowage.sources.statements import read_statements

# Bounds of an INSERT statement in bytes.
MIN_INSERT_BYTES = 65_536
MAX_INSERT_BYTES = 1_048_576


def insert_cap(packet: int = 0) -> int:
    """Statement cap for a server that takes ``packet`` bytes at once; 0 when unknown."""
    if packet <= 0:
        return MAX_INSERT_BYTES
    return max(MIN_INSERT_BYTES, min(MAX_INSERT_BYTES, int(packet * 0.9)))


_NEEDS_NO_ESCAPE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def literal(field: T.StructField) -> Column:
    """A value as SQL text: bytes as ``X'..'``, all else quoted. Nested values have no literal."""
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} has no SQL literal; make it text first")
    if isinstance(field.dataType, T.BinaryType):
        return F.coalesce(F.concat(F.lit("X'"), F.hex(named(field.name)), F.lit("'")), F.lit("NULL"))
    return sql_literal(named(field.name), not isinstance(field.dataType, _NEEDS_NO_ESCAPE))


def tuple_text(schema: T.StructType) -> Column:
    """One row as ``('..','..',NULL)``."""
    values = [literal(f) for f in schema]
    return F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))


# Statements handed on at once, in bytes, so that a task never holds many of them.
OUT_BYTES = 4 << 20


def _statements(part: int, first: int, closed: list[bytes]) -> pa.RecordBatch:
    numbers = pa.array(range(first, first + len(closed)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([part] * len(closed), pa.int32()), numbers, pa.array(closed, pa.binary())], ["part", "stmt_no", "sql"])


def _pack(head: bytes, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        open_rows: list[bytes] = []
        size = len(head) - 1  # of the open statement; a comma comes before all rows but the first
        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(batch.column(1).to_numpy().astype(np.int64) + 1)
            closed: list[bytes] = []
            start = used = held = 0
            while True:
                stop = max(start, int(np.searchsorted(ends, used + cap - size))) + 1
                if stop > len(texts):
                    break
                closed.append(head + b",".join([*open_rows, *texts.slice(start, stop - start).to_pylist()]) + b";")
                open_rows, size = [], len(head) - 1
                start, used = stop, int(ends[stop - 1])
                held += len(closed[-1])
                if held > OUT_BYTES:
                    yield _statements(part, done, closed)
                    done, closed, held = done + len(closed), [], 0
            open_rows.extend(texts.slice(start).to_pylist())
            size += int(ends[-1]) - used if len(ends) else 0
            if closed:
                yield _statements(part, done, closed)
                done += len(closed)
        if open_rows:
            yield _statements(part, done, [head + b",".join(open_rows) + b";"])

    return run


def to_sql_inserts(df: DataFrame, table: str, max_bytes: int = MAX_INSERT_BYTES) -> DataFrame:
    """Rows as INSERT statements ``(part, stmt_no, sql)``.

    A statement ends once it has reached ``max_bytes``, so it exceeds them by less than one row.
    Rows are rendered in the JVM; each partition packs its own as they stream by.
    """
    head = f"INSERT INTO {quoted_name(table)} ("
    head += ",".join(quoted_name(c) for c in df.columns) + ") VALUES "
    rows = df.select(tuple_text(df.schema).cast("binary").alias("row_text"))
    rows = rows.select("row_text", F.octet_length("row_text").alias("row_bytes"))
    packed = rows.mapInArrow(_pack(head.encode(), max_bytes), "part int, stmt_no long, sql binary")
    return packed.withColumn("sql", F.col("sql").cast("string"))


def write_sql_dump(
    df: DataFrame, table: str, dest: str, max_bytes: int | None = None, gzipped: bool = False, packet: int = 0
) -> None:
    """INSERT statements as text files, one statement per line (line breaks in values are escaped).

    Without ``max_bytes``, statements are as large as a server that takes ``packet`` bytes at once allows. Spark's committer moves files
    into place when all tasks have ended, so a task or a job that fails leaves none.
    """
    writer = to_sql_inserts(df, table, insert_cap(packet) if max_bytes is None else max_bytes).select("sql").write
    writer.option("compression", "gzip" if gzipped else "none").text(dest)


# ---------------------------------------------------------------- reading


_QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
_NAME = r"(?:`(?:[^`]|``)++`|\"(?:[^\"]|\"\")++\"|[\w$\x{80}-\x{10FFFF}]++)"
# Blanks and comments before a statement's first word.
_LEAD = r"(?s)^(?:\s++|--[ \t][^\n]*+|--(?=\n|$)|#[^\n]*+|/\*(?!!)(?:[^*]++|\*(?!/))*+\*/)*+"
# The heads of statements that bring rows.
_VERB = r"(?i)^(?:INSERT(?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY))?(?:\s+IGNORE)?|REPLACE(?:\s+(?:LOW_PRIORITY|DELAYED))?)(?:\s+INTO)?(?![\w$])\s*"
_BRINGS_ROWS = r"(?i)^(?:INSERT|REPLACE)(?![\w$])"
# First words of statements, and of comments that hold some.
_FIRST_WORDS = (
    "ALTER", "ANALYZE", "BEGIN", "CALL", "CHANGE", "CHECK", "CHECKSUM", "COMMIT", "CREATE", "DEALLOCATE", "DELETE", "DELIMITER", "DO", "DROP", "END",
    "EXECUTE", "FLUSH", "GRANT", "INSERT", "KILL", "LOAD", "LOCK", "OPTIMIZE", "PREPARE", "PURGE", "RENAME", "REPAIR", "REPLACE", "RESET", "REVOKE",
    "ROLLBACK", "SAVEPOINT", "SELECT", "SET", "SHOW", "START", "STOP", "TRUNCATE", "UNLOCK", "UPDATE", "USE", "VALUES", "WITH", "XA",
)
_STATEMENT = rf"(?i)^(?:$|\(|/\*!|(?:{'|'.join(_FIRST_WORDS)})(?![\w$]))"
_TARGET = rf"(?i)^(?:{_NAME}\s*\.\s*)?({_NAME})"
_COLUMNS = rf"(?i)^\s*+(\(\s*{_NAME}(?:\s*,\s*{_NAME})*\s*\))?\s*+VALUES?\s*+(?=\()"
# Tuples that follow each other; in a cell, letters before a quoted text say what it holds.
_TUPLE = rf"(?s)\G[\s,]*+\((?:[^'\"()]++|{_QUOTED})*+\)"
_CELL = rf"(?s)(?:[xX]|_\w+\s*+|[nN])?+{_QUOTED}|[^\s,()']++(?:\s++[^\s,()']++)*+"
# A line that opens and closes its own quotes and has no ";" but at its end.
_OWN_LINE = r"(?s)^(?:[^';]++|'(?:[^'\\]++|\\.)*+')*+;?[ \t\r]*$"


def _unescaped(text: Column) -> Column:
    r"""The value behind a literal's text.

    Escaped backslashes are parked as NUL, which a literal never holds raw, until no escape but that
    of NUL is left. They then take the free code ``\B`` for as long as NUL needs to come back.
    """
    full = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    full = F.replace(full, F.lit("\\'"), F.lit("''"))
    full = F.replace(full, F.lit("''"), F.lit("'"))
    for code, char in [("n", "\n"), ("r", "\r"), ("Z", "\x1a"), ("t", "\t"), ("b", "\b")]:
        full = F.replace(full, F.lit("\\" + code), F.lit(char))
    full = F.regexp_replace(full, r"(?s)\\([^0])", "$1")
    for code, char in [("\0", "\\B"), ("\\0", "\0"), ("\\B", "\\")]:
        full = F.replace(full, F.lit(code), F.lit(char))
    return full


def _plain_name(name: Column) -> Column:
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return (
        F.when(F.startswith(name, F.lit("`")), F.replace(inner, F.lit("``"), F.lit("`")))
        .when(F.startswith(name, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"')))
        .otherwise(name)
    )


def _unless(fine: Column, fault: str, sql: Column, value: Column) -> Column:
    """``value``, or an error that quotes the beginning of the statement."""
    text = F.concat(F.lit(f"{fault}: "), F.substring(sql, 1, 120))
    return F.when(fine, value).otherwise(F.raise_error(text))


def decode_inserts(statements: DataFrame, table: str, schema: T.StructType | str) -> DataFrame:
    """Rows of one table from the ``sql`` of INSERT and REPLACE statements, cast to ``schema``.

    Heads may have any case, modifiers, a database name, quoted or bare names, and comments before them. Columns are matched by name, or by place where a
    statement lists none. Other statements are passed over, but text that is none is an error, as rows may be lost in it. So is a statement that brings
    rows but cannot be read as a list of tuples, for this table or for one that cannot be told, and a tuple with another number of values than
    there are columns.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    sql, rest, head = F.col("sql"), F.col("rest"), F.col("head")
    # Steps of their own: what is found once per statement must not be repeated for each of its rows.
    # Filters may be evaluated in any order, so the errors in them do not rely on each other.
    brings_rows = sql.rlike(_BRINGS_ROWS)
    strange = F.raise_error(F.concat(F.lit("not a statement: "), F.substring(sql, 1, 120))).cast("boolean")
    bare = statements.select(F.regexp_replace("sql", _LEAD, "").alias("sql"))
    bare = bare.filter(F.when(sql.rlike(_STATEMENT), brings_rows).otherwise(strange))
    begun = bare.select("sql", F.length(F.regexp_extract("sql", _VERB, 0)).alias("verb"))
    rest_ = _unless((F.col("verb") > 0) | ~brings_rows, "no table is named", sql, F.substring(sql, F.col("verb") + 1, F.length(sql)))
    named_ = begun.select("sql", rest_.alias("rest"))
    named_ = named_.select("sql", "rest", F.regexp_extract("rest", _TARGET, 0).alias("head"), F.regexp_extract("rest", _TARGET, 1).alias("name"))
    target = _unless((head != "") | ~brings_rows, "no table is named", sql, _plain_name(F.col("name")))
    mine = named_.filter(target == table).select("sql", F.substring(rest, F.length(head) + 1, F.length(rest)).alias("rest"))
    parts = mine.select("sql", "rest", F.regexp_extract("rest", _COLUMNS, 0).alias("head"), F.regexp_extract("rest", _COLUMNS, 1).alias("listed"))
    names = F.transform(F.regexp_extract_all("listed", F.lit(f"({_NAME})"), 1), _plain_name)
    body = F.rtrim(F.substring(rest, F.length(head) + 1, F.length(rest)), F.lit("; \t\r\n"))
    split = parts.select("sql", names.alias("names"), (head != "").alias("headed"), body.alias("body"))
    split = split.select("sql", "names", "headed", F.length("body").alias("length"), F.regexp_extract_all("body", F.lit(_TUPLE), 0).alias("tuples"))
    read = F.aggregate("tuples", F.lit(0), lambda n, t: n + F.length(t))
    fault = F.when(~F.col("headed") | (read != F.col("length")), F.concat(F.lit(f"no list of tuples for {table}: "), F.substring("sql", 1, 120)))
    places = [
        F.when(F.size("names") == 0, F.lit(place)).otherwise(
            F.array_position(F.transform("names", F.lower), field.name.lower()).cast("int")
        )
        for place, field in enumerate(schema, start=1)
    ]
    placed = split.select(F.array(*places).alias("places"), F.size("names").alias("width"), "tuples", fault.alias("fault"))
    # A statement with a fault is one row, whose values are the error.
    tuples = F.when(F.col("fault").isNull(), F.col("tuples")).otherwise(F.array(F.lit("")))
    rows = placed.select("places", "width", "fault", F.explode(tuples).alias("row_text"))
    cut = rows.select("places", "width", "fault", "row_text", F.regexp_extract_all("row_text", F.lit(_CELL), 0).alias("cells"))
    fits = F.when(F.col("width") == 0, F.size("cells") >= len(schema)).otherwise(F.size("cells") == F.col("width"))
    other = F.concat(F.lit("a tuple has another number of values: "), F.substring("row_text", 1, 120))
    cells = F.when(F.col("fault").isNull() & fits, F.col("cells")).otherwise(F.raise_error(F.coalesce("fault", other)))
    checked = cut.select("places", cells.alias("cells"))
    raw = checked.select(*[_cell(i).alias(f"_{i}") for i in range(len(schema))])
    return raw.select(*[_value(F.col(f"_{i}"), f) for i, f in enumerate(schema)])


def _cell(number: int) -> Column:
    place = F.col("places")[number]
    return F.when(place > 0, F.try_element_at("cells", place))


def _text(raw: Column) -> Column:
    """What a quoted literal says."""
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    escaped = F.contains(raw, F.lit("\\")) | F.contains(raw, F.lit("''"))
    # In a lambda, the long chain is no part of the generated method, which must stay small.
    return F.when(escaped, F.transform(F.array(inner), _unescaped)[0]).otherwise(inner)


def _unquoted(raw: Column) -> Column:
    """The value, as bytes, of a literal that does not open with a quote: hexadecimal, marked, or bare."""
    digits = F.when(raw.rlike("^0x[0-9A-Fa-f]++$"), F.substring(raw, F.lit(3), F.length(raw)))
    digits = digits.when(raw.rlike("^[xX]'[0-9A-Fa-f]*+'$"), F.substring(raw, F.lit(3), F.length(raw) - 3))
    marked = F.regexp_extract(raw, r"(?s)^(?:_\w+\s*|[nN])('.*)$", 1)
    return F.coalesce(F.unhex(digits), F.when(marked != "", _text(marked)).otherwise(raw).cast("binary"))


def _value(raw: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, _NEEDS_NO_ESCAPE):
        value = F.btrim(raw, F.lit("'"))
    else:
        other = F.transform(F.array(raw), _unquoted)[0]
        kind = "binary" if isinstance(field.dataType, T.BinaryType) else "string"
        value = F.when(F.startswith(raw, F.lit("'")), _text(raw).cast(kind)).otherwise(other.cast(kind))
    return F.when(F.upper(raw) != "NULL", value).cast(field.dataType).alias(field.name)


def read_sql_dumps(
    spark: SparkSession,
    pattern: str,
    table: str,
    schema: T.StructType | str,
    layout: str = "lines",
) -> DataFrame:
    """Rows of one table from SQL dump files.

    ``lines`` expects each statement on its own line, as the sink above writes them, and reads the files once. A line that does not hold to this
    fails the read. ``stream`` takes any layout and reads them twice. Both read one huge file with many tasks.
    """
    if layout == "stream":
        return decode_inserts(read_statements(spark, pattern), table, schema)
    lines = spark.read.option("lineSep", "\n").text(pattern).withColumnRenamed("value", "sql")
    brings_rows = F.ltrim("sql").rlike(_BRINGS_ROWS)
    complete = F.col("sql").rlike(_OWN_LINE) & (~brings_rows | F.rtrim("sql").endswith(";"))
    fault = F.raise_error(F.lit("statements and lines do not coincide; use layout='stream'"))
    return decode_inserts(lines.filter(F.when(complete, True).otherwise(fault.cast("boolean"))), table, schema)
