"""Rows that fail to parse (problem 3).

Each record is read permissively under the explicit typed schema, which keeps the raw text of the
records the reader finds corrupt.  All records are then classified again in the order quoting,
column count, cell casts, because the permissive reader both repairs text that is broken and accepts
cells that are not valid.  Everything is a narrow projection inside the JVM: no shuffle, no Python.

Defined results
---------------
* a null record fails with ``columns``; an empty record has one cell and fails with ``columns``;
* one line end (CR, LF or both) at the end of a record does not belong to its last cell;
* a record may hold line breaks inside and outside of quotes;
* repeated records are classified one by one; very long cells are handled without backtracking;
* columns of the input with any other names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.binding import bind

ETL_COLUMNS = ("id", "full_name", "email", "phone", "ssn", "age", "amount", "plan", "signup_date", "internal_notes")
ETL_SCHEMA = "id BIGINT, full_name STRING, email STRING, phone STRING, ssn STRING, age BIGINT, amount DOUBLE, plan STRING, signup_date DATE, internal_notes STRING, _corrupt STRING"
ESC, LITERAL, CUT = "\u0001", "\u0002", "\u0003"


def is_int(cell: Column) -> Column:
    """An optional sign and ASCII digits only, within 64 bits; null counts as no."""
    return F.coalesce(cell.rlike(r"\A[+-]?[0-9]+\z") & cell.try_cast("bigint").isNotNull(), F.lit(False))


def is_decimal(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"\A[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"), F.lit(False))


def is_date(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & cell.try_cast("date").isNotNull(), F.lit(False))


def record_text(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?:\r\n|\n|\r)\z", "")


def quoting_ok(pieces: Column) -> Column:
    """``pieces`` is the record split at every double quote: the odd pieces are inside quotes.

    A piece outside must be empty (a doubled quote, or the record's edge) or be parted by commas
    from the quotes beside it.
    """
    last = F.size(pieces) - 1
    outside = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, (x == "") | (((i == 0) | x.startswith(",")) & ((i == last) | x.endswith(",")))).otherwise(F.lit(True)))
    return (F.size(pieces) % 2 == 1) & F.forall(outside, lambda ok: ok)


def cells_of(pieces: Column) -> Column:
    """The unquoted cells of a record whose quoting is right."""
    last = F.size(pieces) - 1
    joined = F.array_join(
        F.transform(pieces, lambda x, i: F.when((i % 2 == 0) & (x == "") & (i > 0) & (i < last), F.lit('"')).when(i % 2 == 0, F.replace(F.replace(x, F.lit(ESC), F.lit(ESC + LITERAL)), F.lit(","), F.lit(ESC + CUT))).otherwise(F.replace(x, F.lit(ESC), F.lit(ESC + LITERAL)))), ""
    )
    return F.transform(F.split(joined, ESC + CUT, -1), lambda c: F.replace(c, F.lit(ESC + LITERAL), F.lit(ESC)))


_STRICT = {"int": r"[+-]?[0-9]{1,18}", "decimal": r"[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}


def plain_pattern(columns: tuple[str, ...], checks: tuple[tuple[str, str], ...]) -> str:
    """A record without quotes and line breaks whose checked cells have the strict form."""
    kinds = dict(checks)
    return r"\A" + ",".join(_STRICT.get(kinds.get(c, ""), r'[^",\r\n]*+') for c in columns) + r"\z"


def classify(df: DataFrame, raw: str, *, columns: tuple[str, ...] = ETL_COLUMNS, schema: str = ETL_SCHEMA, checks: tuple[tuple[str, str], ...] = (("id", "int"), ("age", "int"), ("amount", "decimal"), ("signup_date", "date"))) -> DataFrame:
    """Adds ``#reason`` (null: the record loads), ``#cells`` (array of unquoted cells, null if the quoting is broken) and ``#row`` (the typed row of the permissive reader with ``_corrupt``).

    ``checks`` are (column, kind) in the order in which failures are reported.  A record that the
    permissive reader finds sound and that is plain text in strict form loads; every other one, its
    raw text retained, is classified by quoting, count and casts.
    """
    df = bind(df, "#row", F.from_csv(F.col(f"`{raw}`"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "dateFormat": "yyyy-MM-dd"}))
    df = bind(df, "#text", record_text(F.col(f"`{raw}`")))
    row, text = F.col("`#row`"), F.col("`#text`")
    sound = row["_corrupt"].isNull() & text.rlike(plain_pattern(columns, checks))
    df = bind(df, "#pieces", F.split(text, '"', -1))
    pieces = F.col("`#pieces`")
    df = bind(df, "#cells", F.when(F.size(pieces) == 1, F.split(pieces[0], ",", -1)).when(quoting_ok(pieces), cells_of(pieces)))
    cells = F.col("`#cells`")
    test = {"int": is_int, "decimal": is_decimal, "date": is_date}
    reason = F.when(sound, F.lit(None).cast("string")).when(F.col(f"`{raw}`").isNull(), "columns").when(cells.isNull(), "quote").when(F.size(cells) != len(columns), "columns")
    for name, kind in checks:
        reason = reason.when(~test[kind](cells[columns.index(name)]), name)
    return df.withColumn("#reason", reason).drop("#pieces", "#text")


def split_records(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(rows that load with typed columns, rows that do not with ``reason``); the input's columns are kept in front."""
    keep = df.columns
    done = classify(df, raw)
    kinds = {"id": "bigint", "age": "bigint", "amount": "double", "signup_date": "date"}
    typed = [F.col("`#cells`")[i].try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(ETL_COLUMNS)]
    good = done.where("`#reason` is null").select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in keep), *typed)
    bad = done.where("`#reason` is not null").select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in keep), F.col("`#reason`").alias("reason"))
    return good, bad


def found(lines: DataFrame, showcase: DataFrame) -> DataFrame:
    """p3_found: one row per record that does not load, with its first failure."""
    a = classify(lines.select("line_id", "raw_line"), "raw_line").where("`#reason` is not null").select(F.lit("etl_lines").alias("tbl"), F.col("line_id").alias("row_key"), F.col("`#reason`").alias("reason"))
    b = showcase.where(~is_int(F.col("age"))).select(F.lit("showcase").alias("tbl"), F.col("rec_id").alias("row_key"), F.lit("age").alias("reason"))
    return a.unionByName(b)
