"""Loading of raw delimited records: rows that parse, and rows apart with the reason why they do not.

Cells are cut by a regular expression built from each file's delimiter; a record whose cells do not cover it whole is
misquoted. Cells are exploded into (row, column, value) and joined with a rule table of (file, column, type); the
violations are aggregated per row, and the clean rows are what an anti-join with the faulty ones leaves.

Defined results: a null record is one with no cells, which is of wrong width; an empty record is one empty cell; a row
of an unknown or null file is rejected as `width`; a row is told by its id, file, number and text together, so rows that
share an id or have none are judged apart; rows equal in all four are one fault, and stay as many as they are when they
load; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.runtime import cut

BLANKS = " \t\r\n\f\u000b ﻿"
#: A record with more quote characters than this is cut in Python, with the same cells: the regular expression recurses once per "" pair.
MANY_QUOTES = 2000

# What a cell of each type looks like.
RULES = {
    "integer": r"^-?(0|[1-9][0-9]*)$",
    "numeric": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$|^-?\.[0-9]+$",
    "boolean": r"^(?i:true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$",
}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_slowly(record: pd.Series, delimiter: pd.Series) -> pd.Series:
    """Raw cells of a record, quotes included; null where a quoted cell is not closed or goes on after its quote."""

    def cut(s: str | None, d: str | None) -> list[str] | None:
        if s is None or not d:
            return None
        out, i = [], 0
        while True:
            if s[i : i + 1] == '"':
                j = i + 1
                while True:
                    j = s.find('"', j)
                    if j < 0:
                        return None
                    if s[j + 1 : j + 2] != '"':
                        break
                    j += 2
                j += 1
                if j < len(s) and not s.startswith(d, j):
                    return None
            else:
                j = s.find(d, i)
                j = len(s) if j < 0 else j
            out.append(s[i:j])
            if j >= len(s):
                return out
            i = j + len(d)

    return pd.Series([cut(s, d) for s, d in zip(record, delimiter)])


def _raw_cells(record: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    pattern = F.concat(F.lit('("[^"]*+(?:""[^"]*+)*+"|(?!")[^'), quoted, F.lit("]*+)"), quoted)
    plain = F.call_function("split", record, quoted, F.lit(-1))
    found = F.call_function("regexp_extract_all", F.concat(record, delimiter), pattern, F.lit(1))
    whole = F.aggregate(found, F.lit(0), lambda n, c: n + F.length(c) + 1) == F.length(record) + 1
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    many = quotes > MANY_QUOTES
    slow = _cut_slowly(F.when(many, record), F.when(many, delimiter))
    return F.when(many, slow).when(quotes > 0, F.when(whole, found)).otherwise(plain)


def _value(cell: Column) -> Column:
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    text = F.btrim(F.when(cell.startswith('"'), inner).otherwise(cell), F.lit(BLANKS))
    return F.when(text != "", text)


def _fits(value: Column, kind: Column) -> Column:
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull() & (F.substring(value, 1, 4) >= "0100")
    ok = F.when(kind == "integer", value.rlike(RULES["integer"]) & (F.length(value) <= 11) & (F.abs(F.expr("try_cast(value as bigint)")) <= 2147483647))
    for name in ("numeric", "boolean"):
        ok = ok.when(kind == name, value.rlike(RULES[name]))
    for name in ("date", "timestamp"):
        ok = ok.when(kind == name, value.rlike(RULES[name]) & day)
    return F.coalesce(ok.otherwise(F.lit(True)), F.lit(False))


def parse_records(rows: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, table_id, row_no, mark (of the text), width, cells: cells are raw and null where the quoting is broken.

    `files` describes the tables, one row each; it is joined as Spark plans it, so its size does not matter.
    """
    f = files.select(F.col("table_id").alias("__t"), F.col("delimiter").alias("__d"), F.size("columns").alias("width")).dropDuplicates(["__t"])
    joined = rows.select("row_id", "table_id", "row_no", F.col("row_text").alias("__r")).join(f, F.col("table_id") == F.col("__t"), "left")
    return joined.select("row_id", "table_id", "row_no", F.md5("__r").alias("mark"), "width", F.col("__r").isNull().alias("no_text"), _raw_cells(F.col("__r"), F.col("__d")).alias("cells"))


ROW = ["row_id", "table_id", "row_no", "mark"]


def row_faults(rows: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, table_id, row_no, mark, reason, bad_cells: rows that do not load, with the positions of the cells that do not fit."""
    return _faults(parse_records(rows, files), files)


def _faults(parsed: DataFrame, files: DataFrame) -> DataFrame:
    kinds = files.select(F.col("table_id").alias("__t"), F.posexplode("column_types").alias("column_no", "kind")).dropDuplicates(["__t", "column_no"])
    first = F.when(F.col("width").isNull() | F.col("no_text"), "width").when(F.col("cells").isNull(), "quoting").when(F.size("cells") != F.col("width"), "width")
    judged = parsed.withColumn("__first", first)
    # outer: a row judged by its shape keeps one line without cells, so that one scan serves all reasons
    exploded = judged.select(*ROW, "__first", F.posexplode_outer(F.when(F.col("__first").isNull(), F.col("cells"))).alias("column_no", "__c"))
    cells = exploded.select(*ROW, "__first", "column_no", _value(F.col("__c")).alias("value"))
    ruled = cells.join(kinds, (F.col("table_id") == F.col("__t")) & (cells["column_no"] == kinds["column_no"]), "left").select(
        *ROW, "__first", cells["column_no"], (F.col("value").isNotNull() & ~_fits(F.col("value"), F.col("kind"))).alias("bad")
    )
    faulty = ruled.where(F.col("bad") | F.col("__first").isNotNull())
    return faulty.groupBy(*ROW).agg(F.coalesce(F.min("__first"), F.lit("value")).alias("reason"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("column_no")))).alias("bad_cells"))


def clean_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, table_id, row_no, values: the rows that load, their cells trimmed, unquoted, and null where empty."""
    parsed = cut(parse_records(rows, files), "p4-cells")  # parsed once, read for the judgement and for the result
    values = F.transform(F.col("cells"), _value)
    bad = _faults(parsed, files).select(*[F.col(c).alias(f"__{c}") for c in ROW])
    same = F.lit(True)
    for c in ROW:  # null ids and numbers are values like others
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    whole = parsed.where(F.col("cells").isNotNull() & (F.size("cells") == F.col("width")))
    return whole.join(bad, same, "left_anti").select("row_id", "table_id", "row_no", values.alias("values"))
