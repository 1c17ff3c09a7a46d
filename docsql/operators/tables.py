"""Tables of text cells: header names, type inference over all rows, import, reading back as text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions.detectors import SENSITIVE
from docsql.functions.structured import valid_date
from docsql.functions.text import identifier, quoted_identifier, quoted_literal
from docsql.sources.delimited import RULES

ZONED = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$"
SPARK_TYPES = {"integer": "int", "bigint": "bigint", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "text": "string"}


def header_names(header: list[str | None]) -> list[str]:
    """Trimmed names; blank ones are numbered by place, repeated ones (in any case) by count."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, h in enumerate(header):
        name = (h or "").strip() or f"column_{i + 1}"
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name} {n}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def clean_headers(headers: pd.Series) -> pd.Series:
    """Header rows as header names."""
    return pd.Series([None if h is None else header_names(list(h)) for h in headers])


def column_identifiers(names: list[str]) -> list[str]:
    out: list[str] = []
    for i, n in enumerate(names):
        base, name, k = identifier(n, f"column_{i + 1}"), None, 1
        while (name := base if k == 1 else f"{base[:60]}_{k}") in out:
            k += 1
        out.append(name)
    return out


def _tests(v: Column) -> dict[str, Column]:
    whole = v.rlike(RULES["integer"])
    n = v.try_cast("decimal(38,0)")
    return {
        "integer": whole & (F.abs(n) <= 2147483647),
        "bigint": whole & n.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")),
        "numeric": v.rlike(RULES["numeric"]),
        "boolean": v.rlike(RULES["boolean"]),
        "date": v.rlike(RULES["date"]) & valid_date(v),
        "timestamp": v.rlike(RULES["timestamp"]) & valid_date(v),
        "timestamptz": v.rlike(ZONED) & valid_date(v),
    }


def narrowest(v: Column) -> Column:
    """Aggregate: the narrowest type that every non-empty value fits; text where there is none."""
    present = F.when(v != "", v)
    out = F.lit("text")
    for name, ok in reversed(_tests(present).items()):
        out = F.when(F.bool_and(F.when(present.isNotNull(), F.coalesce(ok, F.lit(False)))), name).otherwise(out)
    return out


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of each text column, from all rows in one pass."""
    row = df.agg(*[narrowest(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[i] for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to their types, under SQL names. Numbers keep their scale up to 38 digits; wider ones become double."""
    types = types or infer_types(df)
    numeric = [c for c in df.columns if types[c] == "numeric"]
    shape = {}
    if numeric:
        value = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^-", "")
        row = df.agg(*[F.max(F.length(F.regexp_extract(value(c), r"\.(\d+)", 1))).alias(f"s{i}") for i, c in enumerate(numeric)], *[F.max(F.length(F.regexp_extract(value(c), r"^(\d*)", 1))).alias(f"w{i}") for i, c in enumerate(numeric)], *[F.bool_or(value(c).rlike("[eE]")).alias(f"e{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            scale, whole, exponent = row[i] or 0, row[len(numeric) + i] or 1, row[2 * len(numeric) + i]
            shape[c] = "double" if exponent or scale + whole > 38 else f"decimal({max(1, scale + whole)},{scale})"
    cols = []
    for c, name in zip(df.columns, column_identifiers(df.columns)):
        v = F.nullif(F.col(f"`{c}`"), F.lit(""))
        cols.append(v.try_cast(shape.get(c) or SPARK_TYPES[types[c]]).alias(name))
    return df.select(*cols)


def import_table(df: DataFrame, name: str, if_exists: str = "error", comment: str | None = None, path: str | None = None, types: dict[str, str] | None = None) -> int:
    """Writes text columns as a typed table with comments; gives the number of rows. if_exists: error, replace or append.

    path: where the table's files lie, else in the warehouse. types: those of an earlier import, for rows that are appended.
    """
    spark = df.sparkSession
    out = typed(df, types)
    mode = {"error": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    if if_exists == "append":
        held = dict(spark.table(name).dtypes)
        out = out.select(*[F.col(c).try_cast(held[c]).alias(c) for c in held])
    rows = Observation()
    writer = out.observe(rows, F.count("*").alias("n")).write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    if comment:
        spark.sql(f"COMMENT ON TABLE {quoted_identifier(name)} IS {quoted_literal(comment)}")
    for original, column in zip(df.columns, out.columns):
        if original != column and if_exists != "append":
            spark.sql(f"ALTER TABLE {quoted_identifier(name)} ALTER COLUMN {quoted_identifier(column)} COMMENT {quoted_literal(original)}")
    return spark.table(name).count() if if_exists == "append" else rows.get["n"]


@dataclass(frozen=True)
class Keys:
    """What Spark's tables cannot say of themselves: primary key, references (column to table and column), defaults, not null."""

    primary: str | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()


def _shown(v: str) -> str:
    return "'" + (v if len(v) <= 40 else v[:40] + "…") + "'"


def sampled_values(df: DataFrame, columns: list[str], key: str | None, referenced: bool, most: int = 12) -> dict[str, str]:
    """The values of columns that hold few, as text.

    A small table that others refer to tells each value with its key. Elsewhere a column counts as categorical when it has at
    most `most` values and each stands twice on average, among at most 4 * most rows that are looked at.
    """
    out: dict[str, str] = {}
    if referenced and key:
        rows = df.select(key, *columns).orderBy(key).limit(most + 1).collect()
        for c in columns:
            held = [r for r in rows if r[c] is not None]
            if held and len(rows) <= most:
                text = ", ".join(f"{_shown(str(r[c]))} ({key} {r[key]})" for r in held)
                out[c] = text[:400] + ("…" if len(text) > 400 else "")
    left = [c for c in columns if c not in out]
    if not left:
        return out
    stat = df.agg(*[F.approx_count_distinct(c).alias(c) for c in left]).first()  # one pass; a column of many values is not gathered
    for c in (c for c in left if stat[c] <= 2 * most):
        held = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v"))
        values = [r[0] for r in held.distinct().orderBy("v").limit(most + 1).collect()]
        if values and len(values) <= most and (referenced or held.limit(4 * most).count() >= 2 * len(values)):
            text = ", ".join(map(_shown, values))
            out[c] = text[:300] + ("…" if len(text) > 300 else "")
    return out


def describe(spark: SparkSession, name: str, most: int = 12, keys: dict[str, Keys] | None = None) -> str:
    """A table as DDL-like text: its comment, columns with types, defaults and comments, the values of columns that hold few, keys and checks."""
    keys = keys or {}
    own = keys.get(name, Keys())
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    end = next((i for i, r in enumerate(described) if not r[0] or r[0].startswith("#")), len(described))
    rows = described[:end]
    note = next((r[1] for r in described[end:] if r[0] == "Comment"), None)
    referenced = any(t == name for k in keys.values() for t, _ in k.references.values())
    texts = [r[0] for r in rows if r[1] == "string" and not SENSITIVE.search(r[0])]
    kept = sampled_values(spark.table(name), texts, own.primary, referenced, most) if most else {}
    line = lambda t: re.sub(r"\s+", " ", t).strip()
    lines: list[tuple[str, str]] = []
    for column, kind, comment in rows:
        told = [line(comment)] if comment else []
        if column in kept:
            told.append(f"values: {kept[column]}")
        parts = [column, kind, *(["not null"] if column in own.required else []), *([f"default {own.defaults[column]}"] if column in own.defaults else [])]
        lines.append((" ".join(parts), "; ".join(told)))
    lines += [(f"primary key ({own.primary})", "")] if own.primary else []
    lines += [(f"foreign key ({c}) references {t}({k})", "") for c, (t, k) in own.references.items()]
    lines += [(f"check ({c})", "") for c in own.checks]
    body = [f"  {text}{',' if i < len(lines) - 1 else ''}{f' -- {told}' if told else ''}" for i, (text, told) in enumerate(lines)]
    return f"table {name} ({f' -- {line(note)}' if note else ''}\n" + "\n".join(body) + "\n)"
