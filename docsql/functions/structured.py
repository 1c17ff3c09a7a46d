"""JSON and calendar functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contains_json(whole: object, part: object) -> bool:
    """Containment as of jsonb @>: objects by keys, arrays by elements, scalars by type and value."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains_json(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains_json(w, p) for w in whole) for p in part)
    if isinstance(whole, list) and not isinstance(part, (dict, list)):
        return False
    return type(whole) is type(part) and whole == part or (isinstance(whole, (int, float)) and isinstance(part, (int, float)) and not isinstance(whole, bool) and not isinstance(part, bool) and whole == part)


def _load(s: str | None) -> object:
    try:
        return json.loads(s) if s is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def _contains(whole: pd.Series, part: pd.Series) -> pd.Series:
    parts = {p: json.loads(p) for p in part.unique()}
    return pd.Series([w is not None and contains_json(_load(w), parts[p]) for w, p in zip(whole, part)])


def json_contains(whole: Column, part: dict) -> Column:
    """whole @> part. Texts and arrays of texts are compared as variants in the JVM, which keep their types; deeper filters go through Python."""
    simple = lambda k, v: "'" not in k and "." not in k and (isinstance(v, str) or isinstance(v, list) and all(isinstance(x, str) for x in v))
    if not all(simple(k, v) for k, v in part.items()):
        return F.coalesce(_contains(whole, F.lit(json.dumps(part, sort_keys=True))), F.lit(False))
    parsed = F.try_parse_json(whole)
    ok = F.substring(F.schema_of_variant(parsed), 1, 6) == "OBJECT"
    for k, v in part.items():
        at = F.try_variant_get(parsed, f"$['{k}']", "variant")
        if isinstance(v, str):
            ok = ok & (F.schema_of_variant(at) == "STRING") & (F.try_variant_get(at, "$", "string") == v)
        else:
            held = F.filter(F.try_variant_get(at, "$", "array<variant>"), lambda e: F.schema_of_variant(e) == "STRING")
            ok = ok & held.isNotNull() & F.forall(F.array(*map(F.lit, v)).cast("array<string>"), lambda w: F.exists(held, lambda e: F.try_variant_get(e, "$", "string") == w))
    return F.coalesce(ok, F.lit(False))


def flat_records(value: object) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(r, dict) and not any(isinstance(v, (dict, list)) for v in r.values()) for r in value)


def json_text(value: object, indent: str = "") -> str:
    """A JSON value as indented text, one field or element a line."""
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}:\n{json_text(v, indent + '  ')}" if isinstance(v, (dict, list)) and v else f"{indent}{k}: {_scalar(v)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{indent}-\n{json_text(v, indent + '  ')}" if isinstance(v, (dict, list)) and v else f"{indent}- {_scalar(v)}" for v in value)
    return f"{indent}{_scalar(value)}"


def _scalar(v: object) -> str:
    return "" if v is None or v in ([], {}) else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _as_text(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else json_text(_load(v)) for v in value])


@F.pandas_udf(T.BooleanType())
def _is_flat(value: pd.Series) -> pd.Series:
    return pd.Series([flat_records(_load(v)) for v in value])


def as_text(value: Column) -> Column:
    """A JSON text as indented text; what is no JSON is empty."""
    return _as_text(value)


def is_flat(value: Column) -> Column:
    """A JSON text is a list of objects without nested values, which makes a table."""
    return _is_flat(value)


def merge_json(a: Column, b: Column) -> Column:
    """Shallow merge of two JSON objects; the second wins. Values keep their types; what is no object counts as empty.

    Equal keys within one object: the last counts. The order of keys means nothing.
    """
    obj = "map<string,variant>"
    x, y = (F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", obj), F.create_map().cast(obj)) for c in (a, b))
    kept = F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k))
    return F.to_json(F.map_concat(kept, y))


def iso_stamp(at: Column) -> Column:
    """A time as ISO text in UTC, to the millisecond."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def date_context(today: Column) -> Column:
    """Today, tomorrow, the rest of the week to Sunday and the next week, with names of days."""
    day = lambda d: F.date_format(d, "EEEE yyyy-MM-dd")
    left = F.pmod(F.lit(8) - F.dayofweek(today), F.lit(7))
    run = lambda a, b: F.array_join(F.transform(F.sequence(a, b), day), ", ")
    rest = F.when(left > 0, F.concat(F.lit("\nRest of this week: "), run(F.date_add(today, 1), F.date_add(today, F.greatest(left, F.lit(1)))), F.lit("."))).otherwise("")
    return F.concat(F.lit("Today is "), day(today), F.lit(". Tomorrow is "), day(F.date_add(today, 1)), F.lit("."), rest, F.lit("\nNext week: "), run(F.date_add(today, left + 1), F.date_add(today, left + 7)), F.lit("."))
