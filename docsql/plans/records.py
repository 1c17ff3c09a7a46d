"""Queries over raw delimited records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsql.runtime import table
from docsql.sources import delimited


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delimited.row_faults(table(spark, d, "table_rows"), table(spark, d, "table_files")).select("row_id", "reason")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return delimited.clean_rows(table(spark, d, "table_rows"), table(spark, d, "table_files"))


_CELLS = r"""
with f as (select table_id, delimiter as d, len(columns) as width, column_types as kinds from table_files),
r as (select row_number() over () as rn, row_id, t.table_id, row_no, row_text as s, d, width, kinds from table_rows t left join f using (table_id)),
c as (select *, case d
    when ';' then regexp_extract_all(s || d, '("[^"]*(?:""[^"]*)*"|[^";][^;]*|);', 1)
    when '|' then regexp_extract_all(s || d, '("[^"]*(?:""[^"]*)*"|[^"|][^|]*|)[|]', 1)
    when ',' then regexp_extract_all(s || d, '("[^"]*(?:""[^"]*)*"|[^",][^,]*|),', 1)
    else regexp_extract_all(s || d, '("[^"]*(?:""[^"]*)*"|[^"\t][^\t]*|)\t', 1) end as cells from r),
q as (select *, list_sum(list_transform(cells, lambda x: length(x) + 1)) = length(s) + 1 as whole from c),
v as (select *, list_transform(cells, lambda x: nullif(trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end, ' ' || chr(9) || chr(10) || chr(13)), '')) as vals from q),
u as (select rn, unnest(vals) as x, unnest(kinds) as k from v where whole and len(cells) = width),
b as (select rn, bool_or(x is not null and not case k
    when 'integer' then regexp_full_match(x, '-?(0|[1-9][0-9]*)') and abs(coalesce(try_cast(x as hugeint), 9999999999)) <= 2147483647
    when 'numeric' then regexp_full_match(x, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?|-?[.][0-9]+')
    when 'boolean' then lower(x) in ('true', 'false')
    when 'date' then regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(x as date) is not null
    when 'timestamp' then regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?') and try_cast(x[1:10] as date) is not null
    else true end) as bad from u group by rn)
"""


REASON = "case when width is null or s is null then 'width' when not whole then 'quoting' when len(cells) <> width then 'width' when bad then 'value' end"


def queries() -> dict:
    return {"p4_found": p4_found, "p4_clean": p4_clean}


def oracle_sql() -> dict[str, str]:
    reason = REASON
    return {
        "p4_found": _CELLS + f"select row_id, reason from (select distinct row_id, table_id, row_no, s, {reason} as reason from v left join b on v.rn = b.rn) where reason is not null",
        "p4_clean": _CELLS + f"select row_id, table_id, row_no, vals as values from (select v.*, {reason} as reason from v left join b on v.rn = b.rn) where reason is null",
    }
