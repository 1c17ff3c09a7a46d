"""Queries that load, type, chunk, ingest and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.operators import chunking, ingest, tables
from docsql.plans import records
from docsql.runtime import one_per_key, table, work_dir
from docsql.sources import delimited
from docsql.streaming import windows


def _one(s: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(s, d, "ingest_documents"), "id", "received_at")


def chunk_texts(s, d):
    """T-1: chunks of every record"""
    c = chunking.chunks(_one(s, d).select("id", "content"), "id", "content")
    return c.select("id", "ordinal", F.length("content").alias("chars"), F.sha2("content", 256).alias("hash"))


def _stored(s, d):
    """A stored state that differs: one collection is new, one has other titles, one other metadata."""
    new = ingest.prepared(_one(s, d))
    was = new.where("collection <> 'lab'").withColumn("title", F.when(F.col("collection") == "tickets", "before").otherwise(F.col("title"))).withColumn("metadata", F.when(F.col("collection") == "faq", '{"was":1}').otherwise(F.col("metadata")))
    return new, was.withColumn("content_hash", ingest.content_hash(F.col("collection"), F.col("title"), F.col("content"), F.col("metadata")))


def ingest_actions(s, d):
    """P-1, T-8: what an incremental run would do"""
    return ingest.changes(*_stored(s, d))


def ingest_runs(s, d):
    """P-1, K-5, K-6, K-8: an ingest, the same again, and the removal of a collection"""
    store = ingest.Store(s, f"{work_dir(s)}/store-{uuid.uuid4().hex}")
    one = _one(s, d)
    first, again = store.ingest(one), store.ingest(one)
    gone = store.clear("lab")
    return s.createDataFrame([("added", first.get("added", 0)), ("skipped", again.get("skipped", 0)), ("removed", gone), ("left", store.documents.count())], "step string, n bigint")


def column_types(s, d):
    """P-1 of tables: the narrowest type of each column, over all rows that load"""
    rows = delimited.clean_rows(table(s, d, "table_rows"), table(s, d, "table_files"))
    cells = rows.select("table_id", F.posexplode("values").alias("column_no", "value"))
    return cells.groupBy("table_id", "column_no").agg(tables.narrowest(F.col("value")).alias("type"))


def row_texts(s, d):
    """K-2"""
    return table(s, d, "part").select("p_partkey", chunking.row_text(["p_name", "p_brand", "p_size"]).alias("line"))


def section_texts(s, d):
    """K-3, K-4"""
    p = table(s, d, "part").withColumn("sheet", F.lit("part")).withColumn("row", F.col("p_partkey") + 1)
    return chunking.table_sections(p, "sheet", "row", ["p_name", "p_brand", "p_size"]).select("section", "first_row", "last_row", "cells", F.sha2("content", 256).alias("hash"))


def sample_windows(s, d):
    """ST-1: windows over n_chars samples at 10 a second"""
    w = windows.sample_windows(F.col("n_chars"), 10)
    return table(s, d, "documents").where("n_chars > 0").select("doc_id", F.explode(w).alias("w")).select("doc_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"))


def event_windows(s, d):
    """ST-1: its event-time analogue"""
    return windows.event_windows(table(s, d, "events"))


def stalls(s, d):
    """ST-8"""
    return windows.stalls(table(s, d, "events"))


def streamed_events(s, d):
    """ST-10: a stream of events without repeated ids, drained"""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    out = windows.drained(windows.first_of_each(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts").select("event_id", "event_type"), f"{work_dir(s)}/stream-{uuid.uuid4().hex}")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def stitched_transcripts(s, d):
    """ST-2: windows cut from the sentences of each text, as overlapping transcripts, stitched again"""
    t = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("audio_id"), F.split("text", r"(?<=[.!?])\s+").alias("said"))
    # a sentence takes 5 s: a window of 30 s has 6, the next begins with the last of them
    last = F.greatest(F.lit(0), F.ceil((F.size("said") - 6) / 5)).cast("int")
    seg = lambda k: F.transform(F.slice("said", k * 5 + 1, 6), lambda x, i: F.struct(((k * 5 + i) * 5.0).alias("start"), ((k * 5 + i) * 5.0 + 5).alias("end"), x.alias("text")))
    w = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * 25.0).alias("start"), (k * 25.0 + 30).alias("end"), seg(k).alias("segments")))
    return windows.stitched(t.select("audio_id", F.explode(w).alias("w")).select("audio_id", "w.*")).select("audio_id", "start", "end", F.sha2("text", 256).alias("hash"))


def streamed_documents(s, d):
    """ST-10: a stream of documents without those whose content came before, told by its hash"""
    schema = table(s, d, "documents").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/document[s].parquet").select("doc_id", F.coalesce("collection", F.lit("default")).alias("collection"), "updated_at", F.sha2(F.to_json(F.array("collection", "title", "text")), 256).alias("content_hash"))
    out = windows.drained(windows.first_of_each(stream, "content_hash", "updated_at", "10000 days"), f"{work_dir(s)}/stream-{uuid.uuid4().hex}")
    return out.groupBy("collection").agg(F.count("*").alias("n"))


_WHOLE, _DAY = "regexp_full_match(x, '-?(0|[1-9][0-9]*)')", "try_cast(x[1:10] as date) is not null"
_TIME = "[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
_TYPES = {
    "integer": f"{_WHOLE} and abs(coalesce(try_cast(x as hugeint), 9999999999)) <= 2147483647",
    "bigint": f"{_WHOLE} and try_cast(x as bigint) is not null",
    "numeric": "regexp_full_match(x, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?|-?[.][0-9]+')",
    "boolean": "lower(x) in ('true', 'false')",
    "date": f"regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and {_DAY}",
    "timestamp": f"regexp_full_match(x, '{_TIME}') and {_DAY}",
    "timestamptz": f"regexp_full_match(x, '{_TIME}(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)') and {_DAY}",
}
_TYPE_TESTS = " ".join(f"when bool_and({t}) filter (x is not null) then '{n}'" for n, t in _TYPES.items())
_PREPARED = "(select distinct id, coalesce(collection, 'default') as collection from ingest_documents where content is not null and id is not null)"
SQL: dict[str, str] = {
    "column_types": records._CELLS + f"""select table_id, column_no, case {_TYPE_TESTS} else 'text' end as type from (select table_id, unnest(range(width))::int as column_no, unnest(vals) as x from (select v.*, {records.REASON} as reason from v left join b on v.rn = b.rn) where reason is null) group by 1, 2""",
    "ingest_actions": f"select id, case collection when 'lab' then 'added' when 'tickets' then 'changed' when 'faq' then 'metadata' else 'skipped' end as action from {_PREPARED}",
    "ingest_runs": f"with p as (select * from {_PREPARED}) select 'added' as step, count(*) as n from p union all select 'skipped', count(*) from p union all select 'removed', count(*) from p where collection = 'lab' union all select 'left', count(*) from p where collection <> 'lab'",
    "row_texts": "select p_partkey, 'p_name: ' || p_name || '; p_brand: ' || p_brand || '; p_size: ' || p_size as line from part",
    "section_texts": "select p_partkey // 25 as section, min(p_partkey) + 1 as first_row, max(p_partkey) + 1 as last_row, 'A' || (min(p_partkey) + 2) || ':C' || (max(p_partkey) + 2) as cells, sha256('p_name | p_brand | p_size' || chr(10) || string_agg(concat_ws(' | ', p_name, p_brand, p_size), chr(10) order by p_partkey)) as hash from part group by 1",
    "sample_windows": "select doc_id, a as start_at, least(a + 300, n_chars) as end_at from (select doc_id, n_chars, unnest(range(0, greatest(1, ceil((n_chars - 300) / 250)::bigint + 1) * 250, 250)) as a from documents where n_chars > 0)",
    "event_windows": """with w as (select event_type, unnest([to_timestamp(floor(epoch(ts) / 25) * 25), to_timestamp(floor(epoch(ts) / 25) * 25 - 25)]) as window_start, ts from events)
        select window_start, event_type, count(*) as n from w where epoch(ts) - epoch(window_start) < 30 group by all""",
    "stalls": """with g as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 1800000000, true) as opens from events),
        r as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as run from g)
        select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from r group by user_id, run""",
    "streamed_documents": "select coalesce(collection, 'default') as collection, count(*) as n from (select distinct collection, title, text from documents) group by 1",
    "streamed_events": "select event_type, count(distinct event_id) as n from events group by 1",
}
QUERIES = [chunk_texts, ingest_actions, ingest_runs, column_types, row_texts, section_texts, sample_windows, event_windows, stalls, streamed_events, streamed_documents, stitched_transcripts]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
