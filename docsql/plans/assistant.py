"""Queries around conversations with tools, names and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsql.functions import text
from docsql.operators import assistant, ordered
from docsql.plans.analytics import SECRET
from docsql.runtime import one_per_key, table

_ROLE = "lower(trim(get_json_object(message, '$.role')))"


def _turns(s, d):
    m = table(s, d, "messages").where("thread_id is not null").selectExpr("thread_id", "created_at", "id", f"{_ROLE} as role", "get_json_object(message, '$.content') as content", "message")
    return m.where("role in ('user', 'assistant', 'tool')")


def _calls(s, d):
    c = _turns(s, d).where("role = 'assistant'").dropDuplicates(["id"]).select("thread_id", "created_at", "id", F.from_json(F.get_json_object("message", "$.toolCalls"), "array<struct<name:string,input:string>>").alias("calls"))
    return c.select("thread_id", "created_at", "id", F.posexplode("calls").alias("pos", "c")).select("thread_id", "created_at", "id", "pos", F.col("c.name").alias("name"), F.col("c.input").alias("input"))


def tool_usage(s, d):
    """J-4, A-18"""
    return _calls(s, d).groupBy("name").agg(F.count("*").alias("calls"), F.count_distinct("thread_id").alias("threads"))


def repeated_tools(s, d):
    """W-10: calls like the one before them in their thread"""
    c = ordered.with_previous(_calls(s, d).withColumn("signature", F.concat_ws(" ", "name", "input")), ["thread_id"], ["created_at", "id", "pos"], ["signature"])
    return c.groupBy("name").agg(F.count_if(F.col("signature") == F.col("prev_signature")).alias("repeated"))


def follow_ups(s, d):
    """F-9, W-8: short questions with the user's question before"""
    u = _turns(s, d).where("role = 'user' and content is not null").dropDuplicates(["id"]).select("thread_id", "created_at", "id", "content")
    p = ordered.with_previous(u, ["thread_id"], ["created_at", "id"], ["content"])
    short = F.size(F.split(F.trim("content"), r"\s+")) <= 12
    return p.where(short & F.col("prev_content").isNotNull()).select("id", F.sha2(F.concat("prev_content", F.lit("\n"), "content"), 256).alias("query_hash"))


def tools_since_question(s, d):
    """F-21: threads whose last question was followed by a tool's result"""
    t = _turns(s, d).groupBy("thread_id").agg(F.max(F.when(F.col("role") == "user", F.struct("created_at", "id"))).alias("asked"), F.max(F.when(F.col("role") == "tool", F.struct("created_at", "id"))).alias("tool"))
    return t.select("thread_id", (F.col("asked").isNotNull() & F.coalesce(F.col("tool") > F.col("asked"), F.lit(False))).alias("used"))


def column_identifiers(s, d):
    """T-5"""
    c = table(s, d, "table_files").select("table_id", F.posexplode("columns").alias("column_no", "header"))
    return c.select("table_id", "column_no", text.sql_identifier(F.coalesce("header", F.lit("")), F.concat(F.lit("column_"), F.col("column_no") + 1)).alias("name"))


def packed_chunks(s, d):
    """P-7: chunks of each document in batches of 4000 characters"""
    c = table(s, d, "chunks").where("document_id is not null and content is not null").groupBy("document_id", "ordinal").agg(F.min(F.length("content")).alias("size"))
    return assistant.packed(c, "document_id", "ordinal", "size", 4000, joint=2)


def token_batches(s, d):
    """P-9: the same by number times longest"""
    c = table(s, d, "chunks").where("document_id is not null and content is not null").groupBy("document_id", "ordinal").agg(F.min(F.length("content")).alias("size"))
    return assistant.packed(c, "document_id", "ordinal", "size", 8000, by_longest=True)


def recent_turns(s, d):
    """O-14: the last 20 messages of each thread within 2000 characters, from a question on"""
    t = _turns(s, d).dropDuplicates(["id"]).withColumn("size", F.coalesce(F.length("content"), F.lit(0))).select("thread_id", "created_at", "id", "role", "size")
    return assistant.recent_history(t, "thread_id", ["created_at", "id"], 20, 2000, "size").select("thread_id", "id")


def memorable_facts(s, d):
    """P-20: what users say, without credentials"""
    return assistant.memorable(_turns(s, d).where("role = 'user'").select("id", "content").distinct(), "content").select("id")


def graded_threads(s, d):
    """P-17: threads that called a tool against the tools they should and should not call"""
    c = _calls(s, d).groupBy("thread_id").agg(F.collect_set("name").alias("used"))
    g = assistant.graded(c.withColumn("required", F.array(F.lit("execute_sql"))).withColumn("forbidden", F.array(F.lit("list_tables"))))
    return g.select("thread_id", "passed", F.size("missing").alias("missing"), F.size("unwanted").alias("unwanted"))


def latest_records(s, d):
    """K-5: one row per id, the one received last"""
    return one_per_key(table(s, d, "ingest_documents").select("id", "title", "received_at"), "id", "received_at").select("id", "received_at")


def top_sources(s, d):
    """O-9: the three records of each collection that changed last"""
    w = Window.partitionBy("collection").orderBy(F.desc_nulls_last("updated_at"), "doc_id")
    return table(s, d, "documents").select("collection", "doc_id", "updated_at").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("collection", "doc_id")


_T = "t as (select thread_id, created_at, id, lower(trim(json_extract_string(m, '$.role'))) as role, json_extract_string(m, '$.content') as content, m from (select *, case when json_valid(message) then message::json end as m from messages where thread_id is not null) where lower(trim(json_extract_string(m, '$.role'))) in ('user', 'assistant', 'tool'))"
_C = f"""{_T}, c as (select thread_id, created_at, id, pos, x->>'$.name' as name, x->'$.input' as input from
  (select thread_id, created_at, id, unnest(range(json_array_length(m, '$.toolCalls')::bigint)) as pos, unnest(json_extract(m, '$.toolCalls[*]')) as x from (select distinct on (id) * from t where role = 'assistant') where json_type(m, '$.toolCalls') = 'ARRAY'))"""
_SIZES = "c as (select document_id, ordinal, min(length(content))::int as size, row_number() over (partition by document_id order by ordinal) as i from chunks where document_id is not null and content is not null group by 1, 2)"
SQL: dict[str, str] = {
    "packed_chunks": f"""with recursive {_SIZES}, r as (select document_id, ordinal, size, i, 0 as batch, size + 2 as used from c where i = 1
        union all select c.document_id, c.ordinal, c.size, c.i, case when used + c.size > 4000 then batch + 1 else batch end, case when used + c.size > 4000 then 0 else used end + c.size + 2 from r join c on c.document_id = r.document_id and c.i = r.i + 1)
        select document_id, ordinal, size, batch from r""",
    "token_batches": f"""with recursive {_SIZES}, r as (select document_id, ordinal, size, i, 0 as batch, 1 as n, size as longest from c where i = 1
        union all select c.document_id, c.ordinal, c.size, c.i, case when (n + 1) * greatest(longest, c.size) > 8000 then batch + 1 else batch end, case when (n + 1) * greatest(longest, c.size) > 8000 then 1 else n + 1 end, case when (n + 1) * greatest(longest, c.size) > 8000 then c.size else greatest(longest, c.size) end from r join c on c.document_id = r.document_id and c.i = r.i + 1)
        select document_id, ordinal, size, batch from r""",
    "recent_turns": f"""with {_T}, u as (select distinct on (id) thread_id, created_at, id, role, coalesce(length(content), 0) as size from t),
        a as (select *, row_number() over (partition by thread_id order by created_at desc, id desc) as n, count(*) over (partition by thread_id) as total from u),
        b as (select *, sum((role = 'user')::int) over (partition by thread_id order by n) - (role = 'user')::int as turn, sum((role = 'user' and n <= 20)::int) over (partition by thread_id) as told from a),
        k as (select * from b where total <= 20 or (n <= 20 and told > 0 and turn < told) or (told = 0 and turn = 0)),
        f as (select thread_id, turn, sum(s) over (partition by thread_id order by turn) as used from (select thread_id, turn, sum(size) as s from k group by 1, 2))
        select thread_id, id from k join f using (thread_id, turn) where used <= 2000 or turn = 0""",
    "memorable_facts": f"with {_T}, c as (select distinct id, content from t where role = 'user' and content is not null) select id from c where trim(content) <> '' and not {SECRET}",
    "tool_usage": f"with {_C} select name, count(*) as calls, count(distinct thread_id) as threads from c group by 1",
    "repeated_tools": f"with {_C}, p as (select *, lag(name || ' ' || input) over (partition by thread_id order by created_at, id, pos) as prev from c) select name, count(*) filter (name || ' ' || input = prev) as repeated from p group by 1",
    "follow_ups": f"with {_T}, u as (select distinct on (id) * from t where role = 'user' and content is not null), p as (select *, lag(content) over (partition by thread_id order by created_at, id) as prev from u) select id, sha256(prev || chr(10) || content) as query_hash from p where prev is not null and len(regexp_split_to_array(trim(content), '\\s+')) <= 12",
    "tools_since_question": f"with {_T}, g as (select thread_id, max(case when role = 'user' then (created_at, id) end) as asked, max(case when role = 'tool' then (created_at, id) end) as tool from t group by 1) select thread_id, coalesce(asked is not null and tool > asked, false) as used from g",
    "column_identifiers": r"""with c as (select table_id, unnest(range(len(columns)))::int as column_no, unnest(columns) as h from table_files),
        n as (select table_id, column_no, regexp_replace(regexp_replace(replace(lower(regexp_replace(coalesce(h, ''), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '%', '_pct'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as n from c)
        select table_id, column_no, case when n = '' then 'column_' || (column_no + 1) when n in ('order', 'end', 'table', 'user') then n || '_' else n end as name from n""",
    "graded_threads": f"with {_C}, g as (select thread_id, list(distinct name) as used from c group by 1) select thread_id, list_contains(used, 'execute_sql') and not list_contains(used, 'list_tables') as passed, (not list_contains(used, 'execute_sql'))::int as missing, list_contains(used, 'list_tables')::int as unwanted from g",
    "latest_records": "select id, max(received_at) as received_at from ingest_documents where id is not null group by 1",
    "top_sources": "select collection, doc_id from (select *, row_number() over (partition by collection order by updated_at desc nulls last, doc_id) as rn from documents) where rn <= 3",
}
QUERIES = [tool_usage, repeated_tools, follow_ups, tools_since_question, column_identifiers, packed_chunks, token_batches, recent_turns, memorable_facts, graded_threads, latest_records, top_sources]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
