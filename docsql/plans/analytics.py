"""Queries over business, document and conversation tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsql.functions import detectors, numeric, structured, text
from docsql.operators import evaluation, ordered, retrieval
from docsql.runtime import one_per_key, table


def _t(name: str):
    return lambda s, d: table(s, d, name)


docs, ingest, chunks, threads, messages, events, orders, lineitem, customer, part, nation, region, embeddings = (
    _t(n) for n in "documents ingest_documents chunks threads messages events orders lineitem customer part nation region embeddings".split()
)


# -- aggregates ---------------------------------------------------------------------------------------------------------
def collection_stats(s, d):
    """A-1"""
    return docs(s, d).groupBy("collection").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


def embedding_progress(s, d):
    """A-2, A-3"""
    return chunks(s, d).agg(F.count("*").alias("total"), F.count("embedding").alias("done"), F.count_if(F.col("embedding").isNull()).alias("remaining"))


_price = "l_extendedprice * (1 - l_discount)"


def revenue(s, d):
    """A-4: revenue of orders that are not cancelled (status P stands for cancelled here)."""
    j = lineitem(s, d).join(orders(s, d).where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    exact = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"
    return j.agg(F.coalesce(F.sum(F.expr(exact)), F.lit(0)).cast("decimal(18,2)").alias("revenue"))


def average_order(s, d):
    """A-5: two-level aggregate."""
    return lineitem(s, d).groupBy("l_orderkey").agg(F.sum(F.expr(_price)).alias("t")).agg(F.round(F.avg("t"), 2).alias("aov"))


def month_over_month(s, d):
    """A-6, D-4: one pass over both half-open months."""
    day = F.col("o_orderdate")
    between = lambda a, b: (day >= F.lit(a).cast("timestamp")) & (day < F.lit(b).cast("timestamp"))
    g = orders(s, d).where(between("1996-01-01", "1996-03-01")).agg(F.sum(F.when(between("1996-01-01", "1996-02-01"), F.col("o_totalprice"))).alias("a"), F.sum(F.when(between("1996-02-01", "1996-03-01"), F.col("o_totalprice"))).alias("b"))
    return g.select(F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 1).alias("pct"))


def nations_of_region(s, d):
    """A-7: ordered string aggregate."""
    j = nation(s, d).join(region(s, d), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))


def distinct_buyers(s, d):
    """A-8"""
    return orders(s, d).groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("buyers"))


def dominant_language(s, d):
    """A-10: weighted mode, ties to the smaller name."""
    g = docs(s, d).where("lang is not null").groupBy("collection", "lang").agg(F.sum("n_chars").alias("w"))
    return g.groupBy("collection").agg(F.min_by("lang", F.struct(-F.col("w"), F.col("lang"))).alias("lang"))


def repeated_edge_lines(s, d):
    """A-11, T-28, F-22: keys of lines that stand at page edges of at least three pages and half of a record's pages."""
    one = one_per_key(ingest(s, d).select("id", "content", "received_at"), "id", "received_at")
    page = one.select("id", F.posexplode(F.split("content", "\f")).alias("page", "body")).withColumn("lines", F.filter(F.split("body", "\r?\n"), lambda x: F.trim(x) != ""))
    edge = F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.lit(1), F.size("lines") - 1), 2))
    keys = page.where(F.size("lines") > 0).select("id", "page", F.explode(F.array_distinct(F.transform(edge, text.running_key))).alias("key"))
    pages = page.groupBy("id").agg(F.count("*").alias("pages"))
    return keys.groupBy("id", "key").agg(F.count("*").alias("n")).join(pages, "id").where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.5)))).select("id", "key", "n")


_passed = "value > 50 as passed"


def pass_rates(s, d):
    """A-12, M-5"""
    return evaluation.pass_rates(events(s, d).selectExpr("event_type", _passed), "event_type", "passed")


def case_repeats(s, d):
    """A-12: all repeats, any repeat"""
    return evaluation.repeats(events(s, d).selectExpr("user_id", _passed), "user_id", "passed")


def latency(s, d):
    """A-13, M-7"""
    return evaluation.latency(events(s, d), "event_type", "value")


def report_compare(s, d):
    """P-18, J-21"""
    e = events(s, d).selectExpr("event_type", _passed, "user_id % 2 as half")
    r = lambda h: evaluation.pass_rates(e.where(F.col("half") == h), "event_type", "passed")
    return evaluation.compare(r(0), r(1), "event_type")


# -- joins, sorts -------------------------------------------------------------------------------------------------------
def top_customers(s, d):
    """J-16, O-11: the ten customers of most revenue"""
    j = lineitem(s, d).join(orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(F.expr(_price)), 2).alias("revenue"))
    return j.join(customer(s, d), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(10)


def last_three_orders(s, d):
    """O-11 per customer: the group limit stands below the shuffle"""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return orders(s, d).select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", F.row_number().over(w)).where("rn <= 3")


def recent_threads(s, d):
    """O-10: the twenty threads changed last"""
    return threads(s, d).select("id", "title", "updated_at").distinct().orderBy(F.desc_nulls_last("updated_at"), "id").limit(20)


def find_customers(s, d):
    """R-3: every word of the query, in any order"""
    word = lambda w: F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lower(w))
    return customer(s, d).where(F.forall(F.split(F.trim(F.lit(" build  customer ")), r"\s+"), word)).select("c_custkey", "c_name")


def thread_message_join(s, d):
    """J-12, J-15: threads with their number of messages, none included"""
    m = messages(s, d).where("thread_id is not null").groupBy("thread_id").agg(F.count_distinct("id").alias("n"))
    t = threads(s, d).select("id").distinct()
    return t.join(m, F.col("id") == F.col("thread_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("messages"))


# -- text ---------------------------------------------------------------------------------------------------------------
def title_terms(s, d):
    """T-2, T-26"""
    return docs(s, d).select("doc_id", F.array_join(F.array_sort(text.query_terms(F.col("title"))), " ").alias("terms"), text.normalized(F.col("title")).alias("plain"))


def document_ids(s, d):
    """T-9"""
    return ingest(s, d).select("id", text.document_id(F.col("source"), F.col("content")).alias("default_id")).distinct()


def document_labels(s, d):
    """T-13, T-14"""
    return docs(s, d).select("doc_id", text.readable_source(F.col("source")).alias("shown"), text.label(F.col("title"), F.col("source"), F.col("doc_id").cast("string")).alias("label"))


def compact_texts(s, d):
    """T-12"""
    return docs(s, d).select("doc_id", text.compact_value(F.col("text")).alias("shown"))


def embedding_inputs(s, d):
    """T-3"""
    return docs(s, d).select("doc_id", F.sha2(text.embedding_input(F.col("title"), F.col("text")), 256).alias("input_hash"))


_content = "get_json_object(message, '$.content')"


def _messages(s, d):
    return messages(s, d).select("id", F.expr(_content).alias("content")).where("content is not null").distinct()


def cited(s, d):
    """T-16"""
    return _messages(s, d).select("id", F.array_join(text.cited_numbers(F.col("content")), ",").alias("cited")).where("cited <> ''")


def message_flags(s, d):
    """T-20, F-10, F-13"""
    c = F.col("content")
    return _messages(s, d).select("id", text.declines(c).alias("declines"), detectors.looks_injected(c).alias("injected"), detectors.reworks_conversation(c).alias("reworks"))


def message_intents(s, d):
    """F-14, F-15"""
    c = F.col("content")
    return _messages(s, d).select("id", detectors.looks_secret(c).alias("secret"), detectors.asks_to_remember(c).alias("remember"), detectors.asks_to_forget(c).alias("forget"))


def redacted_documents(s, d):
    """F-11"""
    return docs(s, d).select("doc_id", F.sha2(detectors.redact_injections(F.col("text")), 256).alias("redacted_hash"))


def event_clock(s, d):
    """T-25"""
    return events(s, d).select("event_id", text.clock(F.col("value") * 60 - 30).alias("clock"))


def date_contexts(s, d):
    """D-2 for every day with events"""
    return events(s, d).select(F.to_date("ts").alias("day")).distinct().select("day", structured.date_context(F.col("day")).alias("context"))


def metadata_filter(s, d):
    """F-3: containment"""
    return ingest(s, d).where(structured.json_contains(F.col("metadata"), {"department": "lab", "status": "current"})).select("id").distinct()


def tagged_filter(s, d):
    """F-3: containment of arrays"""
    return ingest(s, d).where(structured.json_contains(F.col("metadata"), {"tags": ["pilot"], "status": "current"})).select("id").distinct()


def merged_metadata(s, d):
    """J-3"""
    one = one_per_key(ingest(s, d).select("id", "metadata", "received_at"), "id", "received_at")
    m = structured.merge_json(F.col("metadata"), F.lit('{"status":"seen"}'))
    return one.select("id", F.get_json_object(m, "$.status").alias("status"), F.get_json_object(m, "$.department").alias("department"))


# -- ordered ------------------------------------------------------------------------------------------------------------
_known = "lower(trim(get_json_object(message, '$.role'))) in ('user', 'assistant', 'tool')"


def _turns(s, d):
    m = messages(s, d).where("thread_id is not null").where(_known)
    return m.select("thread_id", "created_at", "id", F.expr("lower(trim(get_json_object(message, '$.role')))").alias("role")).dropDuplicates(["thread_id", "created_at", "id"])


def latest_user_message(s, d):
    """W-8"""
    u = _turns(s, d).where("role = 'user'")
    return u.groupBy("thread_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("latest"), F.count("*").alias("questions"))


def message_gaps(s, d):
    """W-6: seconds since the message before"""
    g = ordered.with_previous(_turns(s, d), ["thread_id"], ["created_at", "id"], ["created_at"])
    return g.select("thread_id", "id", (F.unix_micros("created_at") - F.unix_micros("prev_created_at")).alias("gap_us"))


def role_runs(s, d):
    """W-11: neighbours of one role as one run"""
    r = ordered.merged_runs(_turns(s, d), ["thread_id"], ["created_at", "id"], "role")
    return r.select("thread_id", "role", F.col("first.id").alias("first_id"), "n")


def passage_budget(s, d):
    """W-9, T-15: the leading chunks of each document within 3000 characters"""
    c = chunks(s, d).where("document_id is not null and content is not null").groupBy("document_id", "ordinal").agg(F.min("content").alias("content")).withColumn("size", F.length("content"))
    return retrieval.within_budget(c, "size", 3000, ("document_id",), "ordinal").select("document_id", "ordinal")


def citation_numbers(s, d):
    """W-5"""
    m = messages(s, d).where("thread_id is not null").select("thread_id", "created_at", "id", F.from_json(F.get_json_object("message", "$.citations"), "array<struct<documentId:string,content:string>>").alias("c"))
    c = m.select("thread_id", "created_at", "id", F.posexplode("c").alias("pos", "x")).select("thread_id", "created_at", "id", "pos", F.col("x.documentId").alias("document_id"), F.col("x.content").alias("content"))
    return retrieval.numbered(c, "thread_id", ["created_at", "id", "pos"], ["document_id", "content"])


# -- vectors ------------------------------------------------------------------------------------------------------------
def cosine_to_first(s, d):
    """M-1: every vector against the vector of the smallest id"""
    e = embeddings(s, d)
    first = e.groupBy().agg(F.min_by("embedding", "vec_id").alias("q")).first()["q"] or []  # one vector
    return e.select("vec_id", F.round(numeric.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first])), 6).alias("similarity"))


def short_vectors(s, d):
    """M-2: cut to 16 numbers and scaled again"""
    u = numeric.unit(F.col("embedding"), 16)
    return embeddings(s, d).select("vec_id", F.round(u[0], 6).alias("first"), F.round(u[15], 6).alias("last"))


def _queries(s, d):
    return embeddings(s, d).where("vec_id % 20 = 0")


def vector_top(s, d):
    """O-1, W-1: exact top 5 of every twentieth vector against all"""
    e = embeddings(s, d).select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.semantic_top(_queries(s, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e, 5).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


def _asked(s, d):
    return docs(s, d).where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def keyword_top(s, d):
    """O-2, W-2, F-4: titles of every twentieth document against all documents"""
    c = docs(s, d).where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.keyword_top(_asked(s, d), c, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _hybrid(s, d, mode="hybrid"):
    e = embeddings(s, d).select("vec_id", "embedding")
    c = docs(s, d).join(e, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "embedding")
    q = _asked(s, d).join(e, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "text", F.col("embedding").alias("vector"))
    return retrieval.search(q, c.where("content is not null or embedding is not null"), 8, mode)


def hybrid_search(s, d):
    """P-3, J-10, M-4, O-3"""
    return _hybrid(s, d).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def relevant_hits(s, d):
    """F-5, F-6"""
    return retrieval.relevant(_hybrid(s, d, "vector").where("similarity >= 0.2")).select("query_id", "chunk_id")


def retrieval_quality(s, d):
    """A-15, M-6, W-3, W-4: relevant are the vectors of the query's label"""
    e = embeddings(s, d).select(F.col("vec_id").alias("doc_id"), "label")
    top = vector_top(s, d).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    return evaluation.label_metrics(top, _queries(s, d).select(F.col("vec_id").alias("query_id"), "label"), e, 5).select("query_id", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"))


def floor_calibration(s, d):
    """A-16"""
    e = events(s, d).select((F.col("value") / 100).alias("s"), (F.col("event_type") == "click").alias("on"))
    return evaluation.relevance_floor(e, "s", "on")


_RANKED = """
q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id as chunk_id, list_cosine_similarity(v::double[], embedding::double[]) as sim from q, embeddings),
r as (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from s)
"""
_TERMS = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 or regexp_matches(w, '[0-9]')))"
_KEYWORD = rf"""
asked as (select doc_id as query_id, {_TERMS.format('title')} as terms from documents where doc_id % 20 = 0 and title is not null),
a as (select query_id, len(terms) as nterms, unnest(terms) as term from asked),
w as (select doc_id as chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as term from documents where text is not null),
h as (select chunk_id, term, count(*) as n from w where term in (select term from a) group by all),
k as (select query_id, chunk_id, count(*) / max(nterms) + sum(n) / (sum(n) + 100.0) as score from a join h using (term) group by all),
kr as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from k)
"""
_TURNS = """t as (select distinct on (thread_id, created_at, id) thread_id, created_at, id, role from (select *, lower(trim(json_extract_string(case when json_valid(message) then message end, '$.role'))) as role from messages where thread_id is not null) where role in ('user', 'assistant', 'tool'))"""
_MESSAGES = "m as (select distinct id, content from (select id, json_extract_string(case when json_valid(message) then message end, '$.content') as content from messages) where content is not null)"
_rev = "l_extendedprice * (1 - l_discount)"
_WILSON = """(select k, n, p, (p / n + 1.96 * 1.96 / (2 * n)) as mid, 1.96 * sqrt((p / n) * (1 - p / n) / n + 1.96 * 1.96 / (4 * n * n)) as w, 1 + 1.96 * 1.96 / n as den
  from (select {} as k, count(value)::double as n, sum(case when value > 50 then 1 else 0 end)::double as p from events {} group by 1))"""
_ONE = "(select * from (select *, row_number() over (partition by id order by received_at desc) as rn from ingest_documents) where rn = 1)"


#: A text holds a credential: what is written behind its name has a digit or a sign; a card number; a key; a bare password.
SECRET = r"""(list_bool_or(list_prepend(false, list_transform(regexp_extract_all(content, '(?i)\b(?:password|passcode|passphrase|pin|api[ _-]?key|secret|token|credentials?|cvv)\b\W{0,3}(?:is|was|:|=)\s*["''`]?(\S{4,})', 1), lambda x: regexp_matches(x, '[\d!@#$%^&*]'))))
    or regexp_matches(content, '\b(?:\d[ -]?){13,19}\b') or regexp_matches(content, '\b(sk|pk|rk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{10,}') or regexp_matches(content, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
    or list_bool_or(list_prepend(false, list_transform(list_transform(regexp_extract_all(content, '\S{8,}'), lambda x: rtrim(ltrim(x, '"''`('), '"''`).,;:!?')), lambda x: length(x) >= 8 and regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]') and regexp_matches(x, '[^\w\s]') and not regexp_matches(x, '(?i)^[a-z]+://|^[^@\s]+@[^@\s]+\.[a-z]+$')))))"""


def _pct(p: float, v: str = "value") -> str:
    return f"list_sort(list({v}))[least(count({v}) - 1, floor({p} * count({v})))::int + 1]"


SQL: dict[str, str] = {
    "collection_stats": "select collection, count(*) as documents, coalesce(sum(n_chars), 0)::bigint as chars from documents group by 1",
    "embedding_progress": "select count(*) as total, count(embedding) as done, count(*) - count(embedding) as remaining from chunks",
    "revenue": f"select coalesce(sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2))), 0)::decimal(18,2) as revenue from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P'",
    "average_order": f"select round(avg(t), 2) as aov from (select sum({_rev}) as t from lineitem group by l_orderkey)",
    "month_over_month": "select round(((select sum(o_totalprice) from orders where o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1996-03-01') / (select sum(o_totalprice) from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-02-01') - 1) * 100, 1) as pct",
    "nations_of_region": "select r_name, string_agg(n_name, ', ' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by 1",
    "distinct_buyers": "select o_orderpriority, count(distinct o_custkey) as buyers from orders group by 1",
    "dominant_language": "select collection, lang from (select *, row_number() over (partition by collection order by w desc, lang) as r from (select collection, lang, sum(n_chars) as w from documents where lang is not null group by 1, 2)) where r = 1",
    "repeated_edge_lines": rf"""with p as (select id, unnest(string_split(content, chr(12))) as body, unnest(range(len(string_split(content, chr(12))))) as page from {_ONE} where id is not null and content is not null),
        l as (select id, page, list_filter(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '') as ls from p),
        e as (select distinct id, page, trim(regexp_replace(regexp_replace(lower(x), '\d+', '#', 'g'), '\s+', ' ', 'g')) as key from (select id, page, unnest(list_concat(ls[1:2], ls[-2:])) as x from l where len(ls) > 0)),
        n as (select id, count(*) as pages from l group by 1)
        select e.id, key, count(*) as n from e join n using (id) group by e.id, key, pages having pages >= 3 and count(*) >= greatest(3, ceil(pages * 0.5))""",
    "pass_rates": f"select k as event_type, n::bigint as total, p::bigint as passed, p / n as rate, greatest(0, (mid - w) / den) as low, least(1, (mid + w) / den) as high from {_WILSON.format('event_type', '')}",
    "case_repeats": "select count(*) as cases, count(*) filter (a) as always, count(*) filter (o) as ever from (select user_id, bool_and(value > 50) as a, bool_or(value > 50) as o from events group by 1)",
    "latency": f"select event_type, avg(value) as mean, {_pct(0.5)} as p50, {_pct(0.9)} as p90 from events group by 1",
    "report_compare": f"""with a as (select k, p / n as rate, greatest(0, (mid - w) / den) as low, least(1, (mid + w) / den) as high from {_WILSON.format('event_type', 'where user_id % 2 = 0')}),
        b as (select k, p / n as rate, greatest(0, (mid - w) / den) as low, least(1, (mid + w) / den) as high from {_WILSON.format('event_type', 'where user_id % 2 = 1')})
        select a.k as event_type, a.rate as before, b.rate as after, b.rate - a.rate as change, b.low > a.high or b.high < a.low as significant from a join b on a.k = b.k""",
    "top_customers": f"select c_custkey, c_name, revenue from (select o_custkey, round(sum({_rev}), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey group by 1) join customer on o_custkey = c_custkey order by revenue desc, c_custkey limit 10",
    "last_three_orders": "select o_custkey, o_orderkey, o_orderdate, rn::int as rn from (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 3",
    "recent_threads": "select distinct id, title, updated_at from threads order by updated_at desc nulls last, id limit 20",
    "find_customers": "select c_custkey, c_name from customer where lower(c_name || ' ' || c_mktsegment) like '%build%' and lower(c_name || ' ' || c_mktsegment) like '%customer%'",
    "thread_message_join": "select id, coalesce(n, 0) as messages from (select distinct id from threads) left join (select thread_id, count(distinct id) as n from messages group by 1) on id = thread_id",
    "title_terms": rf"select doc_id, array_to_string(list_sort({_TERMS.format('title')}), ' ') as terms, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as plain from documents",
    "document_ids": "select distinct id, 'doc_' || sha256(coalesce(source, content))[1:24] as default_id from ingest_documents",
    "document_labels": r"""select doc_id, shown, coalesce(nullif(concat_ws(' — ', nullif(title, ''), shown), ''), doc_id::varchar) as label from (select *, case when regexp_matches(source, '^(?i)https?://') then source
        when regexp_matches(source, '(?i)[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}|[0-9a-f]{24,}') or regexp_matches(source, '^(?i)[a-z][\w+.-]*:[^/]') or source = '' then null else source end as shown from documents)""",
    "compact_texts": "select doc_id, case when length(text) > 400 then case when text[1] = '[' then '[vector ' || len(string_split(text, ',')) || 'd]' else text[1:400] || '…' end else text end as shown from documents",
    "embedding_inputs": "select doc_id, sha256(case when title is not null then title || chr(10) || chr(10) || text else text end) as input_hash from documents",
    "cited": f"with {_MESSAGES} select id, array_to_string(list_distinct(c), ',') as cited from (select id, flatten(list_transform(regexp_extract_all(content, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda g: list_transform(regexp_split_to_array(g, '\\s*,\\s*'), lambda n: n::int))) as c from m) where len(c) > 0",
    "message_flags": f"with {_MESSAGES} select id, "
    + ", ".join(f"regexp_matches(content, '(?i){'|'.join(f'(?:{p})' for p in ps).replace(chr(39), chr(39) * 2)}') as {n}" for n, ps in (("declines", text.DECLINES), ("injected", [detectors.INJECTION]), ("reworks", [detectors.REWORK])))
    + " from m",
    "message_intents": f"with {_MESSAGES} select id, {SECRET} as secret, regexp_matches(content, '(?i)\\b(remember|don''?t forget|keep in mind|make a note|note that|update what you (know|remember))\\b[^.?!]*(?:[.!]|\\z)') as remember, regexp_matches(regexp_replace(content, '(?i)don''?t (forget|delete what you (know|remember)|stop remembering)', 'X', 'g'), '(?i)\\b(forget|delete what you (know|remember)|stop remembering)\\b[^.?!]*(?:[.!]|\\z)') as forget from m",
    "redacted_documents": f"select doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda p: case when regexp_matches(p, '(?i){detectors.INJECTION}') then '{detectors.REMOVED}' else p end), chr(10))) as redacted_hash from documents",
    "event_clock": "select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad(((s // 60) % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else lpad((s // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') end as clock from (select event_id, greatest(0, floor(value * 60 - 30))::bigint as s from events)",
    "date_contexts": """with d as (select distinct ts::date as day from events), l as (select day, ((8 - (dayofweek(day) + 1)) % 7)::int as left from d)
        select day, 'Today is ' || strftime(day, '%A %Y-%m-%d') || '. Tomorrow is ' || strftime(day + 1, '%A %Y-%m-%d') || '.'
          || case when "left" > 0 then chr(10) || 'Rest of this week: ' || array_to_string(list_transform(range(1, "left" + 1), lambda i: strftime(day + i::int, '%A %Y-%m-%d')), ', ') || '.' else '' end
          || chr(10) || 'Next week: ' || array_to_string(list_transform(range("left" + 1, "left" + 8), lambda i: strftime(day + i::int, '%A %Y-%m-%d')), ', ') || '.' as context from l""",
    "metadata_filter": """select distinct id from ingest_documents where json_extract_string(metadata, '$.department') = 'lab' and json_extract_string(metadata, '$.status') = 'current'""",
    "tagged_filter": """select distinct id from ingest_documents where json_extract_string(metadata, '$.status') = 'current' and list_contains(json_extract_string(metadata, '$.tags[*]'), 'pilot')""",
    "merged_metadata": f"select id, 'seen' as status, json_extract_string(metadata, '$.department') as department from {_ONE} where id is not null",
    "latest_user_message": f"with {_TURNS} select thread_id, max((created_at, id))[2] as latest, count(*) as questions from t where role = 'user' group by 1",
    "message_gaps": f"with {_TURNS} select thread_id, id, epoch_us(created_at) - epoch_us(lag(created_at) over (partition by thread_id order by created_at, id)) as gap_us from t",
    "role_runs": f"with {_TURNS}, o as (select *, coalesce(lag(role) over w <> role, true) as opens from t window w as (partition by thread_id order by created_at, id)), g as (select *, sum(opens::int) over (partition by thread_id order by created_at, id) as run from o) select thread_id, any_value(role) as role, min((created_at, id))[2] as first_id, count(*) as n from g group by thread_id, run",
    "passage_budget": """with c as (select document_id, ordinal, length(min(content)) as size from chunks where document_id is not null and content is not null group by all),
        u as (select *, sum(size) over w as used, row_number() over w as r from c window w as (partition by document_id order by ordinal)),
        o as (select *, max((r > 1 and used > 3000)::int) over (partition by document_id order by ordinal) as stop from u) select document_id, ordinal from o where stop = 0""",
    "citation_numbers": """with j as (select thread_id, created_at, id, case when json_valid(message) then message::json end as m from messages where thread_id is not null),
        c as (select thread_id, created_at, id, unnest(range(json_array_length(m, '$.citations')::bigint)) as pos, unnest(json_extract(m, '$.citations[*]')) as x from j where json_type(m, '$.citations') = 'ARRAY'),
        f as (select thread_id, x->>'$.documentId' as document_id, x->>'$.content' as content, min((created_at, id, pos)) as first from c group by all)
        select thread_id, document_id, content, row_number() over (partition by thread_id order by first)::int as n from f""",
    "cosine_to_first": "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings order by vec_id limit 1)::double[]), 6) as similarity from embeddings",
    "short_vectors": "select vec_id, round(v[1] / n, 6) as first, round(v[16] / n, 6) as last from (select vec_id, embedding[1:16]::double[] as v, sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::double * x::double))) as n from embeddings)",
    "vector_top": f"with {_RANKED} select query_id, chunk_id, rank::int as rank, round(sim, 6) as similarity from r where rank <= 5",
    "keyword_top": f"with {_KEYWORD} select query_id, chunk_id, rank::int as rank, round(score, 6) as score from kr where rank <= 5",
    "hybrid_search": f"""with {_KEYWORD},
        q as (select query_id, embedding as v from asked join embeddings on vec_id = query_id),
        s as (select query_id, doc_id as chunk_id, list_cosine_similarity(v::double[], embedding::double[]) as sim from q, embeddings join documents on vec_id = doc_id),
        r as (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from s),
        f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.chunk_id, b.chunk_id) as chunk_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) as score
          from (select * from r where rank <= 32) a full outer join (select * from kr where rank <= 32) b on a.query_id = b.query_id and a.chunk_id = b.chunk_id),
        o as (select *, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) as rank from f)
        select query_id, chunk_id, round(score, 9) as score, rank::int as rank from o where rank <= 8""",
    "relevant_hits": """with q as (select vec_id as query_id, embedding as v from embeddings join documents on doc_id = vec_id where vec_id % 20 = 0 and title is not null),
        s as (select query_id, doc_id as chunk_id, list_cosine_similarity(v::double[], embedding::double[]) as sim from q, embeddings join documents on vec_id = doc_id),
        r as (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from s), h as (select * from r where rank <= 8 and sim >= 0.2),
        b as (select *, max(sim) over (partition by query_id) as best from h) select query_id, chunk_id from b where best >= 0.35 and sim >= 0.35 + (best - 0.35) * 0.5""",
    "retrieval_quality": f"""with {_RANKED}, top as (select * from r where rank <= 5),
        w as (select a.vec_id as query_id, b.vec_id as doc_id from embeddings a join embeddings b on a.label = b.label where a.vec_id % 20 = 0),
        t as (select query_id, count(*) as total from w group by 1),
        h as (select top.query_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from top join w on w.query_id = top.query_id and w.doc_id = top.chunk_id group by 1)
        select t.query_id, round(coalesce(hits, 0) / total, 6) as recall, round(coalesce(1 / first, 0), 6) as reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(total, 5)::int + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg from t left join h using (query_id)""",
    "floor_calibration": f"""with e as (select value / 100 as s, event_type = 'click' as o from events), f as (select floor({_pct(0.03, 's')} * 100 + 0.5) / 100 as floor from e where o)
        select floor, count(*) filter (o and s >= floor) as kept, count(*) filter (not o and s < floor) as silenced from e, f group by floor""",
}

QUERIES = [
    collection_stats, embedding_progress, revenue, average_order, month_over_month, nations_of_region, distinct_buyers, dominant_language, repeated_edge_lines, pass_rates,
    case_repeats, latency, report_compare, top_customers, last_three_orders, recent_threads, find_customers, thread_message_join, title_terms, document_ids,
    document_labels, compact_texts, embedding_inputs, cited, message_flags, message_intents, redacted_documents, event_clock, date_contexts,
    metadata_filter, tagged_filter, merged_metadata, latest_user_message, message_gaps, role_runs, passage_budget, citation_numbers, cosine_to_first, short_vectors,
    vector_top, keyword_top, hybrid_search, relevant_hits, retrieval_quality, floor_calibration,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
