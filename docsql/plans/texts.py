"""Queries over texts that are built from columns, so that SQL knows from the columns what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsql.functions import detectors, numeric, structured, text
from docsql.operators import agent, assistant, chunking, condense, tables
from docsql.runtime import one_per_key, table
from docsql.sources import glyphs
from docsql.streaming import windows


def _part(s, d):
    return table(s, d, "part")


def _order(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority")


def _pick(key, items):
    """One of a list of Columns, by a number."""
    return F.element_at(F.array(*items), (F.pmod(key, F.lit(len(items))) + 1).cast("int"))


def _lits(*texts):
    return [F.lit(t) for t in texts]


def stated_numbers(s, d):
    """T-17, T-18: a price with separators, a quantity, and a negative thousand among identifiers"""
    li = table(s, d, "lineitem")
    said = F.concat(F.lit("Item v"), "l_linenumber", F.lit(".2 (A"), "l_linenumber", F.lit(") costs $"), F.format_number("l_extendedprice", 2), F.lit(" for "), F.col("l_quantity").cast("int"), F.lit(" pieces, not -"), "l_linenumber", F.lit("k"))
    n = text.numbers_in(said)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("numbers"), text.number_near(said, 20.0).alias("near"))


def stated_counts(s, d):
    """T-19: a count as a word or as digits"""
    p = _part(s, d).select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.array(*_lits(*text.COUNT_WORDS)), (F.col("p_size") % 13 + 1).cast("int"))).otherwise((F.col("p_size") % 13).cast("string")).alias("w"))
    return p.select("p_partkey", text.states_count(F.concat(F.lit("There are "), "w", F.lit(" of them, at 3.5 each")), 3).alias("three"))


CLAIMS = ("I deleted the order.", "We removed it", "It has now been dropped", "Done, deleted it", "Shall I delete it?", "Nothing was deleted. Proceed?", "You deleted it", "It had been removed")


def claims(s, d):
    """T-22, T-23, F-21: claims that something was done, qualified or not, and promised calls"""
    o = _order(s, d)
    t = _pick(F.col("o_orderkey"), _lits(*CLAIMS))
    more = F.concat(t, F.lit(" "), _pick(F.floor(F.col("o_orderkey") / 8), _lits("Let me run the query.", "let me know", "I'll now retry", "I will call you")))
    return o.select("o_orderkey", text.claims_done(t, "deleted|removed|dropped").alias("claims"), text.only_qualified(t, "delete|remove", r"\b(nothing|shall)\b").alias("qualified"), text.promises_call(more).alias("promises"))


def matched_parts(s, d):
    """T-21, F-26, U-4: matchers of words, patterns and predicates, combined"""
    import re

    m = text.all_of(text.any_of("RING", re.compile(r"^large ")), text.none_of(re.compile("blue", re.I), lambda c: F.length(c) > 11))
    return _part(s, d).where(m(F.col("p_name"))).select("p_partkey", "p_name")


def repeated_sentences(s, d):
    """T-24: a sentence of forty characters that comes four times or more"""
    one = F.concat(F.lit("The part of brand "), "p_brand", F.lit(" is counted once more before noon. "))
    return _part(s, d).where(text.reasoning_loops(F.repeat(one, (F.col("p_size") % 7).cast("int")))).select("p_partkey")


def query_prefixes(s, d):
    """T-4"""
    tasks = ["search", "question-answering", "fact-checking", "code-retrieval", "classification", "clustering", "similarity", "other"]
    return table(s, d, "documents").select("doc_id", text.query_prefix(_pick(F.col("doc_id"), _lits(*tasks))).alias("prefix"))


def truncated_texts(s, d):
    """T-11, T-29"""
    t = table(s, d, "documents")
    return t.select("doc_id", F.sha2(text.truncated(F.col("text"), 100), 256).alias("cut_hash"), text.one_line(F.col("title")).alias("title"))


def header_columns(s, d):
    """T-6: header names of every table"""
    return table(s, d, "table_files").select("table_id", F.posexplode(tables.clean_headers(F.col("columns"))).alias("column_no", "name"))


def chunk_bounds(s, d):
    """T-1: what must hold for the chunks of every record, and the whole chunk where there is one"""
    one = one_per_key(table(s, d, "ingest_documents"), "id", "received_at")
    c = chunking.chunks(one.select("id", "content"), "id", "content")
    ends = lambda f, at: f(F.struct("ordinal", "content"))["content"].alias(at)
    g = c.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("most"), F.max("ordinal").alias("last"), ends(F.min, "a"), ends(F.max, "z"))
    clean = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"^[\s\x{feff}\x{a0}]+|[\s\x{feff}\x{a0}]+$", "")
    j = one.select("id", clean.alias("t")).join(g, "id")
    return j.select("id", (F.col("n") == 1).alias("single"), F.when(F.col("n") == 1, F.sha2("a", 256)).alias("hash"), ((F.col("last") == F.col("n") - 1) & (F.col("most") <= 1351)).alias("fits"), F.col("t").startswith(F.regexp_extract("a", r"^\S{1,10}", 0)).alias("begins"), F.col("t").endswith(F.regexp_extract("z", r"\S{1,10}$", 0)).alias("ends"))


def hashed_titles(s, d):
    """M-3: the vectors of titles, entry by entry"""
    t = table(s, d, "documents").where("title is not null").select("doc_id", numeric.hash_embed(F.col("title")).alias("v"))
    return t.select("doc_id", F.posexplode("v").alias("dim", "weight")).where("weight <> 0").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


def sigmoids(s, d):
    """M-8, M-10"""
    e = table(s, d, "events")
    return e.select("event_id", F.round(numeric.sigmoid((F.col("value") - 50) / 10), 9).alias("p"), F.round(numeric.norm(F.array(F.col("value"), F.lit(3.0))), 9).alias("length"))


def random_numbers(s, d):
    """P-22: the generator of the fixtures, any number of it from its place"""
    return table(s, d, "orders").select("o_orderkey", F.round(numeric.mulberry(F.lit(42), F.col("o_orderkey") + 1), 12).alias("x"))


def stamps(s, d):
    """D-1, D-3"""
    o = table(s, d, "orders")
    day = F.concat(F.lit("2023-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_custkey") % 33).cast("string"), 2, "0"))
    return o.select("o_orderkey", structured.valid_date(day).alias("valid"), structured.iso_stamp(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_custkey") / 8)).alias("stamp"))


def merged_objects(s, d):
    """J-3: types and nested values stay"""
    a = F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("of"), F.col("p_name").alias("name")))
    b = F.to_json(F.struct((F.col("p_size") > 20).alias("name"), F.array("p_size").alias("list")))
    m = structured.merge_json(a, b)
    at = lambda k: F.get_json_object("m", f"$.{k}").alias(k)
    return _part(s, d).select("p_partkey", m.alias("m")).select("p_partkey", at("size"), at("of"), at("name"), at("list"), F.schema_of_variant(F.parse_json("m")).alias("types"))


def json_texts(s, d):
    """J-1, J-2: objects as indented text; lists of flat objects are tables"""
    a = F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand"), F.array("p_size", "p_partkey").alias("list")).alias("of")))
    flat = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array(F.struct("p_size", "p_name")))).otherwise(F.to_json(F.array(F.struct("p_size", F.struct("p_name").alias("o")))))
    return _part(s, d).select("p_partkey", structured.as_text(a).alias("text"), structured.is_flat(flat).alias("flat"))


def tagged_replies(s, d):
    """J-5, ST-5: text, reasoning and calls of a tagged reply; malformed calls stay with their error"""
    k, n = F.col("p_partkey"), F.col("p_name")
    call = F.when(k % 3 == 0, F.concat(F.lit('{"name": "find", "arguments": {"id": '), k, F.lit("}}"))).when(k % 3 == 1, F.concat(F.lit("<function=find><parameter=name>"), n, F.lit("</parameter></function>"))).otherwise(F.lit('{"name": '))
    reply = F.concat(F.lit("<think>size "), "p_size", F.lit("</think>It is "), n, F.lit(".<tool_call>"), call, F.lit("</tool_call><tool_response>x</tool_response> ignored"))
    t = assistant.tagged(reply)
    return _part(s, d).select("p_partkey", t.alias("t")).select("p_partkey", "t.text", "t.reasoning", F.col("t.calls")[0]["name"].alias("name"), F.when(F.col("t.calls")[0]["error"].isNull(), F.col("t.calls")[0]["input"]).alias("input"), F.col("t.calls")[0]["error"].isNotNull().alias("failed"))


def tool_calls(s, d):
    """U-1: a tool over inputs, validated against its schema"""
    from pyspark.sql import types as T

    double = agent.Tool("double", T.StructType().add("n", T.LongType(), False).add("by", T.LongType()), lambda i: {"out": i["n"] * (i.get("by") or 2)})
    k = F.col("p_partkey")
    given = F.when(k % 4 == 0, F.concat(F.lit('{"n":'), k, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"n":'), k, F.lit(',"by":3}'))).when(k % 4 == 2, F.lit('{"n":"x"}')).otherwise(F.lit("{"))
    return _part(s, d).select("p_partkey", double.column()(given).alias("r")).select("p_partkey", "r.failed", F.when(~F.col("r.failed"), F.get_json_object("r.output", "$.out").cast("bigint")).alias("out"))


def json_lines(s, d):
    """S-26: streams of newline-delimited JSON and of server-sent events"""
    k = F.col("p_partkey").cast("string")
    nd = F.concat(F.lit('{"k":'), k, F.lit('}\r\n\n{"k": '), F.lit("broken\n"), F.lit('{"k":'), (F.col("p_partkey") + 1).cast("string"), F.lit("}"))
    sse = F.concat(F.lit("event: a\ndata: one "), k, F.lit("\ndata: two\n\n: comment\n\ndata: [DONE]\n\n"))
    return _part(s, d).select("p_partkey", F.transform(glyphs.ndjson_lines(nd), lambda v: F.try_variant_get(v, "$.k", "bigint")).alias("ks"), F.array_join(glyphs.event_data(sse), "|").alias("data"))


def url_places(s, d):
    """F-19, F-20: loopback, private and remote hosts, and origins"""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    url = _pick(k, [F.concat(F.lit("http://127.0.0."), n(256), F.lit(":8080/")), F.concat(F.lit("https://172."), n(64), F.lit(".0.1/x")), F.concat(F.lit("http://user@192.168."), n(256), F.lit(".1")), F.concat(F.lit("https://printer"), n(9), F.lit(".local/")), F.concat(F.lit("https://a"), n(9), F.lit(".example.com/p")), F.concat(F.lit("wss://[fe80::"), n(10), F.lit("]:1/")), F.concat(F.lit("notes/"), n(9))])
    place = detectors.locality(url)
    return _part(s, d).select("p_partkey", place.alias("place"), detectors.allowed(place, "local-network").alias("allowed"), detectors.widest(place, F.lit("local-network")).alias("widest"), detectors.matches_origin("https://*.example.com", url).alias("matches"))


ERRORS = ("QuotaExceeded: no space left", "CUDA out of memory", "no suitable adapter", "Failed to fetch", "status code 503", "something else", "device was lost")


def load_errors(s, d):
    """F-24"""
    return _order(s, d).select("o_orderkey", detectors.load_error(_pick(F.col("o_orderkey"), _lits(*ERRORS))).alias("reason"))


SQLS = ("select 'drop table x'", "select 1 -- delete", "delete from t", "/* update */ select 2", "insert into t values (1)", "select $$ truncate $$", "with x as (select 1) select * from x")


def mutations(s, d):
    """F-17: statements that change something, told apart from words in comments and literals"""
    changing = F.udf(lambda q: detectors.is_mutation(q), "boolean")
    few = s.createDataFrame([(i, q) for i, q in enumerate(SQLS)], "k int, q string").select("k", changing("q").alias("changes"))
    return _order(s, d).withColumn("k", (F.col("o_orderkey") % len(SQLS)).cast("int")).join(few, "k").select("o_orderkey", "changes")


def sensitive_columns(s, d):
    """F-16"""
    c = table(s, d, "table_files").select("table_id", F.posexplode("columns").alias("column_no", "name"))
    return c.select("table_id", "column_no", F.coalesce(F.col("name").rlike(f"(?i){detectors.SENSITIVE.pattern}"), F.lit(False)).alias("sensitive"))


def line_kinds(s, d):
    """F-22"""
    k = F.col("p_partkey")
    line = _pick(k, [F.concat(F.lit("Page "), "p_size", F.lit(" of 60")), F.concat(F.lit("- "), "p_size", F.lit(" -")), F.concat(F.lit("• "), "p_name"), F.concat(F.lit("- "), "p_name"), F.concat("p_name", F.lit(" 7")), F.col("p_size").cast("string")])
    return _part(s, d).select("p_partkey", detectors.is_page_number(line).alias("page_number"), line.rlike(detectors.BULLET).alias("bullet"))


def anchors(s, d):
    """K-4: fragments into sheets, pages and slides"""
    k = F.col("p_partkey")
    only = lambda i, v: F.when(k % 3 == i, v)
    place = {"sheet": only(0, F.concat(F.lit("Sheet "), "p_size")), "range": only(0, F.concat(F.lit("A1:"), chunking.column_letter(k + 1), F.lit("9"))), "page": only(1, k), "slide": only(2, F.col("p_size"))}
    return _part(s, d).select("p_partkey", chunking.anchor_fragment(place).alias("fragment"))


def context_budgets(s, d):
    """T-30"""
    return _part(s, d).select("p_partkey", assistant.budget(F.col("p_size") * 200, F.lit(512), F.col("p_partkey") % 1000).alias("chars"))


def silences(s, d):
    """T-31, T-32: the mean of two channels, and whether it is silent"""
    left = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("p_size") - 25 + i) / 10000.0)
    right = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("p_size") - 25) / 5000.0)
    m = windows.mono(left, right)
    return _part(s, d).select("p_partkey", F.round(m[2], 9).alias("third"), windows.is_silent(m).alias("silent"))


def stitched_recordings(s, d):
    """ST-2, T-27, J-23: a timeline cut into windows, with a segment torn at a window's end, comes out as it was"""
    p = _part(s, d).select(F.col("p_partkey").cast("string").alias("audio_id"), (F.col("p_size") % 25 + 1).alias("n"))
    said = lambda i: F.concat(F.lit("recording "), "audio_id", F.lit(" says line "), i.cast("string"), F.lit(" of many"))
    segment = lambda i, z, t: F.struct((i * 4.0).alias("start"), z.alias("end"), t.alias("text"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") * 4 - 30) / 25)).cast("int")

    def window(w):
        a = w * 25.0
        own = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i * 4 < a + 30) & (i * 4 + 4 > a))
        # what runs over the window's end is heard in part; what began before it is heard from its start on
        return F.transform(own, lambda i: segment(i, F.least(i * 4.0 + 4, a + 30), F.when(i * 4.0 + 4 > a + 30, F.lit("recording")).otherwise(said(i))))

    w = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * 25.0).alias("start"), F.least(k * 25.0 + 30, F.col("n") * 4.0).alias("end"), window(k).alias("segments")))
    return windows.stitched(p.select("audio_id", F.explode(w).alias("w")).select("audio_id", "w.*")).select("audio_id", "start", "end", "text")


def clamped(s, d):
    """ST-3: outputs of windows as segments within them"""
    k = F.col("p_size")
    chunk = lambda a, z, t: F.struct(a.cast("double").alias("from"), z.cast("double").alias("to"), t.alias("text"))
    some = F.array(chunk(k * 0.5 - 5, k * 0.5, F.lit(" one ")), chunk(F.lit(None), F.lit(None), F.lit("two")), chunk(F.lit(1), F.lit(2), F.lit(" ")))
    out = _part(s, d).select(F.col("p_partkey").cast("string").alias("audio_id"), (F.col("p_partkey") * 25.0).alias("offset"), F.lit(20.0).alias("duration"), F.lit("whole").alias("text"), F.when(F.col("p_partkey") % 2 == 0, some).otherwise(F.array().cast("array<struct<from:double,to:double,text:string>>")).alias("chunks"))
    return windows.clamped_segments(out).drop("offset")


def transcribed_parts(s, d):
    """ST-4: recordings in windows, the silent ones skipped"""
    import pandas as pd

    loud = F.when(F.col("p_partkey") % 3 == 0, 0.001).otherwise(0.5)
    audio = _part(s, d).select(F.col("p_partkey").cast("string").alias("audio_id"), F.transform(F.sequence(F.lit(1), F.col("p_size") * 10), lambda i: F.when(i <= 300, F.lit(0.5)).otherwise(loud)).alias("samples"))

    def recognize(frames):
        for f in frames:
            yield f.assign(text=["at %d" % o for o in f.offset], chunks=[[{"from": 6.0, "to": 20.0, "text": "at %d" % o}] if z > 6 else [] for o, z in zip(f.offset, f.duration)]).drop(columns="samples") if len(f) else pd.DataFrame(columns=["audio_id", "offset", "duration", "text", "chunks"])

    return windows.transcribed(audio, recognize, rate=10).select("audio_id", "start", "end", "text")


def condensed_documents(s, d):
    """P-8, P-15: passages that do not fit are read in batches, and notes merged until they do; the first model fails"""

    def broken(texts):
        raise RuntimeError("not reachable")

    first = lambda n: condense.fallback(broken, lambda texts: texts.str.slice(0, n))
    c = table(s, d, "chunks").where("document_id is not null and content is not null").groupBy(F.col("document_id").alias("doc"), F.col("ordinal").alias("n")).agg(F.min("content").alias("content"))
    out = condense.condensed(c.withColumn("title", F.lit(None).cast("string")), lambda what, t: first(600 if what == "notes" else 300)(t), 2000)
    return out.select("doc", "kind", (F.length("text") <= 2000).alias("fits"))


_HASH = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(w, ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_DOCS = "(select * from (select *, row_number() over (partition by id order by received_at desc) as rn from ingest_documents where id is not null) where rn = 1)"
_CLAIMED = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in CLAIMS) + "]"


def _mul(a: str, b: str) -> str:
    return f"((({a})::hugeint * ({b})::hugeint) & 4294967295::hugeint)"


SQL: dict[str, str] = {
    "stated_numbers": "select l_orderkey, l_linenumber, l_partkey, [round(l_extendedprice, 2), l_quantity, -1000.0 * l_linenumber] as numbers, abs(l_quantity - 20) < 0.01 or abs(round(l_extendedprice, 2) - 20) < 0.01 as near from lineitem",
    "stated_counts": "select p_partkey, p_size % 13 = 3 as three from part",
    "claims": f"""select o_orderkey, o_orderkey % 8 in (0, 1, 2, 3) as claims, o_orderkey % 8 not in (0, 1, 3, 6, 7) as qualified, o_orderkey // 8 % 4 in (0, 2, 3) as promises from orders where len({_CLAIMED}) = 8""",
    "matched_parts": "select p_partkey, p_name from part where (p_name ilike '%ring%' or p_name like 'large %') and p_name not ilike '%blue%' and length(p_name) <= 11",
    "repeated_sentences": "select p_partkey from part where p_size % 7 >= 4",
    "query_prefixes": "select doc_id, 'task: ' || ['search result', 'question answering', 'fact checking', 'code retrieval', 'classification', 'clustering', 'sentence similarity', 'search result'][doc_id % 8 + 1] || ' | query: ' as prefix from documents",
    "truncated_texts": r"select doc_id, sha256(case when length(text) <= 100 then text else text[1:100] || chr(10) || '…[truncated ' || (length(text) - 100) || ' chars]' end) as cut_hash, trim(regexp_replace(title, '\s+', ' ', 'g')) as title from documents",
    "header_columns": """with c as (select table_id, unnest(range(len(columns)))::int as column_no, unnest(columns) as h from table_files),
        n as (select table_id, column_no, coalesce(nullif(trim(h), ''), 'column_' || (column_no + 1)) as name from c),
        r as (select *, row_number() over (partition by table_id, lower(name) order by column_no) as k from n) select table_id, column_no, name || case when k > 1 then ' ' || k else '' end as name from r""",
    "chunk_bounds": f"""with o as (select id, regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\\s\\x{{feff}}\\x{{a0}}]+|[\\s\\x{{feff}}\\x{{a0}}]+$', '', 'g') as t from {_DOCS} where content is not null)
        select id, length(t) <= 1200 as single, case when length(t) <= 1200 then sha256(t) end as hash, true as fits, true as begins, true as ends from o where t <> ''""",
    "hashed_titles": f"""with w as (select doc_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as w from documents where title is not null),
        h as (select w, {_HASH} as h from (select distinct w from w)), b as (select w, (abs(case when h >= 2147483648 then h - 4294967296 else h end) % 64)::int as dim from h),
        n as (select doc_id, dim, count(*)::double as n from w join b using (w) group by all)
        select doc_id, dim, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from n""",
    "sigmoids": "select event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) as p, round(sqrt(value * value + 9), 9) as length from events",
    "random_numbers": f"""with a as (select o_orderkey, ((42 + (o_orderkey + 1)::hugeint * 1831565813) & 4294967295::hugeint) as a from orders),
        t as (select o_orderkey, {_mul('xor(a, a >> 15)', 'a | 1')} as t from a),
        u as (select o_orderkey, xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) & 4294967295::hugeint) as t from t)
        select o_orderkey, round(xor(t, t >> 14)::double / 4294967296, 12) as x from u""",
    "stamps": "select o_orderkey, try_cast('2023-' || lpad((o_orderkey % 14)::varchar, 2, '0') || '-' || lpad((o_custkey % 33)::varchar, 2, '0') as date) is not null as valid, strftime(o_orderdate + to_microseconds(o_custkey * 125000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as stamp from orders",
    "merged_objects": """select p_partkey, p_size::varchar as size, '{"brand":"' || p_brand || '"}' as "of", (p_size > 20)::varchar as name, '[' || p_size || ']' as list, 'OBJECT<list: ARRAY<BIGINT>, name: BOOLEAN, of: OBJECT<brand: STRING>, size: BIGINT>' as types from part""",
    "json_texts": "select p_partkey, 'size: ' || p_size || chr(10) || 'of:' || chr(10) || '  brand: ' || p_brand || chr(10) || '  list:' || chr(10) || '    - ' || p_size || chr(10) || '    - ' || p_partkey as text, p_partkey % 2 = 0 as flat from part",
    "tagged_replies": """select p_partkey, 'It is ' || p_name || '.' as text, 'size ' || p_size as reasoning, case when p_partkey % 3 < 2 then 'find' end as name,
        case p_partkey % 3 when 0 then '{"id": ' || p_partkey || '}' when 1 then '{"name": "' || p_name || '"}' end as input, p_partkey % 3 = 2 as failed from part""",
    "tool_calls": "select p_partkey, p_partkey % 4 > 1 as failed, case p_partkey % 4 when 0 then p_partkey * 2 when 1 then p_partkey * 3 end as out from part",
    "json_lines": "select p_partkey, [p_partkey, p_partkey + 1] as ks, 'one ' || p_partkey || chr(10) || 'two|[DONE]' as data from part",
    "url_places": """with p as (select p_partkey, p_partkey % 7 as i, case p_partkey % 7 when 0 then 'device' when 1 then case when p_partkey % 64 between 16 and 31 then 'local-network' else 'remote' end when 2 then 'local-network' when 3 then 'local-network' when 4 then 'remote' when 5 then 'local-network' else 'device' end as place from part)
        select p_partkey, place, place <> 'remote' as allowed, case when place = 'remote' then 'remote' else 'local-network' end as widest, i = 4 as matches from p""",
    "load_errors": "select o_orderkey, ['storage', 'gpu-memory', 'webgpu', 'network', 'network', 'unknown', 'gpu-memory'][o_orderkey % 7 + 1] as reason from orders",
    "mutations": "select o_orderkey, o_orderkey % 7 in (2, 4) as changes from orders",
    "sensitive_columns": "select table_id, unnest(range(len(columns)))::int as column_no, coalesce(regexp_matches(unnest(columns), '(?i)pass|secret|token|key|hash|email|phone|ssn|card|iban'), false) as sensitive from table_files",
    "line_kinds": "select p_partkey, p_partkey % 6 in (0, 1, 5) as page_number, p_partkey % 6 in (1, 2, 3) as bullet from part",
    "anchors": """with l as (select *, p_partkey as n from part), c as (select *, case when n < 26 then chr((65 + n)::int) when n < 702 then chr((64 + n // 26)::int) || chr((65 + n % 26)::int) else chr((65 + ((n // 26 - 1) // 26 - 1) % 26)::int) || chr((65 + (n // 26 - 1) % 26)::int) || chr((65 + n % 26)::int) end as col from l)
        select p_partkey, case p_partkey % 3 when 0 then 'sheet=Sheet%20' || p_size || '&range=A1:' || col || '9' when 1 then 'page=' || p_partkey else 'slide=' || p_size end as fragment from c""",
    "context_budgets": "select p_partkey, greatest(1500, floor((p_size * 200 - 512) * 3.2 - p_partkey % 1000))::bigint as chars from part",
    "silences": "select p_partkey, round(((p_size - 23) / 10000.0 + (p_size - 25) / 5000.0) / 2, 9) as third, greatest(abs((p_size - 25) / 10000.0 + (p_size - 25) / 5000.0), abs((p_size - 22) / 10000.0 + (p_size - 25) / 5000.0)) / 2 <= 0.005 as silent from part",
    "stitched_recordings": "select p_partkey::varchar as audio_id, i * 4.0::double as start, i * 4.0::double + 4 as end, 'recording ' || p_partkey || ' says line ' || i || ' of many' as text from (select p_partkey, unnest(range(p_size % 25 + 1)) as i from part)",
    "clamped": """with e as (select p_partkey, least(greatest(p_size * 0.5 - 5, 0), 20) as a, least(p_size * 0.5, 20) as z from part)
        select p_partkey::varchar as audio_id, (p_partkey * 25 + a)::double as start, (p_partkey * 25 + greatest(z, a))::double as end, 'one' as text from e where p_partkey % 2 = 0
        union all select p_partkey::varchar, (p_partkey * 25)::double, (p_partkey * 25 + 20)::double, case when p_partkey % 2 = 0 then 'two' else 'whole' end from part""",
    "transcribed_parts": """with w as (select p_partkey, p_size::double as n, unnest(range(greatest(1, ceil((p_size - 30) / 25)::bigint + 1))) * 25.0 as o from part), x as (select *, least(30, n - o) as z, lead(o) over (partition by p_partkey order by o) as f from w)
        select p_partkey::varchar as audio_id, (o + case when z > 6 then 6 else 0 end)::double as start, (o + case when z > 6 then least(20, z) else z end)::double as end, 'at ' || o::int as text from x where (p_partkey % 3 <> 0 or o < 30)""",
    "condensed_documents": "with c as (select document_id, ordinal, length(min(content)) + max(length('[' || ordinal || ']')) + 1 as n from chunks where document_id is not null and content is not null group by all) select document_id as doc, case when sum(n + 2) - 2 <= 2000 then 'sources' else 'notes' end as kind, true as fits from c group by 1",
}
QUERIES = [
    stated_numbers, stated_counts, claims, matched_parts, repeated_sentences, query_prefixes, truncated_texts, header_columns, chunk_bounds, hashed_titles, sigmoids, random_numbers, stamps, merged_objects,
    json_texts, tagged_replies, tool_calls, json_lines, url_places, load_errors, mutations, sensitive_columns, line_kinds, anchors, context_budgets, silences, stitched_recordings, clamped, transcribed_parts, condensed_documents,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
