"""Around a conversation with tools: guarded SQL, tool calls in text, packing of notes, history, grading, memory."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions.detectors import is_mutation, looks_secret, plain_sql

CHARS_A_TOKEN, LEAST_CHARS = 3.2, 1500  # fixed values


def statements(sql: str) -> list[str]:
    """Statements of a script: parted at semicolons outside quotes and comments."""
    out, held = [], ""
    for part in re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;)", sql, flags=re.S):
        if part == ";":
            out.append(held)
            held = ""
        else:
            held += part
    return [s.strip() for s in [*out, held] if plain_sql(s).strip()]


def run_sql(spark: SparkSession, script: str, read_only: bool = True, most_rows: int = 100, internal: tuple[str, ...] = ()) -> list[dict]:
    """Columns, rows (at most most_rows, with a mark when cut) and error of each statement; it stops at the first error.

    Read-only runs refuse what is not a query: by its plan, which Spark parses before anything runs.
    """
    out = []
    for s in statements(script):
        try:
            bare = plain_sql(s)
            if any(re.search(rf"\b{re.escape(name)}\s*\.", bare, re.I) for name in internal):
                raise PermissionError("internal tables cannot be used")
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(s)
            if read_only and (is_mutation(s) or "Command" in plan.getClass().getSimpleName() or plan.getClass().getSimpleName().startswith(("Insert", "Create", "Drop", "Delete", "Update", "Merge"))):
                raise PermissionError("only queries may run")
            df = spark.sql(s)
            rows = df.limit(most_rows + 1).collect()
            out.append({"columns": df.columns, "rows": [list(r) for r in rows[:most_rows]], "truncated": len(rows) > most_rows, "error": None})
        except Exception as x:  # noqa: BLE001 - the error is the result
            out.append({"columns": [], "rows": [], "truncated": False, "error": f"{type(x).__name__}: {str(x)[:500]}"})
            break
    return out


_call_type = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "input", "error")])
TAGGED = T.StructType([T.StructField("text", T.StringType()), T.StructField("reasoning", T.StringType()), T.StructField("calls", T.ArrayType(_call_type))])


def _call(body: str) -> tuple[str | None, str | None, str | None]:
    body = body.strip()
    m = re.match(r"<function=([\w.-]+)>(.*?)(?:</function>|\Z)", body, re.S)
    if m:
        return m[1], json.dumps({k: v.strip() for k, v in re.findall(r"<parameter=([\w.-]+)>(.*?)</parameter>", m[2], re.S)}, ensure_ascii=False), None
    try:
        o = json.loads(body)
    except ValueError as x:
        return None, body, f"no JSON: {x}"
    if not isinstance(o, dict) or not isinstance(o.get("name"), str):
        return None, body, "a call needs a name"
    args = o.get("arguments", o.get("input", o.get("parameters", {})))
    return o["name"], json.dumps(args if args is not None else {}, ensure_ascii=False), None


@F.pandas_udf(TAGGED)
def tagged(text: pd.Series) -> pd.DataFrame:
    """Text, reasoning and tool calls of a tagged reply. Nothing behind a tool response counts; an open tag runs to the end."""
    rows = []
    for t in text:
        t = (t or "").split("<tool_response>", 1)[0]
        calls = [dict(zip(("name", "input", "error"), _call(b))) for b in re.findall(r"<tool_call>(.*?)(?:</tool_call>|\Z)", t, re.S)]
        bare = re.sub(r"<tool_call>.*?(?:</tool_call>|\Z)", "", t, flags=re.S)
        thought = "\n".join(x.strip() for x in re.findall(r"<think>(.*?)(?:</think>|\Z)", bare, re.S))
        rows.append((re.sub(r"<think>.*?(?:</think>|\Z)", "", bare, flags=re.S).strip(), thought, calls))
    return pd.DataFrame(rows, columns=["text", "reasoning", "calls"])


class Tagged:
    """The same on a stream of pieces: hands out text as soon as no tag can begin in it. state: text, think or call."""

    TAGS = {"text": {"<think>": "think", "<tool_call>": "call", "<tool_response>": "end"}, "think": {"</think>": "text"}, "call": {"</tool_call>": "text"}, "end": {}}

    def __init__(self) -> None:
        self.state, self.held = "text", ""

    def push(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while True:
            tags = self.TAGS[self.state]
            at = min(((self.held.find(t), t) for t in tags if t in self.held), default=None)
            if at is None:
                break
            if at[0] and self.state in ("text", "think"):
                yield self.state, self.held[: at[0]]
            if self.state == "call":
                yield "call", self.held[: at[0]]
            self.held, self.state = self.held[at[0] + len(at[1]) :], tags[at[1]]
        if self.state in ("text", "think"):
            keep = max((n for t in self.TAGS[self.state] for n in range(1, len(t)) if self.held.endswith(t[:n])), default=0)
            ready = self.held[: len(self.held) - keep]
            self.held = self.held[len(ready) :]
            if ready:
                yield self.state, ready

    def flush(self) -> Iterator[tuple[str, str]]:
        if self.held and self.state != "end":
            yield self.state, self.held
        self.held = ""


def packed(items: DataFrame, key: str, order: str, size: str, budget: int, by_longest: bool = False, joint: int = 0) -> DataFrame:
    """items with `batch`: consecutive items of a key in batches within the budget; an item over it stands alone.

    by_longest: a batch's size is its number of items times its longest. joint: what parts an item from the next, counted
    with it once it is in. One key is the unit of work; its rows stream.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, used, n, longest = None, 0, 0, 0, 0
        for f in frames:
            out = []
            for k, s in zip(f[key], f[size]):
                if k != last:
                    last, batch, used, n, longest = k, 0, 0, 0, 0
                full = (n + 1) * max(longest, s) > budget if by_longest else used + s > budget
                if n and full:
                    batch, used, n, longest = batch + 1, 0, 0, 0
                used, n, longest = used + s + joint, n + 1, max(longest, s)
                out.append(batch)
            yield f.assign(batch=pd.array(out, "Int32"))

    return items.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def budget(window: Column, reply: Column, fixed: Column) -> Column:
    """Characters left for context: the window without the reply, in characters, without what is fixed; a floor holds."""
    return F.greatest(F.lit(LEAST_CHARS), F.floor((window - reply) * CHARS_A_TOKEN - fixed))


def recent_history(turns: DataFrame, thread: str, order: list[str], most: int, chars: int, size: str) -> DataFrame:
    """The last `most` messages of each thread within `chars`, from a user message on; whole turns are left out, the last one stays.

    A thread of no more than `most` messages counts whole; one without a user message among its last ones counts from its last
    user message on, or whole if it has none.
    """
    at = F.struct(*order)
    back = Window.partitionBy(thread).orderBy(*[F.desc(c) for c in order])
    # a bounded number of rows per thread is left before anything is put in order again
    last = turns.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= most + 1)
    whole = F.max("__n").over(Window.partitionBy(thread)) <= most
    questions = F.max(F.when((F.col("role") == "user") & (F.col("__n") <= most), 1).otherwise(0)).over(Window.partitionBy(thread))
    last = last.withColumn("__whole", whole).withColumn("__asked", questions)
    late = last.where("__asked = 0 and not __whole").select(thread).distinct()
    since = turns.join(late, thread, "left_semi").groupBy(thread).agg(F.max(F.when(F.col("role") == "user", at)).alias("__u"))
    tail = turns.join(since, thread).where(F.col("__u").isNull() | (at >= F.col("__u"))).select(*turns.columns, F.lit(0).cast("bigint").alias("__turn"))
    # turns are counted from the end: 0 from the last user message on, 1 from the one before it, and so on
    later = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy(thread).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
    own = last.where((F.col("__n") <= most) & (F.col("__whole") | (F.col("__asked") > 0))).withColumn("__turn", later - F.when(F.col("role") == "user", 1).otherwise(0))
    told = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy(thread))
    own = own.withColumn("__told", told).where(F.col("__whole") | (F.col("__turn") < F.col("__told"))).select(*turns.columns, F.col("__turn").cast("bigint").alias("__turn"))
    kept = own.unionByName(tail)
    sums = kept.groupBy(thread, "__turn").agg(F.sum(size).alias("__s"))
    used = F.sum("__s").over(Window.partitionBy(thread).orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0))
    fit = sums.withColumn("__used", used).where((F.col("__used") <= chars) | (F.col("__turn") == 0))
    return kept.join(fit.select(thread, "__turn"), [thread, "__turn"], "left_semi").drop("__turn")


def shortened(history: DataFrame, thread: str, order: list[str], chars: int, size: str, most: int = 400) -> DataFrame:
    """history with its older tool results cut to `most` characters where a thread is still over `chars`; the last result stays whole."""
    total = F.sum(size).over(Window.partitionBy(thread))
    last = F.max(F.when(F.col("role") == "tool", F.struct(*order))).over(Window.partitionBy(thread))
    cut_ = (total > chars) & (F.col("role") == "tool") & (F.struct(*order) < last) & (F.length("content") > most)
    return history.withColumn("content", F.when(cut_, F.concat(F.substring("content", 1, most), F.lit("\n…[shortened to fit context]"))).otherwise(F.col("content")))


def repeated_calls(calls: DataFrame, run: str, order: str, signature: str) -> DataFrame:
    """calls with `repeated`: the same as the call before, or made more than twice in its run."""
    w = Window.partitionBy(run).orderBy(order)
    same = F.coalesce(F.lag(signature).over(w) == F.col(signature), F.lit(False))
    often = F.row_number().over(Window.partitionBy(run, signature).orderBy(order)) > 2
    return calls.withColumn("repeated", same | often)


def graded(turns: DataFrame, required: str = "required", forbidden: str = "forbidden", used: str = "used") -> DataFrame:
    """turns with `missing` and `unwanted` tools, and whether the turn passed."""
    none = F.array().cast("array<string>")
    have = F.coalesce(used, none)
    missing, unwanted = F.array_except(F.coalesce(required, none), have), F.array_intersect(F.coalesce(forbidden, none), have)
    return turns.withColumn("missing", missing).withColumn("unwanted", unwanted).withColumn("passed", (F.size(missing) == 0) & (F.size(unwanted) == 0))


def memorable(facts: DataFrame, text: str) -> DataFrame:
    """Facts that may be kept: without the blank ones and those that look like credentials."""
    return facts.where((F.trim(text) != "") & ~F.coalesce(looks_secret(F.col(text)), F.lit(True)))
