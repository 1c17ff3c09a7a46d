"""Running and grading of cases, retrieval metrics, pass rates, report comparison, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsql.functions.numeric import half_up, percentiles, wilson
from docsql.runtime import cut


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, reciprocal_rank, ndcg per query of `relevant` (query_id, doc_id) for ranked (query_id, doc_id, rank).

    A document's rank is that of its first chunk, counted among documents; only the first k count.
    """
    wanted = relevant.select("query_id", "doc_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    return ranked_metrics(ranked, wanted, total, k)


def label_metrics(ranked: DataFrame, queries: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """The same where all documents of a query's label are relevant: queries (query_id, label), labels (doc_id, label).

    Labels are counted, and only the ranked documents are looked up; the relevant pairs are never made.
    """
    size = labels.groupBy("label").agg(F.count_distinct("doc_id").alias("total"))
    total = queries.join(size, "label").select("query_id", "total")
    wanted = ranked.select("query_id", "doc_id").distinct().join(queries.select("query_id", "label"), "query_id").join(labels.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_semi").select("query_id", "doc_id")
    return ranked_metrics(ranked, wanted, total, k)


def ranked_metrics(ranked: DataFrame, wanted: DataFrame, total: DataFrame, k: int) -> DataFrame:
    docs = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    docs = docs.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "doc_id"))).where(F.col("pos") <= k)
    hit = docs.join(wanted, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("pos").alias("first"), F.sum(1 / F.log2(F.col("pos") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = total.join(hit, "query_id", "left")
    return both.select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def pass_rates(results: DataFrame, by: str, passed: str) -> DataFrame:
    """by, total, passed, rate, low, high: pass rates with their Wilson intervals."""
    g = results.groupBy(by).agg(F.count(passed).alias("total"), F.sum(F.col(passed).cast("int")).cast("bigint").alias("passed"))
    low, high = wilson(F.col("passed"), F.col("total"))
    return g.select(by, "total", "passed", (F.col("passed") / F.nullif("total", F.lit(0))).alias("rate"), low.alias("low"), high.alias("high"))


def repeats(results: DataFrame, case: str, passed: str) -> DataFrame:
    """cases, always, ever: cases, those that passed in all repeats, those that passed in any."""
    per = results.groupBy(case).agg(F.bool_and(passed).alias("a"), F.bool_or(passed).alias("o"))
    return per.agg(F.count("*").alias("cases"), F.count_if("a").alias("always"), F.count_if("o").alias("ever"))


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change, significant: rates of two reports; a change is significant when the intervals do not meet."""
    a, b = before.alias("a"), after.alias("b")
    apart = (F.col("b.low") > F.col("a.high")) | (F.col("b.high") < F.col("a.low"))
    return a.join(b, key).select(key, F.col("a.rate").alias("before"), F.col("b.rate").alias("after"), (F.col("b.rate") - F.col("a.rate")).alias("change"), apart.alias("significant"))


def latency(results: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, p50, p90, with percentiles by index."""
    mean = results.groupBy(by).agg(F.avg(value).alias("mean"))
    return mean.join(percentiles(results, [by], value, {"p50": 0.5, "p90": 0.9}), by, "left")


def relevance_floor(scores: DataFrame, similarity: str, on_topic: str, share: float = 0.03) -> DataFrame:
    """floor, kept, silenced: the floor that keeps all but `share` of the on-topic scores, and what it does to both kinds."""
    good = scores.where(F.col(on_topic)).select(similarity)
    floor = percentiles(good, [], similarity, {"floor": share}).select(half_up(F.col("floor"), 2).alias("floor"))
    marked = scores.crossJoin(F.broadcast(floor))  # one row
    return marked.groupBy("floor").agg(F.count_if(F.col(on_topic) & (F.col(similarity) >= F.col("floor"))).alias("kept"), F.count_if(~F.col(on_topic) & (F.col(similarity) < F.col("floor"))).alias("silenced"))


# -- cases and runs -------------------------------------------------------------------------------------------------------
def selected(cases: DataFrame, tags: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Cases (name, tags, defined) that have any of the tags, with `place`: the listed ones first, in that order, the rest as defined."""
    kept = cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>"))) if tags else cases
    listed = F.array_position(F.array(*map(F.lit, first or [""])), F.col("name"))
    return kept.withColumn("place", F.struct(F.when(listed > 0, listed).otherwise(F.lit(2**31)).alias("listed"), "defined"))


def graded_turns(turns: DataFrame) -> DataFrame:
    """turns with `failures` and `passed`.

    turns: used (tools), required, forbidden (array<string>), no_tools (boolean), answer, expects, rejects (array<string>, found in
    any case), steps, most_steps, error. Null expectations ask for nothing.
    """
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(F.col(c), none)
    said = F.lower(F.coalesce("answer", F.lit("")))
    told = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), x))
    failures = F.concat(
        F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("error: "), "error"))).otherwise(none),
        told("missing tool ", F.array_except(texts("required"), texts("used"))),
        told("forbidden tool ", F.array_intersect(texts("forbidden"), texts("used"))),
        F.when(F.coalesce("no_tools", F.lit(False)) & (F.size(texts("used")) > 0), F.array(F.lit("tools were used"))).otherwise(none),
        told("not said: ", F.filter(texts("expects"), lambda x: ~F.contains(said, F.lower(x)))),
        told("said: ", F.filter(texts("rejects"), lambda x: F.contains(said, F.lower(x)))),
        F.when(F.col("steps") > F.col("most_steps"), F.array(F.format_string("%d steps, %d allowed", F.col("steps").cast("bigint"), F.col("most_steps").cast("bigint")))).otherwise(none),
    )
    return turns.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def case_results(turns: DataFrame) -> DataFrame:
    """name, repeat, tags, place, passed, failures, steps, duration_ms, tool_errors, output_tokens, prefill_tokens, reuse of the graded turns of each run.

    A run passes when it has graded turns and all of them pass. Turns behind one with an error are not part of a run.
    """
    stop = turns.where("error is not null").groupBy("name", "repeat").agg(F.min("turn").alias("__stop"))
    part = turns.join(stop, ["name", "repeat"], "left").where("__stop is null or turn <= __stop")
    told = F.transform(F.col("failures"), lambda x: F.concat(F.lit("turn "), (F.col("turn") + 1).cast("string"), F.lit(": "), x))
    graded = F.col("graded")
    of = lambda c: F.coalesce(F.sum(F.when(graded, F.col(c))), F.lit(0)).alias(c)
    return part.groupBy("name", "repeat").agg(
        F.first("tags").alias("tags"), F.first("place").alias("place"),
        (F.coalesce(F.bool_and(F.when(graded, F.col("passed"))), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False))).alias("passed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(graded, F.struct("turn", told.alias("f"))))), lambda x: x["f"])).alias("failures"),  # of one run
        of("steps"), of("duration_ms"), of("tool_errors"), of("output_tokens"), of("prefill_tokens"), F.avg(F.when(graded, F.col("reuse"))).alias("reuse"),
    )


def until_stopped(results: DataFrame, fail_fast: bool = False, most_failures: int | None = None) -> DataFrame:
    """Results up to the run at which a run in order would have stopped: at the first failure, or at one more than most_failures."""
    if not fail_fast and most_failures is None:
        return results
    allowed = 0 if fail_fast else most_failures
    order = F.struct("place", "repeat")
    last = results.where(~F.col("passed")).select(order.alias("at")).orderBy("at").limit(allowed + 1).agg(F.max("at").alias("at"), F.count("*").alias("n"))
    return results.crossJoin(F.broadcast(last)).where((F.col("n") <= allowed) | (order <= F.col("at"))).drop("at", "n")  # one row


def run_cases(cases: DataFrame, answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], answers: str, repeats: int = 1, tags: list[str] | None = None, first: list[str] | None = None, fail_fast: bool = False, most_failures: int | None = None) -> DataFrame:
    """Results of cases (name, tags, defined, turn, graded, input and what graded_turns() asks for), each run `repeats` times.

    answer: frames of turns to frames with the columns `answers`, as mapInPandas takes it, which must give name, repeat and turn
    back; all turns of a run come to one call, in order. Runs are independent; stopping early is a cut of their results.
    """
    runs = selected(cases, tags, first).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    laid = runs.select("name", "repeat", "turn", "input").repartition("name", "repeat").sortWithinPartitions("name", "repeat", "turn")
    turns = runs.join(cut(laid.mapInPandas(answer, answers), "answers"), ["name", "repeat", "turn"])
    return until_stopped(case_results(graded_turns(turns)), fail_fast, most_failures)


# -- reports --------------------------------------------------------------------------------------------------------------
def _rate(passed: Column, total: Column, prefix: str = "") -> list[Column]:
    low, high = wilson(passed, total)
    return [F.coalesce(passed / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(f"{prefix}rate"), low.alias(f"{prefix}low"), high.alias(f"{prefix}high")]


def overall(results: DataFrame) -> DataFrame:
    """One row: runs and passed with rate, low, high; cases with those of all and of any repeats; means of time and tokens; share of tool errors; reuse."""
    cases = results.groupBy("name").agg(F.bool_and("passed").alias("all"), F.bool_or("passed").alias("any")).agg(F.count("*").alias("cases"), F.count_if("all").alias("always"), F.count_if("any").alias("ever"))
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("bigint")
    runs = results.agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"), mean("duration_ms").alias("mean_ms"), mean("output_tokens").alias("mean_output"), mean("prefill_tokens").alias("mean_prefill"), (F.sum("tool_errors") / F.greatest(F.sum("steps"), F.lit(1))).alias("tool_error_rate"), F.avg("reuse").alias("reuse"))
    both = runs.crossJoin(F.broadcast(cases))  # one row each
    return both.select("*", *_rate(F.col("passed"), F.col("runs")), *_rate(F.col("always"), F.col("cases"), "always_"), *_rate(F.col("ever"), F.col("cases"), "ever_"))


def by_tag(results: DataFrame) -> DataFrame:
    """tag, total, passed, rate, low, high."""
    return pass_rates(results.select("passed", F.explode(F.array_distinct("tags")).alias("tag")), "tag", "passed")


def later_turns(turns: DataFrame) -> DataFrame:
    """One row over the graded turns behind the first of their run: count, rate, first_token_p50, mean_prefill, mean_prompt, reuse; none without such turns."""
    later = turns.where("graded and turn > 0")
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("bigint")
    g = later.agg(F.count("*").alias("count"), (F.count_if("passed") / F.nullif(F.count("*"), F.lit(0))).alias("rate"), mean("prefill_tokens").alias("mean_prefill"), mean("prompt_chars").alias("mean_prompt"), F.avg("reuse").alias("reuse")).where("count > 0")
    return g.crossJoin(F.broadcast(percentiles(later, [], "first_token_ms", {"first_token_p50": 0.5})))  # one row each


def report_lines(per_case: DataFrame) -> DataFrame:
    """name, line of cases (name, passed, runs, mean_ms, failures): a mark, the name, its rate, its time and what failed."""
    rate = F.col("passed") / F.col("runs")
    mark = F.when(rate == 1, "✓").when(rate == 0, "✗").otherwise("~")
    failed = F.when(F.size("failures") > 0, F.concat(F.lit("  "), F.array_join("failures", "; "))).otherwise("")
    return per_case.select("name", F.concat(F.lit("  "), mark, F.lit(" "), F.format_string("%-32s %4s  %.1fs", F.col("name"), F.concat(F.floor(rate * 100 + 0.5).cast("string"), F.lit("%")), F.col("mean_ms") / 1000.0), failed).alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one folder."""
    report.write.mode("overwrite").json(path)
