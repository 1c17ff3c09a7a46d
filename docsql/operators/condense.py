"""Condensing of many passages into notes that fit a window: batches are read, notes are merged, in rounds, for all documents at once.

The model is a function from an instruction and a text Column to a Column (a pandas UDF, as a rule). Documents whose notes
fit leave the rounds; there are at most ROUNDS of them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions.text import cited_numbers
from docsql.operators.assistant import LEAST_CHARS, packed
from docsql.runtime import cut

ROUNDS = 6
CHARS_A_TOKEN, INSTRUCTION_TOKENS = 3.2, 400  # fixed values

Ask = Callable[[str, Column], Column]


def condense_budget(window: int, reply: int) -> int:
    """Characters of text that a prompt can hold beside its instruction and the answer."""
    return max(LEAST_CHARS, int((window - reply - INSTRUCTION_TOKENS) * CHARS_A_TOKEN))


def rendered(passages: DataFrame) -> DataFrame:
    """doc, n, text of passages (doc, n, title, content), as a model reads them."""
    return passages.select("doc", "n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"), F.when(F.col("title") != "", F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise(""), F.lit("\n"), "content").alias("text"))


def _batches(items: DataFrame, budget: int, between: str) -> DataFrame:
    """doc, n (number of the batch), size (its items), text: consecutive items (doc, n, text) together within the budget."""
    numbered = packed(items.withColumn("size", F.length("text")), "doc", "n", "size", budget, joint=len(between))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))  # within the budget, or one item
    return numbered.groupBy("doc", "batch").agg(F.count("*").alias("size"), F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text")).withColumnRenamed("batch", "n")


def condensed(passages: DataFrame, ask: Ask, budget: int, notes: str = "notes", merge: str = "merge") -> DataFrame:
    """doc, text, kind: what a writer gets for each doc: its passages as they are where they fit (sources), else notes.

    passages: doc, n, title, content. Notes of batches that say NONE, or nothing, are left out; merging ends when the notes fit,
    when one is left, or after ROUNDS; what is still too long is cut.
    """
    items = cut(rendered(passages), "passages")
    total = items.groupBy("doc").agg((F.sum(F.length("text") + 2) - 2).alias("size"))
    small = items.join(total.where(F.col("size") <= budget), "doc", "left_semi")
    large = items.join(total.where(F.col("size") > budget), "doc", "left_semi")
    joined = lambda rows, between: rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), between).alias("text"))
    said = _batches(large, budget, "\n\n").withColumn("text", F.trim(ask(notes, F.col("text"))))
    open_ = cut(said.where("text <> ''").where(~F.col("text").rlike(r"(?i)^NONE\.?$")).select("doc", "n", "text"), "notes")
    done = []
    for _ in range(ROUNDS):
        size = open_.groupBy("doc").agg((F.sum(F.length("text") + 1) - 1).alias("size"), F.count("*").alias("parts"))
        over = size.where((F.col("size") > budget) & (F.col("parts") > 1)).select("doc")
        done.append(open_.join(over, "doc", "left_anti"))
        left = open_.join(over, "doc", "left_semi")
        again = _batches(left, budget, "\n\n")
        open_ = cut(again.withColumn("text", F.when(F.col("size") == 1, F.col("text")).otherwise(F.trim(ask(merge, F.col("text"))))).select("doc", "n", "text"), "notes")
        if open_.isEmpty():
            break
    for d in done:
        open_ = open_.unionByName(d)
    whole = joined(open_, "\n").withColumn("text", F.substring("text", 1, budget))
    nothing = large.select("doc").distinct().join(whole.select("doc"), "doc", "left_anti").withColumn("text", F.lit(""))
    return joined(small, "\n\n").withColumn("kind", F.lit("sources")).unionByName(whole.unionByName(nothing).withColumn("kind", F.lit("notes")))


def cited_passages(written: DataFrame, passages: DataFrame) -> DataFrame:
    """doc, n of the passages that the written texts (doc, text) cite; numbers that are none are left out."""
    return written.select("doc", F.explode(cited_numbers(F.col("text"))).alias("n")).join(passages.select("doc", F.col("n").cast("int").alias("n")), ["doc", "n"], "left_semi")


def fallback(*models: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A model over texts that asks several in order: where one raises, or gives null for a text, the next is asked.

    When the last one raises, its error stands.
    """
    if not models:
        raise ValueError("no models")

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(text), index=text.index, dtype=object)
        for i, model in enumerate(models):
            left = out.isna() & text.notna()
            if not left.any():
                break
            try:
                out[left] = model(text[left])
            except Exception:  # noqa: BLE001 - the next model is asked
                if i == len(models) - 1:
                    raise
        return out

    return run
