"""Problem 3: most frequent items among billions.

Each partition keeps a Misra-Gries summary of at most k counters, fed by blocks:
the counts of a block are added and, if more than k remain, the (k+1)-th largest
counter is subtracted from all. Summaries are merged in the same way. Every count
is then too low by at most N/(k+1), so every item above that frequency is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shrink(counts: pd.Series, k: int) -> pd.Series:
    """At most k counters: the (k+1)-th largest is subtracted from all, what is not positive is dropped."""
    if len(counts) <= k:
        return counts
    cut = np.partition(counts.to_numpy(), len(counts) - k - 1)[len(counts) - k - 1]
    counts = counts - cut
    return counts[counts > 0]


def summarise(df: DataFrame, column: str, k: int, block: int = 100_000) -> DataFrame:
    """(item, est, n): the counters of each partition, and in a row with a null item the number n of its rows. Null values are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, held, waiting = pd.Series(dtype="int64"), 0, [], 0

        def absorb() -> pd.Series:
            v = pc.value_counts(pa.chunked_array(held))
            new = pd.Series(v.field("counts").to_numpy(), index=pd.Index(v.field("values").to_pylist(), dtype=object))
            both = new if counts.empty else counts.add(new, fill_value=0).astype("int64")
            return shrink(both, k)

        for b in batches:
            col = b.column(0).drop_null()
            rows += len(col)
            held.append(col)
            waiting += len(col)
            if waiting >= block:
                counts, held, waiting = absorb(), [], 0
        if waiting:
            counts = absorb()
        items = [*counts.index, None]
        est = np.append(counts.to_numpy("int64"), 0)
        n = np.append(np.zeros(len(counts), "int64"), rows)
        yield pa.record_batch([pa.array(items, pa.string()), pa.array(est), pa.array(n)], names=["item", "est", "n"])

    return df.select(F.col(f"`{column}`").cast("string").alias("_item")).mapInArrow(run, "item string, est long, n long")


def heavy_hitters(df: DataFrame, column: str = "element", k: int = 2000) -> DataFrame:
    """(item, est, low_by_at_most, n): the merged summary of at most k items.

    The true count lies between ``est`` and ``est + low_by_at_most``; n is the number of non-null values.
    No rows give no items; ties at the cut fall out together, as the method has it.
    """
    parts = summarise(df, column, k)
    merged = parts.groupBy("item").agg(F.sum("est").alias("est"), F.sum("n").alias("n"))
    n = merged.where("item is null").agg(F.sum("n").alias("n"))
    top = merged.where("item is not null").select("item", "est").orderBy(F.desc("est"), "item").limit(k + 1)
    cut = top.agg(F.when(F.count("*") > k, F.min("est")).otherwise(F.lit(0)).alias("cut"))
    return (
        top.join(F.broadcast(cut)).join(F.broadcast(n))
        .select("item", (F.col("est") - F.col("cut")).alias("est"), F.floor(F.col("n") / (k + 1)).alias("low_by_at_most"), "n")
        .where("est > 0")
    )


def frequent_items(df: DataFrame, column: str = "element", share: float = 0.005, k: int = 2000) -> DataFrame:
    """(item, est, cnt): every value with at least ``share`` of the non-null values of ``column``, with the summary's count and the exact one.

    The summary gives the candidates (at most k, so they are broadcast); a second pass counts only these.
    """
    if share * (k + 1) <= 1:
        raise ValueError("k must exceed 1/share, or the summary may miss items")
    found = heavy_hitters(df, column, k).where(F.col("est") + F.col("low_by_at_most") + 1 >= F.col("n") * share)
    counted = df.select(F.col(f"`{column}`").cast("string").alias("item")).join(F.broadcast(found), "item").groupBy("item").agg(F.count("*").alias("cnt"), F.max("est").alias("est"), F.max("n").alias("n"))
    return counted.where(F.col("cnt") >= F.col("n") * share).select("item", "est", "cnt")
