"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix_text(postings: DataFrame, doc_names: list[str]) -> DataFrame:
    """(word, D0, D1, ...): cells with four decimals, absent and NaN ones as 0."""
    grid = postings.groupBy("word").pivot("doc", doc_names).agg(F.first(F.nanvl("x", F.lit(0.0))))
    return grid.select(F.format_string("%15s", "word").alias("word"), *[F.format_string("%8.4f", F.coalesce(F.col(f"`{d}`"), F.lit(0.0))).alias(f"D{i}") for i, d in enumerate(doc_names)])


def legend(doc_names: list[str]) -> list[str]:
    return [f"{i} - {d}" for i, d in enumerate(doc_names)]


def matrix_lines(postings: DataFrame, doc_names: list[str], title: str = "") -> DataFrame:
    """(at, line): the matrix with its head and legend, line by line, for results small enough to read."""
    spark = postings.sparkSession
    names = [c for c in (f"D{i}" for i in range(len(doc_names)))]
    head = [(0, "", title + " " * 15 + "".join(f"{n:>8}" for n in names))]
    tail = [(2, f"{i:09d}", line) for i, line in enumerate(legend(doc_names))]
    body = matrix_text(postings, doc_names).select(F.lit(1).alias("part"), F.col("word").alias("key"), F.concat("word", *names).alias("line"))
    lines = spark.createDataFrame(head + tail, "part int, key string, line string").unionByName(body)
    return lines.select((F.row_number().over(Window.orderBy("part", "key")) - 1).alias("at"), "line")


def print_matrix(postings: DataFrame, doc_names: list[str], title: str = "", out=print) -> None:
    """Write the lines of the matrix."""
    for r in matrix_lines(postings, doc_names, title).orderBy("at").toLocalIterator():
        out(r["line"])


def list_text(df: DataFrame, item: str, order: str) -> DataFrame:
    """One row "[a, b]" of the items in order; for results small enough to print."""
    return df.agg(F.array_sort(F.collect_list(F.struct(order, F.col(item).cast("string").alias("i")))).alias("m")).select(F.concat(F.lit("["), F.array_join(F.transform("m", lambda s: s["i"]), ", "), F.lit("]")).alias("items"))
