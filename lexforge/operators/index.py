"""Word-by-document index: terms, documents, postings, and matrix operations on them.

A matrix is sparse: rows (word, doc, x); what is absent is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Index:
    """The four tables of an index; ``lsi`` once it is computed, ``rows`` being its form by rows of the longer axis."""

    terms: DataFrame
    docs: DataFrame
    postings: DataFrame
    lsi: DataFrame | None = None
    rows: object = None

    def word_doc_frequency(self) -> DataFrame:
        return self.postings


def create_index(words: DataFrame) -> Index:
    """Index of (word, doc) rows: cells count how often a word was given for a document, so distinct rows make it binary."""
    held = words.where("word IS NOT NULL AND doc IS NOT NULL")
    return Index(held.select("word").distinct(), held.select("doc").distinct(), held.groupBy("word", "doc").agg(F.count("*").cast("double").alias("x")))


def doc_to_words(postings: DataFrame) -> DataFrame:
    """(doc, words): the forward index, words in order."""
    return postings.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("words"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """(word, df): documents with a cell above 0."""
    return postings.where("x > 0").groupBy("word").agg(F.count_distinct("doc").alias("df"))


def col_sums(postings: DataFrame) -> DataFrame:
    """(doc, total) of each column; a NaN cell makes it NaN."""
    return postings.groupBy("doc").agg(F.sum("x").alias("total"))


def row_sums(postings: DataFrame) -> DataFrame:
    """(word, total) of each row, NaN counted as 0."""
    return postings.groupBy("word").agg(F.sum(F.nanvl("x", F.lit(0.0))).alias("total"))


def tfidf(postings: DataFrame) -> DataFrame:
    """(word, doc, w): x * (1 + ln n - ln df), then each document's cells divided by their sum.

    df and the documents' sums are counted with partial aggregation and joined back, so a document of many words is cut like any other.
    """
    n = postings.select("doc").distinct().agg(F.count("*").alias("n"))
    df = doc_frequency(postings)
    raw = postings.join(df, "word").join(F.broadcast(n)).select("word", "doc", (F.col("x") * (1 + F.log("n") - F.log("df"))).alias("r"))
    total = raw.groupBy("doc").agg(F.sum("r").alias("total"))
    return raw.join(total, "doc").select("word", "doc", F.coalesce(F.try_divide("r", "total"), F.lit(float("nan"))).alias("w"))


def weigh(weights: DataFrame) -> DataFrame:
    """(word, score): a word's weights summed over documents."""
    return weights.groupBy("word").agg(F.sum("w").alias("score"))


def row(m: DataFrame, word: str) -> DataFrame:
    return m.where(F.col("word") == word)


def column(m: DataFrame, doc) -> DataFrame:
    return m.where(F.col("doc") == doc)


def delete_column(m: DataFrame, doc) -> DataFrame:
    return m.where(F.col("doc") != doc)


def divide(m: DataFrame, by: float) -> DataFrame:
    """Each cell divided; by 0 gives infinity or NaN."""
    if by == 0:
        x = F.when(F.col("x") > 0, float("inf")).when(F.col("x") < 0, float("-inf")).otherwise(float("nan"))
    else:
        x = F.col("x") / F.lit(float(by))
    return m.withColumn("x", x)


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("doc").alias("word"), F.col("word").alias("doc"), "x")
