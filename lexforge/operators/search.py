"""Similarity search: keywords to documents, documents to words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def query_vector(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, weight): 1/m at each of the m matching terms, 0 elsewhere; NaN everywhere if none matches."""
    hit = terms.select(F.col("word").alias("term")).distinct().join(keywords.select(F.col("word").alias("term"), F.lit(1).alias("hit")).distinct(), "term", "left")
    m = hit.agg(F.count("hit").alias("m"))
    return hit.join(F.broadcast(m)).select("term", F.when(F.col("m") == 0, float("nan")).when(F.col("hit").isNotNull(), F.try_divide(F.lit(1.0), "m")).otherwise(0.0).alias("weight"))


def fold_in(query: DataFrame, u: DataFrame, singular: DataFrame) -> DataFrame:
    """(k, q): a query in the latent space, q^T U S^-1. ``query``: term, weight; ``u``: word, k, x; ``singular``: k, s; a singular value of 0 gives NaN."""
    dot = query.join(u, query["term"] == u["word"]).groupBy("k").agg(F.sum(F.col("weight") * F.col("x")).alias("d"))
    return dot.join(singular, "k").select("k", F.when(F.col("s") == 0, float("nan")).otherwise(F.try_divide("d", "s")).alias("q"))


def _search(matrix: DataFrame, keys: DataFrame, match: str, item: str, cell: str, on_no_match: str) -> DataFrame:
    """Score of each item: sum over matched cells / (sqrt(m) * norm), one aggregate over the matrix."""
    k = keys.select(F.col(keys.columns[0]).alias(match), F.lit(1).alias("hit")).distinct()
    m = matrix.select(match).distinct().join(k, match).agg(F.count("*").alias("m"))
    flagged = matrix.join(k, match, "left")  # Spark broadcasts the keys if they are few
    sums = flagged.groupBy(F.col(item).alias("item")).agg(F.sum(F.when(F.col("hit").isNotNull(), F.abs(cell)).otherwise(0.0)).alias("hits"), F.sqrt(F.sum(F.col(cell) * F.col(cell))).alias("norm"))
    score = F.when((F.col("m") == 0) | (F.col("norm") == 0), float("nan")).otherwise(F.try_divide(F.col("hits"), F.sqrt("m") * F.col("norm")))
    out = sums.join(F.broadcast(m)).select("item", score.alias("score")).where(F.isnan("score") | (F.col("score") > EPS))
    return out if on_no_match == "all" else out.where(~F.isnan("score"))


def search_docs(matrix: DataFrame, keywords: DataFrame, cell: str = "w", on_no_match: str = "all") -> DataFrame:
    """(item, score) of the documents like the keywords. Keywords that match nothing score NaN and return everything, unless ``on_no_match`` is "empty"."""
    return _search(matrix, keywords, "word", "doc", cell, on_no_match)


def search_words(matrix: DataFrame, docs: DataFrame, cell: str = "w", on_no_match: str = "all") -> DataFrame:
    """(item, score) of the words like the documents."""
    return _search(matrix, docs, "doc", "word", cell, on_no_match)


def result(found: DataFrame, k: int | None = None) -> DataFrame:
    """By falling score (NaN first), equal ones by falling name."""
    out = found.orderBy(F.desc("score"), F.desc("item"))
    return out if k is None else out.limit(k)


def cross_similarity(queries: DataFrame, rows: DataFrame, kind: str = "abs_cosine", block: int = 2000) -> DataFrame:
    """(i, j, sim) of each query vector with each row vector. ``queries``, ``rows``: id, vec.

    The stated queries pass in blocks of at most ``block`` to the tasks; rows are never shuffled.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r["id"] for r in part], np.array([r["vec"] for r in part], "f8")))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                for at in range(0, len(pdf) if len(ids) else 0, 128):
                    x = np.stack([np.asarray(v, "f8") for v in pdf["vec"].iloc[at : at + 128]])
                    if kind == "max_product":
                        top = np.stack([np.abs(x * v).max(1) for v in q])
                    else:
                        top = np.abs(q) @ np.abs(x).T if kind == "abs_cosine" else q @ x.T
                    with np.errstate(all="ignore"):
                        s = top / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                    n = s.shape[1]
                    yield pd.DataFrame({"i": np.repeat(ids, n), "j": np.tile(pdf["id"].iloc[at : at + 128].to_numpy(), len(ids)), "sim": s.reshape(-1)})

        found = rows.select("id", "vec").mapInPandas(run, "i long, j long, sim double")
        out = found if out is None else out.unionByName(found)
    return out
