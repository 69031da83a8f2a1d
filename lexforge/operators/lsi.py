"""Latent semantic indexing: the rank-k approximation of a word-by-document matrix.

The truncated product U_k S_k V_k^T is the matrix times P P^T, where P holds the k leading directions of
its shorter side. Up to MAX_SIDE the shorter side's Gram matrix is summed over the cluster and taken apart on
the driver; a longer one goes to the distributed SVD of MLlib. Either way the projection is a product per row
of the longer side, over the cluster; nothing as long as that side reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.storage import keep

MAX_SIDE = 3000


def rank_of(words: int, docs: int, k_from: str = "min") -> int:
    """floor(sqrt(min(words, docs))), or of the rows alone."""
    return math.isqrt(min(words, docs) if k_from == "min" else words)


def sigma(values: list[float], n: int) -> np.ndarray:
    """n x n diagonal of the singular values, padded with zeros."""
    out = np.zeros((n, n))
    m = min(n, len(values))
    out[range(m), range(m)] = values[:m]
    return out


def size(postings: DataFrame) -> tuple[int, int]:
    """Numbers of words and documents."""
    r = postings.agg(F.count_distinct("word").alias("w"), F.count_distinct("doc").alias("d")).first()
    return r["w"], r["d"]


@dataclass
class Rows:
    """The approximation by rows of the longer axis: ``rows`` (the axis, v array<double>); v follows ``names`` of the shorter one."""

    rows: DataFrame
    long: str
    short: str
    names: list
    words: int
    docs: int

    def cells(self, x: str = "x") -> DataFrame:
        """(word, doc, x) of every cell."""
        spark = self.rows.sparkSession
        names = F.broadcast(spark.createDataFrame(list(enumerate(self.names)), f"i int, {self.short} {self._type}"))
        return self.rows.select(self.long, F.posexplode("v").alias("i", x)).join(names, "i").select("word", "doc", x)

    _type: str = "string"


def _directions(held: DataFrame, n: int, k: int) -> np.ndarray:
    """The k leading directions (n x k) of rows given by their cells (i, x)."""
    if n > MAX_SIDE:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        rows = held.select("cells").rdd.map(lambda r: Vectors.sparse(n, sorted((c["i"], c["x"]) for c in r["cells"])))
        return RowMatrix(rows).computeSVD(k, False).V.toArray()

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, any_ = np.zeros((n, n)), False
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                x = np.stack([_dense(c, n) for c in pdf["cells"].iloc[lo : lo + 500]])
                g += x.T @ x
                any_ = True
        if any_:
            yield pd.DataFrame({"i": range(n), "v": [r.tobytes() for r in g]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    # one row per task and line of the Gram matrix is shuffled; the driver gets n lines of n numbers, n at most MAX_SIDE
    lines = held.select("cells").mapInPandas(gram, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary")
    g = np.zeros((n, n))
    for r in lines.toLocalIterator():
        g[r["i"]] = np.frombuffer(r["v"])
    values, vectors = np.linalg.eigh(g)
    return vectors[:, np.argsort(-values)[:k]]


def _dense(cells, n: int) -> np.ndarray:
    out = np.zeros(n)
    for c in cells:
        out[c["i"]] += c["x"]
    return out


def projected(postings: DataFrame, k: int | None = None, k_from: str = "min") -> Rows:
    """The rank-k approximation, kept by rows of the longer axis. No postings give no rows."""
    spark = postings.sparkSession
    words, docs = size(postings)
    if not words:
        return Rows(postings.select("doc", F.array().cast("array<double>").alias("v")), "doc", "word", [], 0, 0, postings.schema["word"].dataType.simpleString())
    k = max(1, min(k or rank_of(words, docs, k_from), words, docs))
    short, long = ("word", "doc") if words <= docs else ("doc", "word")
    kind = lambda c: postings.schema[c].dataType.simpleString()
    side = [r[0] for r in postings.select(short).distinct().orderBy(short).collect()]
    n = len(side)
    index = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(side)], f"{short} {kind(short)}, i int"))  # the selected, ranked side
    held = keep(postings.join(index, short).groupBy(long).agg(F.collect_list(F.struct("i", "x")).alias("cells")))  # at most n cells each
    p = spark.sparkContext.broadcast(_directions(held, n, k))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                x = np.stack([_dense(c, n) for c in part["cells"]]) @ p.value @ p.value.T
                yield pd.DataFrame({long: part[long], "v": list(x)})

    return Rows(keep(held.mapInPandas(apply, f"{long} {kind(long)}, v array<double>")), long, short, side, words, docs, kind(short))


def project(postings: DataFrame, k: int | None = None, k_from: str = "min") -> DataFrame:
    """(word, doc, x): the rank-k approximation, every cell."""
    return projected(postings, k, k_from).cells()


def normalised(a: Rows) -> Rows:
    """Each document's cells (each word's, if there are fewer words than documents) divided by their signed sum, then absolute. A sum of 0 gives NaN."""
    axis = "doc" if a.words >= a.docs else "word"
    nan = F.lit(float("nan"))
    if not a.names:
        return a
    if axis == a.long:
        total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
        v = F.transform("v", lambda x: F.when(total == 0, nan).otherwise(F.abs(F.try_divide(x, total))))
    else:  # one sum for each name of the shorter side
        sums = a.rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).orderBy("i").collect()
        s = F.array(*[F.lit(r["s"]) for r in sums])
        v = F.zip_with("v", s, lambda x, t: F.when(t == 0, nan).otherwise(F.abs(F.try_divide(x, t))))
    return Rows(keep(a.rows.select(a.long, v.alias("v"))), a.long, a.short, a.names, a.words, a.docs, a._type)


def lsi_rows(postings: DataFrame) -> Rows:
    """The matrix of :func:`lsi_matrix` by rows of its longer axis."""
    return normalised(projected(postings))


def lsi_matrix(postings: DataFrame) -> DataFrame:
    """(word, doc, w): the approximation with each document's cells (each word's, if there are fewer words than documents) divided by their signed sum, then absolute. A sum of 0 gives NaN."""
    return lsi_rows(postings).cells("w")


def lsi_older(postings: DataFrame) -> DataFrame:
    """(word, doc, x): the older variant, its rank from the rows and nothing normalised."""
    return project(postings, k_from="rows")
