"""k-means of a fixed number of passes over words or documents.

floor(sqrt(n)) groups; seeds are the first items; each pass recomputes the centers and
then gives every item to the most similar one (max-product by default). Equal
similarities go to the lowest group; items similar to none go to group 0.

Items may be rows of a table (:func:`kmeans`) or columns of one (:func:`kmeans_columns`): a word's
vector is as long as there are documents, so words are grouped without ever gathering their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.storage import keep

EPS = 1e-12
BLOCK = 2048


def vectors(matrix: DataFrame, item: str, axis: str, cell: str) -> DataFrame:
    """(item, vec): each item's cells in the order of the other axis. The axis has every value for every item."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(axis), F.col(cell).alias("x"))))
    return matrix.groupBy(F.col(item).alias("item")).agg(F.transform(cells, lambda s: s["x"]).alias("vec"))


def similarities(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of each row of ``x`` with each row of ``c``: the largest product of two cells or, for "cosine", their sum, over both norms."""
    with np.errstate(all="ignore"):
        top = np.abs(x) @ np.abs(c).T if metric == "cosine" else np.stack([np.abs(x * row).max(1) for row in c], 1)
        return top / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1))


def best_group(s: np.ndarray) -> np.ndarray:
    """Of each row the first of the largest similarities, equal up to rounding; 0 where none is above 0."""
    s = np.where(s > EPS, s, -1.0)
    return (s >= s.max(1, keepdims=True) - EPS).argmax(1)


def _assign(items: DataFrame, centers: np.ndarray, metric: str) -> DataFrame:
    """``items`` with the column group; the centers pass to the tasks in blocks of at most BLOCK."""
    sc = items.sparkSession.sparkContext
    shared = [sc.broadcast(centers[lo : lo + BLOCK]) for lo in range(0, len(centers), BLOCK)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = pdf.iloc[at : at + 256].copy()
                x = np.stack([np.asarray(v, "f8") for v in rows["vec"]])
                top, group = np.full(len(x), -np.inf), np.zeros(len(x), "i4")
                for b, block in enumerate(shared):
                    s = similarities(x, block.value, metric)
                    s = np.where(s > EPS, s, -1.0)
                    pick = best_group(s)
                    own = s[np.arange(len(s)), pick]
                    better = own > top + EPS
                    top[better], group[better] = own[better], b * BLOCK + pick[better]
                rows["group"] = np.where(top > 0, group, 0).astype("i4")
                yield rows

    return items.mapInPandas(run, T.StructType([*items.schema.fields, T.StructField("group", T.IntegerType())]))


def centers_of(members: DataFrame, old: np.ndarray) -> np.ndarray:
    """Element-wise means of the members, by group; an empty group keeps its old center. One partial sum for each task and group is shuffled."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for pdf in batches:
            for g, v in zip(pdf["group"], pdf["vec"]):
                sums[g] = sums[g] + v if g in sums else np.array(v, "f8")
                n[g] = n.get(g, 0) + 1
        yield pd.DataFrame({"group": list(sums), "n": [n[g] for g in sums], "v": [s.tobytes() for s in sums.values()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sum([np.frombuffer(x) for x in pdf["v"]], axis=0) / pdf["n"].sum()
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "n": [pdf["n"].sum()], "v": [v.tobytes()]})

    kind = "group int, n long, v binary"
    out = old.copy()
    for r in members.select("group", "vec").mapInPandas(add, kind).groupBy("group").applyInPandas(total, kind).toLocalIterator():
        out[r["group"]] = np.frombuffer(r["v"])
    return out


def kmeans(items: DataFrame, groups: int | None = None, passes: int = 2, metric: str = "max_product") -> tuple[DataFrame, DataFrame]:
    """(groups, centers): (group, ord, item, vec) and (group, vec). ``items``: item, vec and ord (from 1); without ord the order is that of the items.

    The items and every pass's members are kept once. Empty input gives empty groups.
    """
    spark = items.sparkSession
    order = "ord" if "ord" in items.columns else "item"
    d = keep(items.select("item", *[F.col("ord").cast("int")] * (order == "ord"), F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    n = d.count()
    g = groups or math.isqrt(n)
    members = d.withColumn("group", F.lit(0)).limit(0)
    centers = np.array([r["vec"] for r in d.orderBy(order).limit(g).collect()], "f8")  # floor(sqrt(n)) rows
    for k in range(passes if n else 0):
        if k:
            centers = centers_of(members, centers)
        members = keep(_assign(d, centers, metric))
    made = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "group int, vec array<double>")
    return members.select("group", *["ord"] * (order == "ord"), "item", "vec"), made


def kmeans_columns(rows: DataFrame, names: list, groups: int | None = None, passes: int = 2, metric: str = "max_product") -> DataFrame:
    """(group, ord, item): :func:`kmeans` of the columns of ``rows`` (vec array<double>), which are ``names`` in this order.

    A center is a mean of columns, so its cell in a row is a mean of the row's cells: each pass only sums products, norms and maxima over the
    rows, one table of items by groups for each task. The number of columns is that of selected words.
    """
    spark, n = rows.sparkSession, len(names)
    g = groups or math.isqrt(n)
    mix = np.eye(n)[:, :g]
    group = np.zeros(n, "i4")
    for k in range(passes if n else 0):
        if k:
            for j in range(g):
                if (group == j).any():
                    mix[:, j] = (group == j) / (group == j).sum()
        shared = spark.sparkContext.broadcast(mix)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            top, xx, cc = np.zeros((n, g)), np.zeros(n), np.zeros(g)
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    x = np.stack([np.asarray(v, "f8") for v in pdf["vec"].iloc[lo : lo + 256]])
                    c = x @ m
                    xx, cc = xx + (x * x).sum(0), cc + (c * c).sum(0)
                    a, b = np.abs(x), np.abs(c)
                    if metric == "cosine":
                        top += a.T @ b
                    else:
                        for j in range(g):
                            np.maximum(top[:, j], (a * b[:, j : j + 1]).max(0), out=top[:, j])
            yield pd.DataFrame({"top": [top.tobytes()], "xx": [xx.tobytes()], "cc": [cc.tobytes()]})

        parts = rows.select("vec").mapInPandas(run, "top binary, xx binary, cc binary").toLocalIterator()
        top, xx, cc = np.zeros((n, g)), np.zeros(n), np.zeros(g)
        for r in parts:
            t = np.frombuffer(r["top"]).reshape(n, g)
            top = top + t if metric == "cosine" else np.maximum(top, t)
            xx, cc = xx + np.frombuffer(r["xx"]), cc + np.frombuffer(r["cc"])
        with np.errstate(all="ignore"):
            group = best_group(top / (np.sqrt(xx)[:, None] * np.sqrt(cc)))
    made = [(int(a), i + 1, v) for i, (a, v) in enumerate(zip(group, names))]
    return spark.createDataFrame(made, f"group int, ord int, item {'string' if not names or isinstance(names[0], str) else 'long'}")


def group_strings(groups: DataFrame) -> DataFrame:
    """(group, items): the non-empty groups as "[a, b]", a text form for groups small enough to read."""
    key = "ord" if "ord" in groups.columns else "item"
    return groups.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "item"))).alias("m")).select("group", F.concat(F.lit("["), F.array_join(F.transform("m", lambda s: s["item"].cast("string")), ", "), F.lit("]")).alias("items"))


@dataclass
class Groups:
    """Non-empty groups with the index they were made from. ``members``: group, item and, for rows, vec; ``centers``: group, vec, if there are any."""

    members: DataFrame
    index: object = None
    centers: DataFrame | None = None

    def group_list(self) -> DataFrame:
        """(group, items) as text."""
        return group_strings(self.members)

    def is_empty(self) -> bool:
        return not self.members.limit(1).count()

    def items(self, group: int) -> DataFrame:
        return self.members.where(F.col("group") == group).select("item")

    def remove(self, item) -> Groups:
        """The groups without an item."""
        return replace(self, members=self.members.where(~F.col("item").eqNullSafe(F.lit(item))))

    def add(self, group: int, item, vec: list[float] | None = None) -> Groups:
        """The groups with one more item."""
        row = {"group": group, "item": item, "vec": vec}
        spark = self.members.sparkSession
        return replace(self, members=self.members.unionByName(spark.createDataFrame([tuple(row.get(c) for c in self.members.columns)], self.members.schema)))

    def proximity(self, metric: str = "max_product") -> DataFrame:
        """(group, item, proximity) of each member to its center; 0 without one."""
        if self.centers is None:
            return self.members.select("group", "item", F.lit(0.0).alias("proximity"))
        pairs = self.members.join(self.centers.select("group", F.col("vec").alias("c")), "group", "left")
        product = F.zip_with("vec", "c", lambda a, b: F.abs(a * b))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        top = F.aggregate(product, F.lit(0.0), lambda s, x: s + x) if metric == "cosine" else F.array_max(product)
        return pairs.select("group", "item", F.when(F.col("c").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(top, norm("vec") * norm("c")), F.lit(float("nan")))).alias("proximity"))


#: A strategy of grouping: from items to groups.
Magnet = Callable[[DataFrame], DataFrame]


def grouped(items: DataFrame, strategy: Magnet) -> DataFrame:
    """``items`` handed to a strategy."""
    return items.transform(strategy)
