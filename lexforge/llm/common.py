"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.storage import cut, drop, keep, spread, stream, written  # noqa: F401 - shared by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession, per_core: int = 4) -> int:
    """Partitions for work that is heavy per row: a few for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def pick(df: DataFrame, **named: str) -> DataFrame:
    """Only the wanted columns under the operator's own names; extra columns can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(to) for to, src in named.items()])


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    out = T.StructType()
    for name, kind in fields:
        out = out.add(name, kind, True)
    return out


def blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def first_of(items: Iterable, default=None):
    return next(iter(items), default)


#: At most so many keys count as hot: those with at least 1/HEAVY of all rows.
HEAVY = 1000


def join_hot(rows: DataFrame, stats: DataFrame, key: str, size: str, total: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``stats`` (one row per key) joined on ``key``.

    Keys whose ``size`` is at least 1/HEAVY of ``total`` (one row, column total_rows) number at most HEAVY, so they are
    broadcast and their rows stay where they are; the others are joined by hash, where no key holds more than that share.
    """
    flagged = stats.join(F.broadcast(total.select("total_rows"))).withColumn("_hot", F.col(size) * HEAVY >= F.col("total_rows")).drop("total_rows")
    hot = F.broadcast(flagged.where("_hot").drop("_hot"))
    hot_keys = F.broadcast(flagged.where("_hot").select(key))
    light = flagged.where("not _hot").drop("_hot")
    return rows.join(hot, key).unionByName(rows.join(hot_keys, key, "left_anti").join(light, key, how), allowMissingColumns=True)
