"""Valid word occurrences, the common input of problems 2 to 4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, pick


def record_key(c: Column, seed: int) -> Column:
    """Eight bytes in place of a record's name."""
    return F.when(~blank(c), F.xxhash64(F.lit(seed), F.lower(F.trim(c))))


def record_names(df: DataFrame, container_col: str = "container") -> tuple[DataFrame, int]:
    """(record, name) of every record, and the seed with which no two names have the same key.

    Keys are checked over all names; should two names clash, the next seed is tried, so counts by key are exact.
    """
    names = pick(df, name=container_col).where(~blank(F.col("name"))).select(F.lower(F.trim("name")).alias("name")).distinct()
    seed = 1
    while names.groupBy(F.xxhash64(F.lit(seed), "name")).count().where("count > 1").limit(1).count():
        seed += 1
    return names.select(F.xxhash64(F.lit(seed), "name").alias("record"), "name"), seed


def valid_words(
    df: DataFrame, id_col: str = "word_id", element_col: str = "element", value_col: str = "value", container_col: str = "container", order_col: str = "scanned_at", version_col: str = "loaded_at", keep: tuple[str, ...] = ("record", "value", "position"), seed: int = 1
) -> DataFrame:
    """(word_id, element, then those of ``keep``): one row per id, trimmed and lower case; ``record`` is the key of the container.

    Rows with a null id, a null or blank element or a value below 1 are left out; a null
    value counts as 1; a blank container has no key. Of several deliveries of an id the
    latest counts (a null version is the oldest), ties by the greater element, then record.
    Ids are spread by hash, so a hot element or container is spread too.
    """
    w = pick(df, word_id=id_col, element=element_col, value=value_col, container=container_col, position=order_col, version=version_col)
    w = w.where(F.col("word_id").isNotNull() & ~blank(F.col("element")) & (F.col("value").isNull() | (F.col("value") >= 1)))
    clean = {
        "element": F.lower(F.trim("element")),
        "record": record_key(F.col("container"), seed),
        "value": F.coalesce(F.col("value"), F.lit(1)).cast("long"),
        "position": F.col("position"),
    }
    w = w.select("word_id", "version", clean["element"].alias("element"), *[clean[k].alias(k) for k in keep])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.max(F.struct("version", "element", *keep)).alias("r")
    return w.repartition(n, "word_id").groupBy("word_id").agg(last).select("word_id", "r.element", *[f"r.{k}" for k in keep])
