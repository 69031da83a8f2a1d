"""Spelling dictionary: words with frequencies from any text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.tokens import camel_pieces, is_number, one_kind_of_letter, trim_numbers
from lexforge.storage import spread


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a file or folder; a missing one is an error that names it."""
    try:
        return spark.read.text(path).withColumnRenamed("value", "text")
    except Exception as e:
        raise FileNotFoundError(f"no dictionary text at {path}") from e


def build_dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq). Filters see a piece before its digits are trimmed, so a short word can still come out."""
    runs = spread(texts.select(text_col)).select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\w+"), F.lit(0))).alias("run"))
    piece = runs.groupBy("run").count().select(F.explode(camel_pieces(F.col("run"))).alias("p"), "count")
    kept = piece.where((F.length("p") > 2) & ~one_kind_of_letter(F.col("p")) & ~is_number(F.col("p")))
    return kept.groupBy(F.lower(trim_numbers(F.col("p"))).alias("word")).agg(F.sum("count").alias("freq"))


def contains(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``words`` with the column known."""
    return words.join(dictionary.select("word", F.lit(True).alias("known")), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def prefixed_by(dictionary: DataFrame, prefix: str) -> DataFrame:
    """Dictionary rows from the prefix to the next one; the empty prefix means all."""
    return dictionary.where(F.col("word").startswith(prefix)) if prefix else dictionary


def best_by_prefix(dictionary: DataFrame) -> DataFrame:
    """(prefix, best): the most frequent word with that prefix, equal ones by name. Makes the range join an equi-join."""
    heads = dictionary.where("word <> ''").select("word", "freq", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    return heads.groupBy(F.expr("substring(word, 1, n)").alias("prefix")).agg(F.min(F.struct((-F.col("freq")).alias("f"), "word")).alias("b")).select("prefix", F.col("b.word").alias("best"))
