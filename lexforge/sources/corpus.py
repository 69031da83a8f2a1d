"""Corpus scans: files, tables, sub-trees and literals to identifier or token rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.tokens import words_of

from lexforge.storage import spread

from .javalex import java_identifiers

SOURCES = T.StructType([T.StructField("source_name", T.StringType()), T.StructField("content", T.StringType())])


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_name, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("content"))


def from_sources(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """A corpus given in the program: unordered and unique."""
    return spark.createDataFrame(pairs, SOURCES).distinct()


def scan(sources: DataFrame) -> DataFrame:
    """Identifiers within methods; files without any give no rows. Repeated files are scanned once."""
    return java_identifiers(sources.select("source_name", "content").distinct()).where("method IS NOT NULL")


def scan_subtree(sources: DataFrame, type_name: str | None = None, method: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Identifiers of one type, method or range of token positions."""
    out = scan(sources)
    for cond in ((F.col("type") == type_name) if type_name else None, (F.col("method") == method) if method else None, (F.col("pos") >= first) if first is not None else None, (F.col("pos") <= last) if last is not None else None):
        out = out if cond is None else out.where(cond)
    return out


def without_scope(sources: DataFrame) -> DataFrame:
    """(source_name) of the files that give no identifier within a method: they do not parse, or hold no type with methods."""
    return sources.select("source_name").distinct().join(scan(sources).select("source_name").distinct(), "source_name", "left_anti")


def container() -> Column:
    """package.Type#method, (C) after constructors."""
    typ = F.coalesce("type", F.lit(""))
    path = F.when(F.col("package") == "", typ).otherwise(F.concat(F.col("package"), F.lit("."), typ))
    return F.concat(path, F.lit("#"), F.col("method"), F.when(F.col("is_ctor"), "(C)").otherwise(""))


def literal_words(spark: SparkSession, words: list[str]) -> DataFrame:
    """Words without documents: (word, doc, pos)."""
    return spark.createDataFrame([(w, None, i) for i, w in enumerate(words)], "word string, doc string, pos int")


def text_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, doc, pos) of the runs of a-z of each text, in lower case; pos is a total order by id and place.

    For whole-number ids pos is one decimal number, of which the least can be kept by hash aggregation; for others it is (id, place).
    """
    texts = spread(docs.select(id_col, text_col))
    words = texts.select(F.col(id_col).alias("doc"), F.posexplode(words_of(F.col(text_col))).alias("at", "word"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        pos = F.col("doc").cast("decimal(20,0)") * F.lit(Decimal(10**10)) + F.col("at")
    else:
        pos = F.struct(F.col("doc").alias("d"), F.col("at").alias("i"))
    return words.select("word", "doc", pos.alias("pos"))
