"""Word counts over a stream of texts: an extension, the reference behaviour is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.tokens import words_of


def windowed_word_counts(stream: DataFrame, time_col: str, text_col: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, word, cnt) by event time; rows later than ``late`` are left out."""
    words = stream.select(F.col(time_col).alias("at"), F.explode(words_of(F.col(text_col))).alias("word"))
    return words.withWatermark("at", late).groupBy(F.window("at", window), "word").agg(F.count("*").alias("cnt")).select("window.start", "word", "cnt")
