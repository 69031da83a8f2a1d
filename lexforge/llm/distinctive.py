"""Problem 4: how distinctive a term is per record.

Correspondence-analysis residuals: for a term's count in a record, observed minus
expected over the square root of expected, where expected comes from the margins of
the table record x term; the adjusted residual divides by
sqrt((1 - record share)(1 - term share)). Plain DataFrame arithmetic.

Counts are pre-aggregated by (record, term). The margins are joined back in two
parts: those of hot terms and records, which are few by definition, by broadcast, the
others by hash (:func:`.common.join_hot`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keep

def term_scores(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(record, name, term, tf, df, n_records, record_total, term_total, expected, residual, adjusted, tfidf) of each pair that occurs.

    ``tokens``: record, element; ``names``: record, name (see ``words_common``); rows without a record are left out.
    ``tfidf`` is tf * (1 + ln n - ln df). A margin that holds everything makes the adjusted residual 0. No rows give no scores.
    """
    pairs = keep(tokens.where("record is not null").groupBy("record", F.col("element").alias("term")).agg(F.count("*").alias("tf")))
    terms = pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("term_total"))
    records = pairs.groupBy("record").agg(F.sum("tf").alias("record_total"))
    total = pairs.groupBy("record").agg(F.sum("tf").alias("rows")).agg(F.count("*").alias("n_records"), F.sum("rows").alias("total_rows"))
    t = join_hot(pairs, terms, "term", "df", total)
    t = join_hot(t, records.join(names, "record"), "record", "record_total", total)
    t = t.join(F.broadcast(total))
    r, c = F.col("record_total") / F.col("total_rows"), F.col("term_total") / F.col("total_rows")
    t = t.withColumn("expected", F.col("record_total") * c).withColumn("residual", (F.col("tf") - F.col("expected")) / F.sqrt("expected"))
    spread = F.sqrt((1 - r) * (1 - c))
    return t.select(
        "record", "name", "term", "tf", "df", "n_records", "record_total", "term_total", "expected", "residual",
        F.when(spread > 0, F.col("residual") / spread).otherwise(F.lit(0.0)).alias("adjusted"),
        (F.col("tf") * (1 + F.log(F.col("n_records")) - F.log(F.col("df")))).alias("tfidf"),
    )


def top_terms(scores: DataFrame, by: str = "adjusted", min_rows: int = 1) -> DataFrame:
    """(record, name, term, score): of each record with at least ``min_rows`` rows the term with the highest ``by``, equal scores by name."""
    best = F.min(F.struct((-F.col(by)).alias("s"), F.col("term").alias("t"), "name")).alias("b")
    return scores.where(F.col("record_total") >= min_rows).groupBy("record").agg(best).select("record", "b.name", F.col("b.t").alias("term"), (-F.col("b.s")).alias("score"))
