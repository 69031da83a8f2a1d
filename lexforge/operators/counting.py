"""Word counts with plural folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.inflect import singular_of
from lexforge.sources.stopwords import without_stop_words
from lexforge.storage import keep


def word_stats(words: DataFrame) -> DataFrame:
    """(word, n, first_pos) of each distinct word. ``words``: word, doc, pos (a total order); null words count nothing."""
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def fold_roots(stats: DataFrame) -> DataFrame:
    """(word, n, root): a word folds into its singular if that came earlier and is itself an entry.

    A word is an entry if its chain of earlier singulars has no link or an even number of them; the chain is followed
    until it ends, three links at a time. A null position comes before all others.
    """
    s = stats.withColumn("single", singular_of("word"))
    known = stats.select(F.col("word").alias("single"), F.col("first_pos").alias("single_pos"))
    link = s.join(known, "single", "left").select("word", "n", F.when((F.col("single") != F.col("word")) & (F.col("single_pos") < F.col("first_pos")), F.col("single")).alias("up"))
    link = keep(link)
    step = link.where("up IS NOT NULL").select(F.col("word").alias("end"), F.col("up").alias("next"))
    chain = link.select("word", "n", "up", F.col("up").alias("end"), F.col("up").isNotNull().cast("int").alias("links"))
    while True:
        for _ in range(3):
            chain = chain.join(step, "end", "left").select("word", "n", "up", F.col("next").alias("end"), (F.col("links") + F.col("next").isNotNull().cast("int")).alias("links"))
        chain = keep(chain)
        if not chain.where("end IS NOT NULL").limit(1).count():
            return chain.select("word", "n", F.when(F.col("links") % 2 == 1, F.col("up")).otherwise(F.col("word")).alias("root"))


def count_words(words: DataFrame, fold: bool = True, merge_plural_containers: bool = False, stops: DataFrame | None = None, null_voids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts, postings): (word, cnt) and distinct (word, doc).

    A folded plural adds to the count; its documents are lost unless ``merge_plural_containers``, as in the reference behaviour.
    Null words are skipped; with ``null_voids`` a single one makes the whole list count nothing. ``stops`` (list, word) are left out.
    Tokens are read once: they are pre-aggregated to (word, doc), which is kept, and everything else comes from that.
    """
    held = words.groupBy("word", "doc").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    held = keep(held if stops is None else without_stop_words(held, stops, nulls=True))
    if null_voids and held.where("word IS NULL").limit(1).count():
        held = held.limit(0)
    held = held.where("word IS NOT NULL")
    docs = held.where("doc IS NOT NULL").select("word", "doc")
    stats = held.groupBy("word").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    if not fold:
        return stats.select("word", F.col("n").alias("cnt")), docs
    roots = fold_roots(stats)
    counts = roots.groupBy(F.col("root").alias("word")).agg(F.sum("n").alias("cnt"))
    if merge_plural_containers:
        return counts, docs.join(roots.select("word", "root"), "word").select(F.col("root").alias("word"), "doc").distinct()
    return counts, docs.join(roots.where("word <> root").select("word"), "word", "left_anti")


def token_total(words: DataFrame) -> DataFrame:
    """(total): one row with the number of words that count."""
    return words.agg(F.count("word").alias("total"))


def top_words(counts: DataFrame, k: int | None = None) -> DataFrame:
    """By falling count, equal ones by name; ``k`` limits, a negative one is an error."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    out = counts.orderBy(F.desc("cnt"), "word")
    return out if k is None else out.limit(k)
