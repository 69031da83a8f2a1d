"""Spelling correction by frequency, edits and prefixes, once per distinct word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.similarity import similar_enough, similarity
from lexforge.functions.tokens import one_kind_of_letter
from lexforge.sources.dictionary import best_by_prefix, contains

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def mutate(word: str, letters: str = LETTERS) -> list[str]:
    """All words one edit away: deletes, replaces, inserts, transposes."""
    n = len(word)
    return (
        [word[:i] + word[i + 1 :] for i in range(n)]
        + [word[:i] + c + word[i + 1 :] for i in range(n) for c in letters]
        + [word[:i] + c + word[i:] for i in range(n + 1) for c in letters]
        + [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(n - 1)]
    )


def sources_of(word: str, others: str) -> list[str]:
    """The words over the letters and ``others`` of which ``word`` is one edit away; only letters can be replaced or inserted."""
    n, every = len(word), LETTERS + "".join(sorted(set(others) - set(LETTERS)))
    new = [i for i in range(n) if word[i] in LETTERS]
    return (
        [word[:i] + word[i + 1 :] for i in new]
        + [word[:i] + c + word[i + 1 :] for i in new for c in every]
        + [word[:i] + c + word[i:] for i in range(n + 1) for c in every]
        + [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(n - 1)]
    )


def _thinned(word: str) -> set[str]:
    """The word without any none, one or two of its letters."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}


def _thin(df: DataFrame, column: str, key: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, k) for w in pdf[column] for k in _thinned(w)]
            yield pd.DataFrame(rows, columns=[column, key])

    return df.select(column).mapInPandas(run, f"{column} string, {key} string")


def edit_candidates(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, candidate, edits) of the dictionary words one or two edits away.

    Words at most two edits apart share a form with at most two letters deleted on either side, so the candidates come
    from an equi-join; each pair is then checked exactly.
    """
    left = _thin(words.select("word").distinct(), "word", "key")
    right = _thin(dictionary.select(F.col("word").alias("candidate")).distinct(), "candidate", "key")
    pairs = left.join(right, "key").select("word", "candidate").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, set[str]] = {}
        for pdf in batches:
            rows = []
            for w, c in zip(pdf["word"], pdf["candidate"]):
                if w not in memo:
                    memo = {w: set(mutate(w))} if len(memo) > 5000 else memo | {w: set(mutate(w))}
                near = memo[w]
                if c in near:
                    rows.append((w, c, 1))
                elif not near.isdisjoint(sources_of(c, w)):
                    rows.append((w, c, 2))
            yield pd.DataFrame(rows, columns=["word", "candidate", "edits"])

    return pairs.sortWithinPartitions("word").mapInPandas(check, "word string, candidate string, edits int")


def prefix_completions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, completion): the most frequent word that begins with it, else with it less its last letter."""
    best = best_by_prefix(dictionary)
    w = words.select("word").distinct()
    one = w.join(best.withColumnsRenamed({"prefix": "word", "best": "b1"}), "word", "left")
    two = one.withColumn("p", F.expr("substring(word, 1, length(word) - 1)")).join(best.withColumnsRenamed({"prefix": "p", "best": "b2"}), "p", "left")
    return two.select("word", F.coalesce("b1", "b2").alias("completion"))


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, corrected) for each distinct word.

    Known words stay. Of words of one kind of letter the most similar of three winners is taken: the most frequent candidates at
    one edit and at up to two, and the completion (equal ones: by frequency, then name). Of other words the completion; none: the word.
    """
    distinct = contains(words.where("word <> ''").select("word").distinct(), dictionary)
    unknown = distinct.where("NOT known").select("word", one_kind_of_letter(F.col("word")).alias("bare"))
    done = prefix_completions(unknown, dictionary)
    cand = edit_candidates(unknown.where("bare"), dictionary).join(dictionary.select(F.col("word").alias("candidate"), "freq"), "candidate")
    top = lambda c: F.min(F.when(c, F.struct((-F.col("freq")).alias("f"), "candidate")))
    won = cand.groupBy("word").agg(top(F.col("edits") == 1).alias("e1"), top(F.col("edits") <= 2).alias("e2"))
    all_ = unknown.join(done, "word", "left").join(won, "word", "left")
    three = F.filter(F.array("e1.candidate", "e2.candidate", "completion"), lambda x: x.isNotNull())
    each = all_.select("word", "bare", "completion", F.explode_outer(F.when(F.col("bare"), three)).alias("winner"))
    each = each.join(dictionary.select(F.col("word").alias("winner"), "freq"), "winner", "left")
    best = each.groupBy("word", "bare", "completion").agg(F.min(F.struct((-similarity(F.col("word"), F.col("winner"))).alias("s"), (-F.col("freq")).alias("f"), "winner")).alias("b"))
    fixed = best.select("word", F.coalesce(F.when(F.col("bare"), F.col("b.winner")).otherwise(F.col("completion")), "word").alias("corrected"))
    return distinct.where("known").select("word", F.col("word").alias("corrected")).unionByName(fixed)


def gated_corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, corrected): a correction counts for words that are unknown or of one kind of letter, if it is similar enough."""
    c = corrections(words, dictionary)
    return c.select("word", F.when(similar_enough(F.col("word"), F.col("corrected")), F.col("corrected")).otherwise(F.col("word")).alias("corrected"))
