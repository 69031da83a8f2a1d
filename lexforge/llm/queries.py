"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokens(spark: SparkSession, d: str, keep: tuple[str, ...], seed: int = 1) -> DataFrame:
    from .words_common import valid_words

    return valid_words(table(spark, d, "words"), keep=keep, seed=seed)


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    from .words_common import record_names

    return record_names(table(spark, d, "words"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    from .canonical import map_rows

    return map_rows(table(spark, d, "typed_words"), table(spark, d, "dictionary"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary entry meant by each typed word that is not one itself, 0 for none."""
    words = table(spark, d, "dictionary").select(F.col("word").alias("value"))
    return _mapped(spark, d).join(words, "value", "left_anti").select(F.col("id").alias("typed_id"), F.col("key").alias("term_id"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry."""
    from .canonical import unmatched

    return unmatched(_mapped(spark, d)).withColumnsRenamed({"value": "element"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rare and common elements."""
    from .term_frequency import term_frequencies

    t = term_frequencies(_tokens(spark, d, ("record", "value"), _names(spark, d)[1]), max_n=1)
    return t.where("mark is not null").select(F.col("term").alias("element"), "mark")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and containers of every element."""
    from .term_frequency import term_frequencies

    t = term_frequencies(_tokens(spark, d, ("record", "value"), _names(spark, d)[1]), max_n=1)
    return t.select(F.col("term").alias("element"), "occurrences", "total", F.col("records").alias("containers"), "mark")


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and containers of every run of one to three elements that occurs at least twice."""
    from .term_frequency import term_frequencies

    t = term_frequencies(_tokens(spark, d, ("record", "value", "position"), _names(spark, d)[1]), max_n=3)
    return t.where("occurrences >= 2").select("n", "term", "occurrences", F.col("records").alias("containers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Elements with at least half a percent of the valid rows."""
    from .heavy_hitters import frequent_items

    return frequent_items(_tokens(spark, d, ()), "element", share=0.005, k=2000).select(F.col("item").alias("element"))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent elements with approximate counts."""
    from .heavy_hitters import heavy_hitters

    return heavy_hitters(_tokens(spark, d, ()), "element", k=2000).orderBy(F.desc("est"), "item").limit(50).select(F.col("item").alias("element"), "est", "low_by_at_most")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The most characteristic element of each container with 24 or more rows, by tf-idf."""
    from .distinctive import term_scores, top_terms

    names, seed = _names(spark, d)
    t = top_terms(term_scores(_tokens(spark, d, ("record",), seed), names), "tfidf", 24)
    return t.select(F.col("name").alias("container"), F.col("term").alias("element"))


def p4_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Each element of each container with its residuals."""
    from .distinctive import term_scores

    names, seed = _names(spark, d)
    t = term_scores(_tokens(spark, d, ("record",), seed), names)
    return t.select(F.col("name").alias("container"), F.col("term").alias("element"), "tf", "df", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"), F.round("adjusted", 6).alias("adjusted"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of clusters of three or more documents."""
    from .clusters import density_peaks

    return density_peaks(table(spark, d, "lsi")).where("size >= 3").select(F.col("id").alias("doc_id"), "first_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of three or more with size, typical members and their elements."""
    from .clusters import density_peaks, describe

    names, seed = _names(spark, d)
    docs = table(spark, d, "docs").select("doc_id", F.lower(F.trim("doc")).alias("name")).distinct()
    tf = _tokens(spark, d, ("record",), seed).where("record is not null").groupBy("record", "element").agg(F.count("*").alias("tf"))
    return describe(density_peaks(table(spark, d, "lsi")), docs.join(names, "name").select("doc_id", F.col("record").alias("name")), tf.withColumnRenamed("record", "name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each document that has five others with cosine of 0.8 or more and its five nearest."""
    from .vector_index import similar_vectors

    near = similar_vectors(table(spark, d, "lsi"), k=5, min_cos=0.8)
    full = near.where("rank = 5").select("id")
    return near.join(full, "id", "left_semi").select(F.least("id", "other").alias("doc_id_a"), F.greatest("id", "other").alias("doc_id_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar documents of every document."""
    from .vector_index import similar_vectors

    return similar_vectors(table(spark, d, "lsi"), k=5).select(F.col("id").alias("doc_id"), F.col("other").alias("neighbour"), F.round("cos", 6).alias("cos"), "rank")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse."""
    from .syntax import check_syntax

    return check_syntax(table(spark, d, "sources"), repair=False).where("cost > 0").select("source_id")


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Repair cost and cause of each invalid file."""
    from .syntax import check_syntax

    return check_syntax(table(spark, d, "sources")).where("cost > 0").select("source_id", "language", "cost", "least", "tokens", "cause", "first_edit")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    from .syntax import check_syntax, syntax_rates

    return syntax_rates(check_syntax(table(spark, d, "sources")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a run of 12 words with an evaluation item."""
    from .leak import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("longest_run >= 12").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, edited copies too, with scores."""
    from .leak import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest_run").alias("longest_run"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mixture with their number of copies."""
    from .mixture import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    from .mixture import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in documents."""
    from .pii import find_pii

    return find_pii(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with placeholders in place of personal information."""
    from .pii import tag_pii

    return tag_pii(table(spark, d, "documents")).select("doc_id", "redacted", F.size("spans").alias("n_spans"))


_VALID = """WITH valid AS (SELECT word_id, lower(trim(element)) AS e, nullif(lower(trim(container)), '') AS c, coalesce(value, 1) AS v
 FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC) AS r FROM words WHERE trim(element) <> '' AND (value IS NULL OR value >= 1)) WHERE r = 1)"""
_FREQ = f"""{_VALID}, n AS (SELECT count(DISTINCT c) AS n FROM valid), f AS (SELECT e, count(*) AS occurrences, sum(v)::BIGINT AS total, count(DISTINCT c) AS containers FROM valid GROUP BY e),
 m AS (SELECT e AS element, occurrences, total, containers, CASE WHEN total <= 3 THEN 'rare' WHEN containers > 0 AND containers >= 0.1 * n THEN 'common' END AS mark FROM f, n)"""
_PAIRS = f"""{_VALID}, p AS (SELECT c, e, count(*) AS tf FROM valid WHERE c IS NOT NULL GROUP BY c, e), t AS (SELECT e, count(*) AS df, sum(tf) AS tt FROM p GROUP BY e),
 r AS (SELECT c, sum(tf) AS rt FROM p GROUP BY c), n AS (SELECT count(*) AS n, sum(rt) AS total FROM r),
 s AS (SELECT c, e, tf, df, rt, tt, n, total, rt * (tt::DOUBLE / total) AS x FROM p JOIN t USING (e) JOIN r USING (c), n)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_FREQ} SELECT element, mark FROM m WHERE mark IS NOT NULL",
        "p2_frequencies": f"{_FREQ} SELECT * FROM m",
        "p2_ngrams": f"""{_VALID}, s AS (SELECT v.c, v.e AS t1, lead(v.e) OVER w AS t2, lead(v.e, 2) OVER w AS t3 FROM valid v JOIN (SELECT word_id, any_value(scanned_at) AS seen FROM words GROUP BY word_id) y ON v.word_id = y.word_id WHERE c IS NOT NULL WINDOW w AS (PARTITION BY v.c ORDER BY y.seen, v.word_id)
          UNION ALL SELECT c, e, NULL, NULL FROM valid WHERE c IS NULL),
          g AS (SELECT 1 AS n, t1 AS term, c FROM s UNION ALL SELECT 2, t1 || ' ' || t2, c FROM s WHERE t2 IS NOT NULL UNION ALL SELECT 3, t1 || ' ' || t2 || ' ' || t3, c FROM s WHERE t3 IS NOT NULL)
          SELECT n, term, count(*) AS occurrences, count(DISTINCT c) AS containers FROM g GROUP BY n, term HAVING count(*) >= 2""",
        "p3_found": f"{_VALID} SELECT e AS element FROM valid GROUP BY e HAVING count(*) >= 0.005 * (SELECT count(*) FROM valid)",
        "p4_found": f"{_PAIRS} SELECT c AS container, e AS element FROM (SELECT c, e, row_number() OVER (PARTITION BY c ORDER BY tf * (1 + ln(n) - ln(df)) DESC, e) AS k FROM s WHERE rt >= 24) WHERE k = 1",
        "p4_residuals": f"""{_PAIRS} SELECT c AS container, e AS element, tf, df, round(x, 6) AS expected, round((tf - x) / sqrt(x), 6) AS residual,
          round(CASE WHEN (1 - rt::DOUBLE / total) * (1 - tt::DOUBLE / total) > 0 THEN (tf - x) / sqrt(x) / sqrt((1 - rt::DOUBLE / total) * (1 - tt::DOUBLE / total)) ELSE 0 END, 6) AS adjusted FROM s""",
    }
