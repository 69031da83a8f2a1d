"""The public flow: select words, index them, group them, search.

``Selection`` ties the steps together; every step is also a function of its own. A
strategy is any function from DataFrame to DataFrame (``df.transform``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.tokens import accepted, camel_pieces, strip_digits
from lexforge.operators import clustering, counting, index, lsi, search
from lexforge.operators.spelling import gated_corrections
from lexforge.sources import corpus
from lexforge.sources.stopwords import COUNTING, DEFAULT, stop_words, without_stop_words
from lexforge.storage import keep

#: Fixed value: at most so many words are selected.
MOST = 150
Strategy = Callable[[DataFrame], DataFrame]
#: From words (word) and a dictionary to (word, corrected).
Corrector = Callable[[DataFrame, DataFrame], DataFrame]


def clamp(k: int | None) -> int:
    """k within 0 and MOST; none means MOST."""
    return MOST if k is None else min(max(0, k), MOST)


def apply(words: DataFrame, strategy: Strategy) -> DataFrame:
    return words.transform(strategy)


def extract(sources: DataFrame, dictionary: DataFrame | None = None, methods: list[str] | None = None, stop_lists: tuple[str, ...] = DEFAULT, extra_stops: DataFrame | None = None, corrector: Corrector = gated_corrections) -> DataFrame:
    """(word, doc, pos) of the words in the identifiers of methods; pos is (source, token, piece), a total order.

    ``methods`` keeps methods of these names, in any case. With a dictionary, ``corrector`` gives (word, corrected) for the words. Files are scanned
    once; stop lists, inflection and correction are applied to the distinct pieces and come back with one join.
    """
    stops = stop_words(sources.sparkSession, stop_lists, extra_stops)
    ids = corpus.scan(sources)
    if methods:
        ids = ids.where(F.lower("method").isin(*[m.lower() for m in methods]))
    ids = ids.withColumn("identifier", strip_digits(F.col("identifier"))).where(accepted(F.col("identifier")))
    doc = corpus.container()
    pieces = keep(ids.select(doc.alias("doc"), "source_name", "pos", F.posexplode(camel_pieces(F.col("identifier"))).alias("k", "piece")))
    known = without_stop_words(pieces.select("piece").distinct(), stops, "piece", plural=True).select("piece", F.lower("piece").alias("word"))
    if dictionary is not None:
        known = keep(known)
        known = known.join(corrector(known.select("word").distinct(), dictionary), "word", "left").select("piece", F.coalesce("corrected", "word").alias("word"))
    known = without_stop_words(known, stops)
    return pieces.join(known, "piece").select("word", "doc", F.struct("source_name", "pos", "k").alias("pos"))


def counted(words: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Counts and postings after the fixed stop lists of counting."""
    return counting.count_words(words, stops=stop_words(words.sparkSession, COUNTING), **options)


def frequent_words(words: DataFrame, k: int | None = None) -> DataFrame:
    return counting.top_words(counted(words)[0], k)


def flatten_words(words: DataFrame) -> DataFrame:
    """(word, cnt, n_docs) of every word."""
    counts, postings = counted(words)
    n = postings.groupBy("word").agg(F.count("*").alias("n_docs"))
    return counts.join(n, "word", "left").select("word", "cnt", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def weighted_words(words: DataFrame, k: int | None = None) -> DataFrame:
    """(word, score) by falling tf-idf score, equal ones by name; empty input gives none."""
    return ranked_words(counted(words)[1], k)


def ranked_words(postings: DataFrame, k: int | None = None) -> DataFrame:
    """:func:`weighted_words` of words that are counted already."""
    scores = index.weigh(index.tfidf(postings.withColumn("x", F.lit(1.0))))
    out = scores.orderBy(F.desc("score"), "word")
    return out if k is None else out.limit(max(0, k))


def selected_index(postings: DataFrame, k: int | None = None) -> tuple[DataFrame, index.Index]:
    """The ranked words (rank, word, score), at most MOST, and the index of their documents; cells are 0 or 1. Both are kept, the words counted once."""
    spark = postings.sparkSession
    top = [(i, r["word"], r["score"]) for i, r in enumerate(ranked_words(postings, clamp(k)).collect(), 1)]
    ranked = spark.createDataFrame(top, "rank int, word string, score double")
    made = index.create_index(postings.join(F.broadcast(ranked.select("word")), "word"))  # at most MOST words
    made.terms, made.postings = ranked, keep(made.postings)
    made.rows = lsi.lsi_rows(made.postings)
    made.lsi = made.rows.cells("w")
    return ranked, made


def by_frequency(k: int | None = None) -> Strategy:
    return lambda words: frequent_words(words, k)


def by_composite_weight(k: int | None = None) -> Strategy:
    return lambda words: weighted_words(words, k)


class Selection:
    """Select, index, group and query the words of a corpus. ``options`` are those of :func:`extract`."""

    def __init__(self, sources: DataFrame, k: int | None = None, **options) -> None:
        self.words = extract(sources, **options)
        self.selected, self._index = selected_index(counted(self.words)[1], k)

    def index(self) -> index.Index:
        """Index of the selected words in their documents."""
        return self._index

    def groups(self, items: DataFrame, strategy: clustering.Magnet) -> DataFrame:
        """Items handed to a strategy of grouping."""
        return clustering.grouped(items, strategy)

    def word_groups(self, **options) -> clustering.Groups:
        return clustering.Groups(group_words(self._index, **options), self._index)

    def doc_groups(self, **options) -> clustering.Groups:
        return clustering.Groups(*_with_index(group_docs(self._index, **options), self._index))

    def methods(self, keywords: DataFrame) -> DataFrame:
        """Documents like the keywords."""
        return search.result(search.search_docs(self._index.lsi, keywords))

    def types(self, docs: DataFrame) -> DataFrame:
        """Words like the documents."""
        return search.result(search.search_words(self._index.lsi, docs))


def _with_index(found: tuple[DataFrame, DataFrame], made: index.Index) -> tuple[DataFrame, index.Index, DataFrame]:
    return found[0], made, found[1]


def _by_rows(made: index.Index, item: str, names: list | None) -> DataFrame:
    """(item, vec) of an axis that is the longer one."""
    rows = made.rows.rows.select(F.col(item).alias("item"), F.col("v").alias("vec"))
    if names is None:
        return rows
    order = made.lsi.sparkSession.createDataFrame([(v, i) for i, v in enumerate(names, 1)], f"item {made.postings.schema[item].dataType.simpleString()}, ord int")
    return rows.join(F.broadcast(order), "item")  # names are selected words


def group_words(made: index.Index, names: list | None = None, **options) -> DataFrame:
    """(group, ord, item): words in the order of ``names``, else of their rank; none gives no groups."""
    names = [r["word"] for r in made.terms.orderBy("rank").collect()] if names is None else list(names)
    if not names:
        return made.lsi.sparkSession.createDataFrame([], "group int, ord int, item string")
    if made.rows.long == "word":
        return clustering.kmeans(_by_rows(made, "word", names), **options)[0].select("group", "ord", "item")
    place = {w: i for i, w in enumerate(made.rows.names)}
    at = F.array(*[F.lit(place[w]) for w in names if w in place])
    rows = made.rows.rows.select(F.transform(at, lambda i: F.element_at("v", i + 1)).alias("vec"))
    return clustering.kmeans_columns(rows, [w for w in names if w in place], **options)


def group_docs(made: index.Index, **options) -> tuple[DataFrame, DataFrame]:
    """((group, item, ...), centers): documents in the order of their names."""
    if made.rows.long == "doc":
        return clustering.kmeans(_by_rows(made, "doc", None), **options)
    vec = F.col("v").alias("vec")
    groups = clustering.kmeans_columns(made.rows.rows.select(vec), made.rows.names, **options)
    return groups, None
