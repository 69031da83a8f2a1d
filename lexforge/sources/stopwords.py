"""Stop lists: built-in ones, loader, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.inflect import plural_of

#: Common English function words.
ENGLISH = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot "
    "could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd "
    "he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most "
    "mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should "
    "shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those "
    "through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's "
    "whom why why's will with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()
#: Reserved words and literals of Java.
JAVA = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if "
    "implements import instanceof int interface long native new null package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient true try void volatile while"
).split()
#: Words of application interfaces.
GENERAL = "add array boolean code count data equals error field file get has index init input int item key length line list main map max message method min name node object out output print println process result run set size start state string system temp test text type update util value values".split()
BUILT_IN = {"english": ENGLISH, "java": JAVA, "general": GENERAL}
DEFAULT = ("english", "java", "general")
COUNTING = ("english", "java")


def stop_words(spark: SparkSession, lists: tuple[str, ...] = DEFAULT, extra: DataFrame | None = None) -> DataFrame:
    """(list, word) of built-in lists; ``extra`` (word) joins as the list "custom"."""
    rows = [(name, w) for name in lists for w in BUILT_IN[name]]
    out = spark.createDataFrame(rows, "list string, word string")
    return out if extra is None else add_words(out, extra)


def add_words(stops: DataFrame, words: DataFrame) -> DataFrame:
    """The lists with more words in "custom": lower case, distinct, without null and empty ones."""
    more = words.select(F.lit("custom").alias("list"), F.lower("word").alias("word")).where("word <> ''").distinct()
    return stops.unionByName(more).distinct()


def parse_words(lines: DataFrame, name: str) -> DataFrame:
    """(list, word) from lines (value): whatever follows | is a comment, words stand apart by white space."""
    line = F.regexp_replace("value", r"\|.*", "")
    return lines.select(F.explode(F.split(F.lower(line), r"\s+")).alias("word")).where("word <> ''").distinct().select(F.lit(name).alias("list"), "word")


def load_words(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(list, word) from text files, see :func:`parse_words`."""
    return parse_words(spark.read.text(path), name)


def normal(c: Column) -> Column:
    """Form in which words are looked up."""
    return F.lower(F.translate(c, "’", "'"))


def is_stop_word(c: Column, words: list[str]) -> Column:
    """Length 1, or in the list."""
    return (F.length(c) == 1) | normal(c).isin(*words)


def without_stop_words(df: DataFrame, stops: DataFrame, column: str = "word", plural: bool = False, nulls: bool = False) -> DataFrame:
    """Rows whose word (or, with ``plural``, its plural too) is in no list and longer than one character; null words go unless ``nulls``.

    The distinct stop words are joined by hash; Spark broadcasts them if they are small.
    """
    listed = stops.select(normal(F.col("word")).alias("_stop")).distinct()
    long = F.length(column) > 1
    out = df.where(long | F.col(column).isNull() if nulls else long).join(listed, normal(F.col(column)) == F.col("_stop"), "left_anti")
    return out.join(listed, normal(plural_of(column)) == F.col("_stop"), "left_anti") if plural else out


def values_sql(lists: tuple[str, ...] = DEFAULT) -> str:
    """The lists as a DuckDB query with the column stop."""
    words = sorted({w for n in lists for w in BUILT_IN[n]})
    rows = ", ".join("('{}')".format(w.replace("'", "''")) for w in words)
    return f"SELECT stop FROM (VALUES {rows}) AS t(stop)"
