"""Queries over a small fixed corpus whose results are known by hand; their SQL states these as literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import inflect
from lexforge.operators import clustering, counting, index, lsi, search, sinks, spelling
from lexforge.plans import select
from lexforge.sources import corpus, javalex, stopwords

QUERIES: dict = {}
SQL: dict[str, str] = {}

SORT = """package p.q;

import java.util.Random;

/** quicksort pivot in a comment */
public class %s {
  private static final Random rand = new Random();

  public static void quicksort(int[] arr, int left, int right) {
    int pivot = randomizedPartition(arr, left, right);
    quicksort(arr, left, pivot);
    quicksort(arr, pivot, right);
  }

  private static int randomizedPartition(int[] arr, int left, int right) {
    int swapIndex = left + rand.nextInt(right - left);
    swap(arr, left, swapIndex);
    return partition(arr, left, right);
  }

  private static int partition(int[] arr, int left, int right) {
    int pivot = arr[right];
    int i = left - 1;
    int j = right;
    while (true) {
      while (arr[++i] < pivot);
      while (j > 0 && arr[--j] > pivot);
      if (i >= j) break;
      swap(arr, i, j);
    }
    return i;
  }

  private static void swap(int[] arr, int i, int j) { int tmp = arr[i]; arr[i] = arr[j]; arr[j] = tmp; }

  public static void main(String[] args) {
    quicksort(null, 0, args.length - 1);
    System.out.println("quicksort");
  }
}
"""
NESTED = """package a.b;
class Outer {
  int field = helper(unused);
  Outer(int first) { count = first; }
  class Inner { void run() { go(1); } }
  enum Kind { ONE, TWO; void name() { pick(ONE); } }
  Object make() { return new Maker() { public int cost() { return price; } }; }
}
"""
STOPS = ["left", "right", "index", "next", "swap", "main", "rand", "length", "println"]
WORDS = ["quicksort", "partition", "pivot", "randomized"]
HELD = {"quicksort": "quicksort pivot randomized partition", "randomizedPartition": "randomized partition", "partition": "partition pivot", "main": "quicksort"}
DOCS = list(HELD)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "'nan'::DOUBLE" if v != v else f"{v!r}::DOUBLE"
    return "'{}'".format(v.replace("'", "''")) if isinstance(v, str) else f"{v}::INTEGER"


def golden(columns: str, rows: list[tuple]):
    """Register a query with its rows."""
    values = ", ".join(f"({', '.join(map(_lit, r))})" for r in rows)

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({columns})"
        return f

    return add


def _sources(spark, copies: int) -> DataFrame:
    return corpus.from_sources(spark, [(f"Sort{i}", SORT % f"Sort{i}") for i in range(1, copies + 1)])


def _column(spark, words, name: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def _extracted(spark, copies: int, **options) -> DataFrame:
    return select.extract(_sources(spark, copies), extra_stops=_column(spark, STOPS), **options)


def _incidence(spark, copies: int) -> DataFrame:
    rows = [(w, f"{c}{d}", 1.0) for c in range(copies) for d, ws in HELD.items() for w in ws.split()]
    return spark.createDataFrame(rows, "word string, doc string, x double")


def _indexed(spark, copies: int) -> index.Index:
    made = index.Index(spark.createDataFrame([(i, w, 0.0) for i, w in enumerate(WORDS, 1)], "rank int, word string, score double"), _incidence(spark, copies).select("doc").distinct(), _incidence(spark, copies))
    made.rows = lsi.lsi_rows(made.postings)
    made.lsi = made.rows.cells("w")
    return made


# scans

_NESTED = [("Outer", "Outer", True, "Outer"), ("Outer", "Outer", True, "first"), ("Outer", "Outer", True, "count"), ("Outer", "Outer", True, "first"), ("Inner", "run", False, "run"), ("Inner", "run", False, "go"), ("Outer", "name", False, "name"), ("Outer", "name", False, "pick"), ("Outer", "name", False, "ONE"), ("Outer", "make", False, "Object"), ("Outer", "make", False, "make"), ("Outer", "make", False, "Maker"), ("Outer", "cost", False, "cost"), ("Outer", "cost", False, "price")]


@golden("type, method, is_ctor, identifier", _NESTED)
def golden_identifiers(spark, d):
    """Types, methods and constructors of identifiers; fields lie outside, enums and anonymous classes are no types."""
    return corpus.scan(corpus.from_sources(spark, [("Outer", NESTED)])).select("type", "method", "is_ctor", "identifier")


@golden("doc, n", [("a.b.Outer#Outer(C)", 4), ("a.b.Inner#run", 2), ("a.b.Outer#name", 3), ("a.b.Outer#make", 3), ("a.b.Outer#cost", 2)])
def golden_containers(spark, d):
    ids = corpus.scan(corpus.from_sources(spark, [("Outer", NESTED)]))
    return ids.groupBy(corpus.container().alias("doc")).agg(F.count("*").cast("int").alias("n"))


@golden("identifier, n", [("swap", 1), ("arr", 5), ("i", 3), ("j", 3), ("tmp", 2)])
def golden_subtree(spark, d):
    """One method of one type."""
    return corpus.scan_subtree(_sources(spark, 1), "Sort1", "swap").groupBy("identifier").agg(F.count("*").cast("int").alias("n"))


@golden("source_name", [("broken",), ("only_package",), ("empty",)])
def golden_unparsed(spark, d):
    """Files that give no words: a broken one, one with a package and nothing else, an empty one."""
    files = [("broken", "}{ void ((( x"), ("only_package", "package a.b;"), ("empty", ""), ("fine", NESTED), ("null", None)]
    return corpus.without_scope(corpus.from_sources(spark, files).where("content IS NOT NULL"))


@golden("name, pos, identifier, error", [("bad", None, None, "scan failed"), ("good", 0, "x", None)])
def golden_failing_file(spark, d):
    """A file whose scan fails gives one row with the error; the others come out whole."""

    def scan(text):
        if text == "bad":
            raise ValueError("scan failed")
        return [(0, "", None, None, False, "x")]

    files = corpus.from_sources(spark, [("bad", "bad"), ("good", "good")])
    return javalex.java_identifiers(files, scanner=scan).select(F.col("source_name").alias("name"), "pos", "identifier", "error")


@golden("word, cnt", [("alpha", 2), ("beta", 1)])
def golden_literal_words(spark, d):
    """Words given in the program, without documents."""
    return counting.count_words(corpus.literal_words(spark, ["alpha", "beta", "alpha"]))[0].select("word", F.col("cnt").cast("int").alias("cnt"))


@golden("list, word", [("mine", "alpha"), ("mine", "beta"), ("mine", "don't"), ("custom", "gamma")])
def golden_stop_lists(spark, d):
    """Lines with comments and several words to a list, and a custom one."""
    lines = _column(spark, ["alpha  Beta | a comment", "| only a comment", "", "ALPHA don't"], "value")
    return stopwords.add_words(stopwords.parse_words(lines, "mine"), _column(spark, ["Gamma", "", None, "gamma"]))


# selection

_SCORES = {1: [1.265920, 1.066215, 0.833932, 0.833932], 3: [3.797761, 3.198645, 2.501797, 2.501797], 5: [6.329601, 5.331075, 4.169662, 4.169662]}


def _select(copies: int, k: int | None):
    rows = list(zip(WORDS, _SCORES[copies]))[: k if k is not None else 4]

    def run(spark, d):
        return select.weighted_words(_extracted(spark, copies), select.clamp(k)).select("word", F.round("score", 4).alias("score"))

    run.__name__ = f"golden_select_{copies}_{'all' if k is None else k}"
    golden("word, score", [(w, round(s, 4)) for w, s in rows])(run)


for _copies in (1, 3, 5):
    for _k in (None, 2):
        _select(_copies, _k)


@golden("word, cnt", [("pivot", 30), ("partition", 20), ("quicksort", 20), ("randomized", 10)])
def golden_frequent(spark, d):
    return select.frequent_words(_extracted(spark, 5)).select("word", F.col("cnt").cast("int").alias("cnt"))


@golden("word, doc, n", [("partition", "p.q.Sort1#partition", 1), ("pivot", "p.q.Sort1#partition", 3)])
def golden_white_set(spark, d):
    """Only the methods of a white set, in any case."""
    return _extracted(spark, 1, methods=["PARTITION"]).groupBy("word", "doc").agg(F.count("*").cast("int").alias("n"))


@golden("word", [("quicksort",), ("pivot",), ("partition",), ("randomized",), ("left",), ("right",), ("index",), ("next",), ("swap",), ("rand",), ("length",), ("println",), ("system",), ("string",), ("main",)])
def golden_few_stop_lists(spark, d):
    """Without the list of interface words and the custom one more words stay."""
    return select.extract(_sources(spark, 1), stop_lists=("english", "java")).select("word").distinct()


def _shout(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    return words.select("word", F.upper("word").alias("corrected"))


@golden("word, n", [("PIVOT", 6), ("PARTITION", 4), ("QUICKSORT", 4), ("RANDOMIZED", 2)])
def golden_corrector(spark, d):
    """A corrector of one's own."""
    dic = spark.createDataFrame([("pivot", 1)], "word string, freq long")
    return _extracted(spark, 1, dictionary=dic, corrector=_shout).groupBy("word").agg(F.count("*").cast("int").alias("n"))


@golden("word, corrected", [("txt", "text"), ("config", "configuration"), ("err", "error"), ("str", "string"), ("the", "the"), ("zzzzzz", "zzzzzz")])
def golden_spelling(spark, d):
    dic = spark.createDataFrame([("text", 50), ("configuration", 40), ("error", 60), ("string", 30), ("the", 1000)], "word string, freq long")
    return spelling.corrections(_column(spark, ["txt", "config", "err", "str", "the", "zzzzzz"]), dic)


@golden("case_id, word, cnt", [("skipped", "a", 2), ("skipped", "b", 1)])
def golden_null_guard(spark, d):
    """A null word is skipped, or voids the whole list."""
    words = spark.createDataFrame([("a", "x", 0), (None, "x", 1), ("a", "y", 2), ("b", "y", 3)], "word string, doc string, pos int")
    void = counting.count_words(words, null_voids=True)[0].select(F.lit("voided").alias("case_id"), "word", "cnt")
    return counting.count_words(words)[0].select(F.lit("skipped").alias("case_id"), "word", "cnt").unionByName(void).select("case_id", "word", F.col("cnt").cast("int").alias("cnt"))


@golden("case_id, word, cnt", [("earlier", "word", 2), ("later", "words", 1), ("later", "word", 1)])
def golden_folding(spark, d):
    """A plural folds only into a singular that came before it."""
    out = None
    for name, stream in (("earlier", ["word", "words"]), ("later", ["words", "word"])):
        got = counting.count_words(spark.createDataFrame([(w, "d", i) for i, w in enumerate(stream)], "word string, doc string, pos int"))[0].select(F.lit(name).alias("case_id"), "word", F.col("cnt").cast("int").alias("cnt"))
        out = got if out is None else out.unionByName(got)
    return out


# latent space

_LSI1 = {"quicksort": [0.261773, 0.013058, 0.013058, 0.921912], "partition": [0.282214, 0.453407, 0.453407, 0.128990], "pivot": [0.228007, 0.279825, 0.279825, 0.103539], "randomized": [0.228007, 0.279825, 0.279825, 0.103539]}
_LSI3 = {"quicksort": [0.178157, 0.004534, 0.004534, 0.164245], "partition": [0.132286, 0.108438, 0.108438, 0.015828], "pivot": [0.140574, 0.088024, 0.088024, 0.016710], "randomized": [0.140574, 0.088024, 0.088024, 0.016710]}
_OLD1 = {"quicksort": [1.038188, -0.026423, -0.026423, 0.957118], "partition": [1.119258, 0.917484, 0.917484, -0.133916], "pivot": [0.904272, 0.566235, 0.566235, 0.107493], "randomized": [0.904272, 0.566235, 0.566235, 0.107493]}


def _cells(table: dict, copies: int) -> list[tuple]:
    return [(w, f"{c}{d}", round(x, 4)) for w, xs in table.items() for d, x in zip(DOCS, xs) for c in range(copies)]


@golden("word, doc, w", _cells(_LSI1, 1))
def golden_lsi_1(spark, d):
    """As many words as documents: each document's cells are normalised."""
    return lsi.lsi_matrix(_incidence(spark, 1)).select("word", "doc", F.round("w", 4).alias("w"))


@golden("word, doc, w", _cells(_LSI3, 3))
def golden_lsi_3(spark, d):
    """More documents than words: each word's cells are normalised."""
    return lsi.lsi_matrix(_incidence(spark, 3)).select("word", "doc", F.round("w", 4).alias("w"))


@golden("word, doc, x", _cells(_OLD1, 1))
def golden_lsi_older(spark, d):
    return lsi.lsi_older(_incidence(spark, 1)).select("word", "doc", F.round("x", 4).alias("x"))


@golden("i, j, x", [(0, 0, 2.5), (0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 1, 1.5), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)])
def golden_sigma(spark, d):
    s = lsi.sigma([2.5, 1.5], 3)
    return spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(3)], "i int, j int, x double")


@golden("k, q", [(0, 1.0), (1, float("nan"))])
def golden_fold_in(spark, d):
    """q^T U S^-1; a singular value of 0 gives NaN."""
    q = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "term string, weight double")
    u = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0), ("b", 1, 1.0)], "word string, k int, x double")
    return search.fold_in(q, u, spark.createDataFrame([(0, 2.0), (1, 0.0)], "k int, s double"))


@golden("word, x", [(w, x) for w, x in (("quicksort", 1.0), ("partition", 0.0), ("pivot", 0.0), ("randomized", 0.0))])
def golden_item_vectors(spark, d):
    """An item's vector is its row of the matrix: here the cell of the document main."""
    v = clustering.vectors(_full(_incidence(spark, 1)), "word", "doc", "x")
    return v.select(F.col("item").alias("word"), F.element_at("vec", 1).alias("x"))


def _full(m: DataFrame) -> DataFrame:
    grid = m.select("word").distinct().crossJoin(m.select("doc").distinct())
    return grid.join(m, ["word", "doc"], "left").select("word", "doc", F.coalesce("x", F.lit(0.0)).alias("x"))


_ONE, _TWO = [(0, "[quicksort]"), (1, "[partition, pivot, randomized]")], [(0, "[quicksort, partition, pivot, randomized]")]


def _word_groups(name: str, copies: int, metric: str, rows: list[tuple]):
    def run(spark, d):
        return clustering.group_strings(select.group_words(_indexed(spark, copies), metric=metric)).select(F.col("group").alias("group_id"), "items")

    run.__name__ = name
    golden("group_id, items", rows)(run)


_word_groups("golden_word_groups_1", 1, "max_product", _ONE)
_word_groups("golden_word_groups_3", 3, "max_product", _TWO)
_word_groups("golden_word_groups_3_cosine", 3, "cosine", _ONE)


@golden("group_id, doc", [(0, "main"), (0, "quicksort"), (1, "partition"), (1, "randomizedPartition")])
def golden_doc_groups(spark, d):
    """Documents of the latent space, in the order quicksort, randomizedPartition, partition, main."""
    cells = lsi.lsi_matrix(_incidence(spark, 1))
    order = spark.createDataFrame([(f"0{n}", i) for i, n in enumerate(DOCS, 1)], "item string, ord int")
    items = clustering.vectors(cells, "doc", "word", "w").join(order, "item")
    return clustering.grouped(items, lambda x: clustering.kmeans(x)[0]).select(F.col("group").alias("group_id"), F.expr("substring(item, 2)").alias("doc"))


@golden("step, group_id, item, near", [("all", 0, "a", 1.0), ("all", 0, "b", 0.8), ("all", 1, "c", 1.0), ("less", 0, "a", 1.0), ("less", 1, "c", 1.0), ("none", 0, "a", 0.0), ("none", 0, "b", 0.0), ("none", 1, "c", 0.0)])
def golden_group_members(spark, d):
    """Proximity to the center (0 without one) and the groups without an item."""
    members = spark.createDataFrame([(0, "a", [1.0, 0.0]), (0, "b", [0.8, 0.6]), (1, "c", [0.0, 2.0])], "group int, item string, vec array<double>")
    centers = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 1.0])], "group int, vec array<double>")
    g = clustering.Groups(members, None, centers)
    steps = {"all": g, "less": g.add(1, "d", [1.0, 1.0]).remove("d").remove("b"), "none": clustering.Groups(members)}
    out = None
    for name, x in steps.items():
        got = x.proximity().select(F.lit(name).alias("step"), F.col("group").alias("group_id"), "item", F.round("proximity", 6).alias("near"))
        out = got if out is None else out.unionByName(got)
    return out


@golden("kind, item", [("word", "partition"), ("word", "pivot"), ("word", "quicksort"), ("word", "randomized"), ("doc", "p.q.Sort1#main"), ("doc", "p.q.Sort1#partition"), ("doc", "p.q.Sort1#quicksort"), ("doc", "p.q.Sort1#randomizedPartition")])
def golden_flow(spark, d):
    """The whole flow: groups carry the index they were made from."""
    flow = select.Selection(_sources(spark, 1), extra_stops=_column(spark, STOPS))
    found = flow.word_groups()
    words = found.members.select(F.lit("word").alias("kind"), "item")
    return words.unionByName(found.index.docs.select(F.lit("doc").alias("kind"), F.col("doc").alias("item")))


def _search(name: str, keyword: str, copies: int, scores: list[float]):
    rows = [(f"{c}{n}", round(x, 4)) for n, x in zip(DOCS, scores) for c in range(copies)]

    def run(spark, d):
        return search.search_docs(lsi.lsi_matrix(_incidence(spark, copies)), _column(spark, [keyword])).select("item", F.round("score", 4).alias("score"))

    run.__name__ = name
    golden("item, score", rows)(run)


_search("golden_search_quicksort", "quicksort", 1, [0.521315, 0.021692, 0.021692, 0.978324])
_search("golden_search_partition", "partition", 1, [0.562024, 0.753221, 0.753221, 0.136883])
_search("golden_search_pivot", "pivot", 1, [0.454071, 0.464859, 0.464859, 0.109875])
_search("golden_search_quicksort_3", "quicksort", 3, [0.597985, 0.027455, 0.027455, 0.985335])
_search("golden_search_pivot_3", "pivot", 3, [0.471838, 0.532983, 0.532983, 0.100249])
_search("golden_search_unknown", "unknown", 1, [float("nan")] * 4)


@golden("pos, line", [(0, "m" + " " * 15 + "      D0      D1"), (1, " " * 14 + "a  1.0000  0.0000"), (2, " " * 14 + "b  0.5000  2.0000"), (3, "0 - x"), (4, "1 - y")])
def golden_matrix_lines(spark, d):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.5), ("b", "y", 2.0)], "word string, doc string, x double")
    return sinks.matrix_lines(m, ["x", "y"], "m").select(F.col("at").alias("pos"), "line")


# inflection

@golden("op, input, result", [("plural", "peach", "peaches"), ("singular", "peaches", "peach"), ("plural", "axon", "axa"), ("singular", "axa", "axon"), ("plural", "goose", "geese"), ("singular", "geese", "goose"), ("plural", "grid", "grid"), ("cleared", "peaches", "peaches")])
def golden_grammar(spark, d):
    """Rules of one's own, and none."""
    own = inflect.Grammar().plural("(ax)on$", "$1a").singular("(ax)a$", "$1on").irregular("goose", "geese").uncountable("grid")
    asked = lambda op, words, f: _column(spark, words, "input").select(F.lit(op).alias("op"), "input", f("input").alias("result"))
    return asked("plural", ["peach", "axon", "goose", "grid"], own.plural_of).unionByName(asked("singular", ["peaches", "axa", "geese"], own.singular_of)).unionByName(asked("cleared", ["peaches"], own.clear().singular_of))


@golden("a, b, same", [("s$", "S$", True), ("s$", "ss$", False)])
def golden_equal_rules(spark, d):
    pairs = [("s$", "S$"), ("s$", "ss$")]
    return spark.createDataFrame([(a, b, inflect.same_rule((a, ""), (b, "x"))) for a, b in pairs], "a string, b string, same boolean")
