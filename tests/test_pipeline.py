import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import clustering, counting, index, lsi, search, sinks, spelling
from lexforge.plans import select
from lexforge.sources import corpus, dictionary, javalex

SORT = """package p.q;

import java.util.Random;

/** quicksort pivot in a comment */
public class {name} {{
  private static final Random rand = new Random();

  public static void quicksort(int[] arr, int left, int right) {{
    int pivot = randomizedPartition(arr, left, right);
    quicksort(arr, left, pivot);
    quicksort(arr, pivot, right);
  }}

  private static int randomizedPartition(int[] arr, int left, int right) {{
    int swapIndex = left + rand.nextInt(right - left);
    swap(arr, left, swapIndex);
    return partition(arr, left, right);
  }}

  private static int partition(int[] arr, int left, int right) {{
    int pivot = arr[right];
    int i = left - 1;
    int j = right;
    while (true) {{
      while (arr[++i] < pivot);
      while (j > 0 && arr[--j] > pivot);
      if (i >= j) break;
      swap(arr, i, j);
    }}
    return i;
  }}

  private static void swap(int[] arr, int i, int j) {{ int tmp = arr[i]; arr[i] = arr[j]; arr[j] = tmp; }}

  public static void main(String[] args) {{
    quicksort(null, 0, args.length - 1);
    System.out.println("quicksort");
  }}
}}
"""
STOPS = ["left", "right", "index", "next", "swap", "main", "rand", "length", "println"]


def program(spark, copies):
    return corpus.from_sources(spark, [(f"Sort{i}", SORT.format(name=f"Sort{i}")) for i in range(1, copies + 1)])


def words(spark, copies):
    extra = spark.createDataFrame([(w,) for w in STOPS], "word string")
    return select.extract(program(spark, copies), extra_stops=extra)


def test_lexer_containers():
    rows = javalex.identifiers("package a; class T { T() { x1(); } enum E { A(1) { void m() { y1(); } }; void n() { z1(); } } Object f = new Object() { public int g() { return hh; } }; }")
    owner = {r[5]: (r[2], r[3], r[4]) for r in rows if r[3]}
    assert owner["x1"] == ("T", "T", True)
    assert owner["y1"][1] == "m" and owner["z1"][1] == "n" and owner["hh"][1] == "g"
    assert javalex.identifiers("") == []
    nested = {r[5]: r[3] for r in javalex.identifiers("class A { void f() { run(new C<X>() { public void g() { in1(); } }); out1(); } }") if r[3]}
    assert nested["in1"] == "g" and nested["out1"] == "f"


@pytest.mark.parametrize("copies", [1, 3, 5])
def test_counts_and_scores_of_the_sort_program(spark, copies):
    w = words(spark, copies).cache()
    counts = {r["word"]: r["cnt"] for r in select.frequent_words(w).collect()}
    assert {k: counts[k] for k in ("pivot", "quicksort", "partition", "randomized")} == {"pivot": 6 * copies, "quicksort": 4 * copies, "partition": 4 * copies, "randomized": 2 * copies}
    scores = {r["word"]: r["score"] for r in select.weighted_words(w).collect()}
    expected = {"quicksort": 1.265920, "partition": 1.066215, "pivot": 0.833932, "randomized": 0.833932}
    assert set(scores) == set(expected)
    for word, score in expected.items():
        assert scores[word] == pytest.approx(score * copies, abs=1e-5)
    assert sum(scores.values()) == pytest.approx(4 * copies)


def test_white_set_and_subtree(spark):
    src = program(spark, 1)
    assert {r["method"] for r in corpus.scan_subtree(src, method="swap").collect()} == {"swap"}
    assert {r["doc"] for r in select.extract(src, methods=["PARTITION"]).collect()} == {"p.q.Sort1#partition"}
    assert select.clamp(-1) == 0 and select.clamp(10) == 10 and select.clamp(1000) == 150


def incidence(spark, copies):
    docs = {"quicksort": "quicksort partition pivot randomized", "randomizedPartition": "partition randomized", "partition": "partition pivot", "main": "quicksort"}
    docs["quicksort"], docs["randomizedPartition"] = "quicksort pivot randomized partition", "randomized partition"
    rows = [(w, f"{c}{d}", 1.0) for c in range(copies) for d, ws in docs.items() for w in ws.split()]
    return spark.createDataFrame(rows, "word string, doc string, x double")


@pytest.mark.parametrize(("copies", "golden"), [(1, [0.261773, 0.013058, 0.013058, 0.921912]), (3, [0.178157, 0.004534, 0.004534, 0.164245])])
def test_lsi_goldens(spark, copies, golden):
    got = {(r["word"], r["doc"]): r["w"] for r in lsi.lsi_matrix(incidence(spark, copies)).collect()}
    for name, value in zip(("quicksort", "randomizedPartition", "partition", "main"), golden):
        assert got["quicksort", f"0{name}"] == pytest.approx(value, abs=1e-5)
    assert lsi.rank_of(4, 12) == 2


@pytest.mark.parametrize(("copies", "metric", "want"), [(1, "max_product", {("quicksort",), ("partition", "pivot", "randomized")}), (3, "max_product", {("quicksort", "partition", "pivot", "randomized")}), (3, "cosine", {("quicksort",), ("partition", "pivot", "randomized")})])
def test_word_groups(spark, copies, metric, want):
    m = lsi.lsi_matrix(incidence(spark, copies))
    order = spark.createDataFrame([("quicksort", 1), ("partition", 2), ("pivot", 3), ("randomized", 4)], "item string, ord int")
    groups, _ = clustering.kmeans(clustering.vectors(m, "word", "doc", "w").join(order, "item"), metric=metric)
    got = {}
    for r in groups.orderBy("ord").collect():
        got.setdefault(r["group"], []).append(r["item"])
    assert {tuple(v) for v in got.values()} == want


def test_search_goldens(spark):
    m = lsi.lsi_matrix(incidence(spark, 1))
    key = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = {r["item"]: r["score"] for r in search.search_docs(m, key("quicksort")).collect()}
    assert got["0quicksort"] == pytest.approx(0.521315, abs=1e-5) and got["0main"] == pytest.approx(0.978324, abs=1e-5)
    none = search.search_docs(m, key("zzz")).collect()
    assert len(none) == 4 and all(math.isnan(r["score"]) for r in none)
    assert search.search_docs(m, key("zzz"), on_no_match="empty").count() == 0


def test_the_long_side_needs_no_gram_matrix(spark, monkeypatch):
    want = {(r["word"], r["doc"]): r["x"] for r in lsi.project(incidence(spark, 3)).collect()}
    monkeypatch.setattr(lsi, "MAX_SIDE", 2)
    got = {(r["word"], r["doc"]): r["x"] for r in lsi.project(incidence(spark, 3)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_grouping_columns_equals_grouping_rows(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(12, 30))
    items = spark.createDataFrame([(f"i{k:02d}", [float(v) for v in row]) for k, row in enumerate(x)], "item string, vec array<double>")
    columns = spark.createDataFrame([([float(v) for v in row],) for row in x.T], "vec array<double>")
    for metric in ("max_product", "cosine"):
        a = {r["item"]: r["group"] for r in clustering.kmeans(items, metric=metric, passes=3)[0].collect()}
        b = {r["item"]: r["group"] for r in clustering.kmeans_columns(columns, [f"i{k:02d}" for k in range(12)], metric=metric, passes=3).collect()}
        assert a == b and len(set(a.values())) > 1


def test_long_chains_of_singulars(spark, monkeypatch):
    monkeypatch.setattr(counting, "singular_of", lambda c: F.expr(f"CASE WHEN length({c}) > 1 THEN substring({c}, 1, length({c}) - 1) ELSE {c} END"))
    words = ["a" * n for n in range(1, 9)]
    stats = spark.createDataFrame([(w, 1, i) for i, w in enumerate(words)], "word string, n long, first_pos int")
    # every second word of the chain is an entry
    assert {r["word"]: r["root"] for r in counting.fold_roots(stats).collect()} == {w: w if len(w) % 2 else w[:-1] for w in words}


def test_kept_tables_are_released(spark):
    from lexforge import storage

    kept = storage.keep(spark.range(3))
    assert kept.count() == 3 and storage.release(spark) > 0 and storage.release(spark) == 0


def test_rows_are_dealt_out_only_where_splits_are_few(spark, tmp_path):
    from lexforge.storage import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.range(0, 100, 1, 16)
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(many) is many and spread(one).count() == 100


def test_positions_of_any_id(spark):
    texts = [("b", "beta alpha"), ("a", "alpha alpha")]
    by_name = corpus.text_tokens(spark.createDataFrame(texts, "doc_id string, text string"))
    by_number = corpus.text_tokens(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts, 2**60)], "doc_id long, text string"))
    assert [r["word"] for r in by_name.orderBy("pos").collect()] == ["alpha", "alpha", "beta", "alpha"]
    assert [r["word"] for r in by_number.orderBy("pos").collect()] == ["beta", "alpha", "alpha", "alpha"]
    assert counting.token_total(by_name).first()["total"] == 4


def test_fold_in(spark):
    q = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "term string, weight double")
    u = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0), ("b", 1, 1.0)], "word string, k int, x double")
    s = spark.createDataFrame([(0, 2.0), (1, 0.0)], "k int, s double")
    got = {r["k"]: r["q"] for r in search.fold_in(q, u, s).collect()}
    assert got[0] == 1.0 and math.isnan(got[1])


def test_folding_equals_a_sequential_count(spark):
    r = random.Random(5)
    stream = [r.choice(["word", "words", "bus", "buses", "class", "classes", "this", "thi", "index", "indices"]) for _ in range(200)]
    from lexforge.functions.inflect import singular_of

    single = {x["word"]: x["s"] for x in spark.createDataFrame([(w,) for w in set(stream)], "word string").select("word", singular_of(F.col("word")).alias("s")).collect()}
    counts = {}
    for w in stream:
        if w not in counts and single[w] != w and single[w] in counts:
            counts[single[w]] += 1
        else:
            counts[w] = counts.get(w, 0) + 1
    df = spark.createDataFrame([(w, "d", i) for i, w in enumerate(stream)], "word string, doc string, pos int")
    assert {x["word"]: x["cnt"] for x in counting.count_words(df)[0].collect()} == counts


def test_folded_containers_are_lost(spark):
    df = spark.createDataFrame([("word", "a", 0), ("words", "b", 1), (None, "c", 2)], "word string, doc string, pos int")
    counts, postings = counting.count_words(df)
    assert [tuple(r) for r in counts.collect()] == [("word", 2)] and [tuple(r) for r in postings.collect()] == [("word", "a")]
    assert {r["doc"] for r in counting.count_words(df, merge_plural_containers=True)[1].collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        counting.top_words(counts, -1)


def test_spelling(spark):
    dic = spark.createDataFrame([("text", 50), ("configuration", 40), ("error", 60), ("string", 30), ("the", 1000)], "word string, freq long")
    got = {r["word"]: r["corrected"] for r in spelling.corrections(spark.createDataFrame([(w,) for w in ("txt", "config", "err", "str", "the", "zzzzzz")], "word string"), dic).collect()}
    assert all(got[w] in {"text", "configuration", "error", "string"} for w in ("txt", "config", "err", "str"))
    assert got["the"] == "the" and got["zzzzzz"] == "zzzzzz"


def test_dictionary(spark):
    t = spark.createDataFrame([("parseXML parse_xml txt 12 abc1 a1b2",)], "text string")
    assert {r["word"]: r["freq"] for r in dictionary.build_dictionary(t).collect()}["parse"] == 2


def test_matrix_operations(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "y", float("nan")), ("b", "x", 3.0)], "word string, doc string, x double")
    assert {r["word"]: r["total"] for r in index.row_sums(m).collect()} == {"a": 1.0, "b": 3.0}
    assert math.isnan({r["doc"]: r["total"] for r in index.col_sums(m).collect()}["y"])
    assert {r["x"] for r in index.divide(m.where("word = 'b'"), 0).collect()} == {float("inf")}
    assert {(r["word"], r["D0"].strip(), r["D1"].strip()) for r in sinks.matrix_text(m, ["x", "y"]).collect()} == {(f"{'a':>15}", "1.0000", "0.0000"), (f"{'b':>15}", "3.0000", "0.0000")}
    assert index.delete_column(m, "x").count() == 1 and index.transpose(m).where("word = 'x'").count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "word string, doc string, pos int")
    assert select.weighted_words(none).count() == 0 and select.frequent_words(none).count() == 0
    assert clustering.kmeans(spark.createDataFrame([], "item string, ord int, vec array<double>"))[0].count() == 0


def test_selection_flow(spark):
    s = select.Selection(program(spark, 1), extra_stops=spark.createDataFrame([(w,) for w in STOPS], "word string"))
    groups = s.word_groups()
    assert {r["item"] for r in groups.members.collect()} == {"quicksort", "pivot", "partition", "randomized"}
    assert not groups.is_empty() and groups.index is s.index()
    docs = s.doc_groups()
    assert docs.proximity().count() == 4 and docs.members.select("item").distinct().count() == 4
    assert s.methods(spark.createDataFrame([("pivot",)], "word string")).count() >= 1


def test_stream(spark, tmp_path):
    from lexforge.streaming.word_counts import windowed_word_counts

    spark.createDataFrame([("2024-01-01 00:00:00", "a b a")], "at string, text string").selectExpr("timestamp(at) at", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in"))
    q = windowed_word_counts(stream, "at", "text").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["word"]: r["cnt"] for r in spark.sql("select * from counts").collect()} == {"a": 2, "b": 1}


def test_entry_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert "weighted_words_top150" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
