import math

import pytest
from pyspark.sql import functions as F

from lexforge.functions import inflect, similarity, tokens
from lexforge.sources import stopwords


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("value", "pieces"),
    [("getHTTPResponse", ["get", "HTTP", "Response"]), ("parse_XML", ["parse", "XML"]), ("_foo", ["foo"]), ("JScrollPane", ["J", "Scroll", "Pane"]), ("ABC", ["ABC"]), ("vec4f", ["vec4f"]), ("", [])],
)
def test_camel_pieces(spark, value, pieces):
    assert column(spark, [value], tokens.camel_pieces) == [pieces]


def test_one_kind_of_letter(spark):
    values = ["txt", "err", "args", "aei", "string", "sky", "ng", "config", "", None]
    assert column(spark, values, tokens.one_kind_of_letter) == [True] * 4 + [False] * 6


def test_plural_and_singular(spark):
    plural = {"peach": "peaches", "peaches": "peaches", "index": "indices", "calf": "calves", "cat": "cats", "regex": "regices", "human": "humen", "equipment": "equipment", "person": "people"}
    assert column(spark, list(plural), inflect.plural_of) == list(plural.values())
    singular = {"peaches": "peach", "peach": "peach", "this": "thi", "specimen": "speciman", "bus": "bus", "news": "news", "children": "child"}
    assert column(spark, list(singular), inflect.singular_of) == list(singular.values())
    assert column(spark, ["nouns"], lambda c: inflect.is_plural("v")) == [True]
    assert column(spark, ["estimate"], lambda c: inflect.is_singular("v")) == [True]
    assert column(spark, ["Rice ", None], inflect.is_uncountable) == [True, False]


def test_rules_need_a_pattern():
    with pytest.raises(ValueError):
        inflect.checked([("", "s")])


def test_distance_and_gate(spark):
    df = spark.createDataFrame([("", "abc"), ("kitten", "sitting"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(similarity.distance(F.col("a"), F.col("b"))).collect()] == [0, 3, 0]
    # 7 edits of 10 letters: 1 - 0.7 is not above 0.3 in 32 bits
    gate = spark.createDataFrame([("abcdefghij", "abcklmnopq")], "a string, b string").select(similarity.similar_enough(F.col("a"), F.col("b"))).first()[0]
    assert gate is False


def test_vector_similarity(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(similarity.abs_cosine(F.col("a"), F.col("b")), similarity.max_product(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(0.8) and rows[0][1] == pytest.approx(0.4)
    assert math.isnan(rows[1][0]) and math.isnan(rows[1][1])


def test_documents(spark):
    values = ["a.B#m", "a.B", "a#b#c", "a.B#"]
    assert column(spark, values, tokens.doc_path) == ["a.B", "a.B", "a#b", "a.B"]
    assert column(spark, values, tokens.doc_method) == ["m", "", "c", ""]
    assert column(spark, values, lambda c: tokens.doc_name(tokens.doc_path(c), tokens.doc_method(c)))[3] == "a.B"


def test_stop_words(spark, tmp_path):
    assert column(spark, ["x", "don’t", "cache"], lambda c: stopwords.is_stop_word(c, ["don't"])) == [True, True, False]
    (tmp_path / "list.txt").write_text("One two | three\n| four\nONE\n")
    assert {r["word"] for r in stopwords.load_words(spark, str(tmp_path), "mine").collect()} == {"one", "two"}
    extra = spark.createDataFrame([("Cache",), ("",), (None,)], "word string")
    custom = stopwords.stop_words(spark, ("java",), extra).where("list = 'custom'").collect()
    assert [r["word"] for r in custom] == ["cache"]
