import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm.canonical import edit_distances, map_rows, map_values, notations, unmatched

WORDS = ["accumulator", "barrier", "boundary", "builder", "bundle", "configuration", "consistency", "covariance", "cache", "shortcut", "thread", "timestamp", "overload", "network path"]


def reference(spark):
    return spark.createDataFrame([(i, w, 100 + i) for i, w in enumerate(WORDS, 1)], "term_id int, word string, freq long")


def mapped(spark, values):
    df = spark.createDataFrame([(v, "x") for v in values], "element string, score string")
    return {r["value"]: r["key"] for r in map_values(df, reference(spark)).collect()}


def test_notations_of_a_word(spark):
    want = {
        "Bundle": 5, "  bundle ": 5, "bu ndle": 5, "m_bundle": 5, "bundle12": 5, "ｂｕｎｄｌｅ": 5, "bünd\u200ble": 5, "bundlе": 5, "b0undary": 3, "bunfary": 3, "config": 6,
        "brrr": 2, "bldr": 4, "consistencies": 7, "acumulator": 1, "cahce": 9, "shor": 10, "networkpath": 14, "path network": 14,
        "garlic bread": None, "komclebru": None, "42%": None, "???": None, "0x1234abcd": None, "x" * 5000: None,
    }
    assert mapped(spark, [*want, None, "", "   "]) == want


def test_rows_by_id(spark):
    rows = spark.createDataFrame([(1, "cahce", 1), (1, "thread", 2), (2, "zzz", 1), (3, None, 1), (4, " ", 1), (5, "cahce", 1), (5, "cahce", 1)], "typed_id long, element string, loaded_at int")
    out = map_rows(rows, reference(spark))
    assert {(r["id"], r["key"]) for r in out.collect()} == {(1, 11), (2, 0), (5, 9)}
    assert [tuple(r) for r in unmatched(out).collect()] == [("zzz", 1)]
    assert map_rows(rows.where("false"), reference(spark)).count() == 0
    assert {r["key"] for r in map_rows(rows, reference(spark).where("false")).collect()} == {0}


def plain_osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_edit_distances(pairs):
    a, b = zip(*pairs)
    assert edit_distances(list(a), list(b)).tolist() == [plain_osa(x, y) for x, y in pairs]


def test_filters_lose_nothing(spark, monkeypatch):
    from lexforge.llm import canonical as C

    r = random.Random(3)
    vocab = sorted({"".join(r.choice("abcde") for _ in range(r.randint(3, 12))) for _ in range(60)})
    typed = sorted({"".join(r.choice("abcde") for _ in range(r.randint(3, 12))) for _ in range(120)} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in vocab for i in (0, len(w) // 2 - 1)})
    monkeypatch.setattr(C, "VOCABULARY", 25)
    frame = lambda c, x: spark.createDataFrame([(t,) for t in x], f"{c} string")
    got = {(x["token"], x["word"]): x["sim"] for x in C.correct_tokens(frame("token", typed), frame("word", vocab)).collect()}
    want = {(t, v): s for v in vocab for t, s in C.shortened(v).items() if t in typed}
    for t in typed:
        for v in vocab:
            d = plain_osa(t, v)
            if d <= C.reach(len(v)) and (s := 1 - d / max(len(t), len(v))) >= C.CLOSE:
                want[t, v] = max(s, want.get((t, v), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_shortened_forms():
    from lexforge.llm.canonical import ACCEPT, shortened

    forms = shortened("configuration")
    assert ACCEPT < forms["con"] < forms["config"] < forms["configuratio"] < 1 and forms["cnfgrtn"] > ACCEPT
    assert shortened("abc") == {}


def test_readings():
    assert notations("##") == [] and notations("co_variance")[1][1] == ["covariance"]
