import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.llm.distinctive import term_scores, top_terms
from lexforge.llm.heavy_hitters import frequent_items, heavy_hitters, shrink
from lexforge.llm.term_frequency import term_frequencies
from lexforge.llm.words_common import record_names, valid_words

RAW = "word_id long, element string, value int, container string, scanned_at long, loaded_at long, position string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def sample(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        box = "Hot " if r.random() < 0.35 else r.choice(["a", "B", "c ", None, "  "])
        out.append((i, r.choice(["x", "X ", "y", "yy", "z", "w", None, " ", "x"]), r.choice([1, 1, 2, None, 0, -3]), box, r.randint(0, 5000), i, "clash"))
    return out + [out[3][:5] + (9999, "clash"), out[5]]


def clean(rows):
    last = {}
    for r in rows:
        if r[1] is not None and r[1].strip() and (r[2] is None or r[2] >= 1) and (r[0] not in last or r[5] >= last[r[0]][5]):
            last[r[0]] = r
    return [(r[1].strip().lower(), (r[3] or "").strip().lower() or None, 1 if r[2] is None else r[2], r[4], r[0]) for r in last.values()]


@pytest.mark.parametrize("max_n", [1, 3])
def test_term_frequencies_equal_brute_force(spark, max_n):
    rows = sample()
    df = raw(spark, rows)
    names, seed = record_names(df)
    t = term_frequencies(valid_words(df, seed=seed), max_n=max_n)
    got = {(r["n"], r["term"]): (r["occurrences"], r["total"], r["records"]) for r in t.collect()}
    want: dict = {}
    held = clean(rows)
    for e, c, v, at, i in held:
        if c is None:
            want.setdefault((1, e), []).append((c, v))
    for box in {c for _, c, *_ in held if c}:
        seq = sorted((x for x in held if x[1] == box), key=lambda x: (x[3], x[4]))
        for k in range(len(seq)):
            for n in range(1, max_n + 1):
                if k + n <= len(seq):
                    want.setdefault((n, " ".join(x[0] for x in seq[k : k + n])), []).append((box, seq[k][2]))
    assert got == {k: (len(v), sum(x[1] for x in v), len({x[0] for x in v} - {None})) for k, v in want.items()}


def test_runs_of_any_length(spark):
    """With no greatest length the array is deepened until nothing occurs twice."""
    run = [f"w{k}" for k in range(9)]
    rows = [(100 * b + i, w, 1, f"r{b}", i, 0, "") for b, seq in enumerate([["a", *run, "b"], ["c", *run, "d"], ["e"]]) for i, w in enumerate(seq)]
    got = {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in term_frequencies(valid_words(raw(spark, rows)), max_n=None).collect()}
    assert max(n for n, _ in got) == 9 and got[9, " ".join(run)] == (2, 2)
    assert {k for k, v in got.items() if v[0] > 1} == {(n, " ".join(run[i : i + n])) for n in range(1, 10) for i in range(10 - n)}
    alone = raw(spark, rows[:1])
    assert [tuple(r)[:3] for r in term_frequencies(valid_words(alone), max_n=None).collect()] == [(1, "a", 1)]


def test_marks_and_empty_table(spark):
    df = raw(spark, [(1, "a", 1, "r1", 0, 0, ""), (2, "b", 5, "r1", 0, 0, ""), (3, "b", 5, "r2", 0, 0, "")])
    t = term_frequencies(valid_words(df), common_share=1.0)
    assert {r["term"]: r["mark"] for r in t.collect()} == {"a": "rare", "b": "common"}
    assert term_frequencies(valid_words(raw(spark, []))).count() == 0


def test_misra_gries_bound(spark):
    r = random.Random(2)
    items = [r.choice("abc") if r.random() < 0.6 else f"t{r.randint(0, 3000)}" for _ in range(5000)] + [None] * 50
    df = spark.createDataFrame([(x, 1) for x in items], "element string, est long").repartition(7)
    true, k = Counter(x for x in items if x), 20
    for row in heavy_hitters(df, "element", k).collect():
        assert row["est"] <= true[row["item"]] <= row["est"] + row["low_by_at_most"] and row["n"] == 5000
    found = {r["item"]: r["cnt"] for r in frequent_items(df, "element", 0.1, k).collect()}
    assert found == {x: c for x, c in true.items() if c >= 500}
    assert frequent_items(df.where("false"), "element", 0.1, k).count() == 0
    with pytest.raises(ValueError):
        frequent_items(df, "element", 0.001, k)


def test_shrink_keeps_at_most_k():
    import pandas as pd

    assert shrink(pd.Series({"a": 5, "b": 3, "c": 1}), 2).to_dict() == {"a": 4, "b": 2}
    assert shrink(pd.Series({"a": 2, "b": 2, "c": 2}), 2).empty


def test_scores_equal_brute_force(spark):
    import math

    rows = sample(400, 7)
    df = raw(spark, rows)
    names, seed = record_names(df)
    scores = term_scores(valid_words(df, keep=("record",), seed=seed), names)
    held = [(e, c) for e, c, *_ in clean(rows) if c]
    tf, rec, term = Counter(held), Counter(c for _, c in held), Counter(e for e, _ in held)
    n = len(held)
    got = {(r["term"], r["name"]): r for r in scores.collect()}
    assert set(got) == set(tf)
    for (e, c), k in tf.items():
        x = rec[c] * term[e] / n
        df_ = len({b for a, b in held if a == e})
        assert got[e, c]["adjusted"] == pytest.approx((k - x) / math.sqrt(x) / math.sqrt((1 - rec[c] / n) * (1 - term[e] / n)))
        assert got[e, c]["tfidf"] == pytest.approx(k * (1 + math.log(len(rec)) - math.log(df_)))
    best = {r["name"]: r["term"] for r in top_terms(scores, "tfidf").collect()}
    assert best == {c: min((-got[e, c]["tfidf"], e) for e in term if (e, c) in got)[1] for c in rec}
    assert term_scores(valid_words(raw(spark, []), keep=("record",)), names).count() == 0
    assert df.select(F.max("position")).first()[0] == "clash"
