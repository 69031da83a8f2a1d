from lexforge.plans import registry


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_pairs(spark, tmp_path):
    typed, words = ["Cache", " acche", "cäche", "xhread", "thread ", " ", None, "c"], ["cache", "thread", "zoom"]
    spark.createDataFrame([(w,) for w in typed], "element string").write.parquet(f"{tmp_path}/typed_words.parquet")
    spark.createDataFrame([(w,) for w in words], "word string").write.parquet(f"{tmp_path}/dictionary.parquet")
    want = {(w, s): levenshtein(w, s) for w in {x.strip().lower() for x in typed if x and x.strip()} for s in words}
    made = registry.queries()
    assert {(r["w"], r["s"]): r["dist"] for r in made["edit_distance"](spark, str(tmp_path)).collect()} == want
    near = {k for k, n in want.items() if 1 - n / max(map(len, k)) > 0.3001}
    assert {(r["w"], r["s"]) for r in made["similarity_gate"](spark, str(tmp_path)).collect()} == near
    assert {("acche", "cache"), ("cäche", "cache"), ("xhread", "thread")} <= near
