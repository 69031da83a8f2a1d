from lexforge.plans import registry


def test_every_typed_value_has_a_correction(spark, tmp_path):
    typed = ["Cache", "utf8 ", "thread-pool", "cäche", "two words", " ", None]
    spark.createDataFrame([(w,) for w in typed], "element string").write.parquet(f"{tmp_path}/typed_words.parquet")
    spark.createDataFrame([("cache", 5), ("thread", 3)], "word string, freq long").write.parquet(f"{tmp_path}/dictionary.parquet")
    want = {"cache", "utf8", "thread-pool", "cäche", "two words"}
    for name in ("spell_correct", "spell_gated"):
        got = {r["word"]: r["corrected"] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert set(got) == want and all(got.values())
        assert got["cache"] == "cache" and got["utf8"] == "utf8"
