"""The toxicity classifier learns from all labelled rows: long texts, and rows beyond the starting fit."""

from gustframe.llm import toxicity


def _predicted(spark, model, texts):
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return [r.predicted for r in toxicity.score(rows, model).orderBy("doc_id").collect()]


def test_long_labelled_texts_are_learnt(spark):
    """One bad word stands in long texts only."""
    filler = "some plain words on this and that "
    rows = [(i, filler * (700 if i % 4 < 2 else 2) + ("vilest" if i % 4 == 0 else "stupid" if i % 4 == 2 else "")) for i in range(160)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert _predicted(spark, model, [filler * 3 + "vilest", filler + "stupid", filler * 3, filler * 900]) == [1, 1, 0, 0]


def test_rows_beyond_the_starting_fit_are_learnt(spark):
    """More rows than the starting fit holds, repeated ids, null texts and null ids among them."""
    bad = [f"{c}ad{c}" for c in "bcdfghklmnprstvw"]
    rows = [(i, f"words of page {i % 37} and " + (bad[i // 2 % 16] if i % 2 else "nothing"), ("en", "fr", None)[i % 3])
            for i in range(1600)]
    odd = [(0, "words of page 0 again", "en"), (1, None, "en"), (None, "words without an id", "fr"), (2, "", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, held_rows=400)
    got = _predicted(spark, model, [f"words of page 5 and {w}" for w in bad + ["nothing"] * 4])
    assert sum(got[:16]) >= 15 and got[16:] == [0] * 4
    assert set(model.thresholds) == {"en", "fr"}
