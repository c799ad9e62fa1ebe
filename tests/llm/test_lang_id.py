import numpy as np
from pyspark.sql import functions as F

from holloway.llm.lang_id import ByteCNN, identify, op7_lang_id, predict_texts, train, windows

from .cases import TEXTS, documents, empty


def test_tables_give_the_filters_responses():
    model = ByteCNN.new(["a", "b", "c"])
    x = windows("Some text, é with üñ bytes. " * 30)
    raw, _ = model._pooled(x)
    z = np.maximum(raw, 0) @ model.out + model.out_bias
    want = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(model.probabilities(x, model.tables()), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_whole_texts_count():
    model = ByteCNN.new(["a", "b"])
    short, long = "abc def " * 32, "abc def " * 32 + "xyz uvw " * 3200
    assert predict_texts(model, [short])[0][1] != predict_texts(model, [long])[0][1]
    assert predict_texts(model, [None, "", "123 !?", "² ½ ① Ⅷ", "é"])[:4] == [("und", 0.0)] * 4
    assert all(x[0] != "und" for x in predict_texts(model, ["é", "ª", "日", "x²"]))


def test_cases(spark):
    rows = identify(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sample_is_fixed_and_keeps_rare_labels(spark):
    texts = {"aa": "zo zi zu za ", "bb": "pek pok pak ", "cc": "lirum larum "}
    rows = [(k, texts[v] * 30, v) for k, v in enumerate(["aa"] * 300 + ["bb"] * 40 + ["cc"] * 3)] + [(5, "other text for id five", "aa")] * 2
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [train(x) for x in (t, t.orderBy(F.desc("doc_id")).repartition(7))]
    assert models[0].languages == ["aa", "bb", "cc"] and (models[0].out == models[1].out).all()
    out = identify(spark.createDataFrame([(1, texts["bb"] * 9, "x", "y")], "doc_id long, text string, score string, __own string").withColumn("lang", F.lit("bb")))
    assert sorted(out.columns) == sorted(["doc_id", "text", "__own", "lang", "held_out", "lang_pred", "score"]) and out.first()["__own"] == "y"


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    out = op7_lang_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_held_out_rows_are_never_learned_from(spark, sf):
    """Wrong labels of held-out rows change nothing; wrong labels of the others do."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = lambda t: {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in identify(t).collect()}
    plain = rows(docs)
    assert {k for k, r in plain.items() if r[0]} == {r.doc_id for r in docs.where(held).collect()}
    wrong = F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")
    assert rows(docs.withColumn("lang", F.when(held, wrong).otherwise(F.col("lang")))) == plain
    assert {r[1] for r in rows(docs.withColumn("lang", F.when(held, F.col("lang")).otherwise(wrong))).values()} <= {"xx", "yy", "und"}
