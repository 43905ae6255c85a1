"""Column functions against hand-checked rows."""
from pyspark.sql import functions as F

from postlytics.functions import text as tx


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, tx.clean_text("x"), "I can't! #Go https://t.co/a1") == "i can t   go https   t co a "
    out = one(spark, tx.clean_text("x"), "Café 😀 4U")
    assert out == "caf     u" and len(out) == 9


def test_hashtags_mentions_urls(spark):
    assert one(spark, tx.hashtags("x"), "#a #B_1 #café c#d ##e #") == ["#a", "#B_1", "#café", "#d", "#e"]
    assert one(spark, tx.mentions("x"), "@Jo hi x@y.org @") == ["@Jo", "@y"]
    assert one(spark, tx.urls("x"), "see https://t.co/a, www.b.c http:/x") == ["https://t.co/a,", "www.b.c"]
    assert one(spark, tx.remove_urls("x"), "a https://t.co/x b") == "a  b"


def test_tokenize_contractions(spark):
    assert one(spark, tx.tokenize("x"), "i cannot wanna go") == ["i", "can", "not", "wan", "na", "go"]
    assert one(spark, tx.tokenize("x"), "  gimme  lemme gotta gonna ") == [
        "gim", "me", "lem", "me", "got", "ta", "gon", "na"]
    assert one(spark, tx.tokenize("x"), "") == []


def test_stopwords_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["the", "cat", "the", "dog", "The"],)], "t array<string>")
    assert df.select(tx.remove_stopwords("t")).first()[0] == ["cat", "dog", "The"]


def test_output_to_label_priority(spark):
    rows = ["Not positive, negative", "NEGATIVE", "neutral.", "maybe"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert [r[0] for r in df.select(tx.output_to_label("x")).collect()] == [2, 0, 1, 3]


def test_label_to_output(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "x int")
    assert [r[0] for r in df.select(tx.label_to_output("x")).collect()] == [
        "Negative", "Neutral", "Positive", None]


def test_compound_to_label_boundaries(spark):
    vals = [(0.05,), (0.0499,), (-0.0499,), (-0.05,), (None,), (float("nan"),)]
    df = spark.createDataFrame(vals, "x double")
    assert [r[0] for r in df.select(tx.compound_to_label("x")).collect()] == [2, 1, 1, 0, None, 1]


def test_parse_generation(spark):
    df = spark.createDataFrame([("  Text: a\nSentiment: x\nSentiment: Positive \n",), ("neutral",)],
                               "x string")
    assert [r[0] for r in df.select(tx.parse_generation("x")).collect()] == [2, 1]


def test_model_family(spark):
    df = spark.createDataFrame([("models/mistralai/Mistral-7B_x_y",), ("a",)], "x string")
    got = df.select(tx.model_family("x"), tx.model_family("x", completion=True)).collect()
    # "".join("models/mistralai/Mistral-7B_x_y".split("_")[:2]) -> ".../Mistral-7Bx"
    assert got[0][0] == "mistralai/Mistral-7Bx"
    assert got[0][1] == "models/mistralai"
    assert got[1][0] == "a" and got[1][1] == ""
