"""Patterns look at a title once, however often a step reads what they find."""

from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.operators import listings as ls


def test_each_pattern_stands_once_in_the_plan(spark):
    df = spark.createDataFrame([("Pre Order | Acme Surfboards - Ray - 5'1", "Acme"), ("Acme 5'1 Ray PU", "Acme"), ("Acme Two Surfboard | Acme Ray By Me", None)], "title string, brand string")
    out = df.select(T.model_hint("title", "brand", ["Acme Two"]).alias("hint"))
    plan = out._jdf.queryExecution().analyzed().expressions().toString()
    assert plan.count("ORDER") == 1
    assert [r.hint for r in out.collect()] == ["Ray", "Ray", "Acme Ray"]


def test_regional_patterns_stand_once_in_the_plan(spark):
    df = spark.createDataFrame([("Acme  Ray 6'2 white FCS II", "Acme"), ("5'10 Two   fin", None), (" ", "Acme")], "title string, brand string")
    out = df.select(ls.regional_model(F.col("title"), F.col("brand")).alias("model"), ls._first_length(F.col("title")).alias("length"))
    plan = out._jdf.queryExecution().analyzed().expressions().toString()
    assert plan.count("thruster") == 1 and plan.count("regexp_extract") == 6
    assert [(r.model, r.length) for r in out.collect()] == [("Ray", "6'2"), ("Two fin", "5'10"), (None, None)]


def test_a_looked_up_key_and_the_words_of_a_run_stand_once(spark):
    out = spark.createDataFrame([("the big ray",), ("",)], "title string").select(T.tolerant_model_key("title").alias("k"), T.word_ngrams(T.search_text("title"), 2).alias("w"))
    plan = out._jdf.queryExecution().analyzed().expressions().toString()
    assert plan.count("\\s+by") == 1 and plan.count("split(") == 1
    assert [sorted(r.w) for r in out.collect()] == [["big", "big ray", "ray", "the", "the big"], [""]]
