"""Expressions on literal cases."""

import pytest
from pyspark.sql import functions as F

from stockloom.functions import dims as D
from stockloom.functions import text as T
from stockloom.operators import linkage as L


def value(spark, build, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(build(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [("18 3/4", 18.75), ("2 7/16", 2.4375), ("77,60L", 77.6), ('19"', 19.0), ("31.5 litres", 31.5), ("2/4", None), ("abc", None), ("", None), (None, None)])
def test_measurement(spark, text, expected):
    got = value(spark, D.parse_measurement, text)
    assert (None if got is None else float(got)) == expected


@pytest.mark.parametrize("text,expected", [("5'11", 71), ("5ft11", 71), ("5’11", 71), ('5"11', 71), ("6'0", 72), ("5'12", None), ("six", None)])
def test_length(spark, text, expected):
    assert value(spark, D.length_inches, text) == expected


def test_title_dimensions(spark):
    got = value(spark, D.title_dimensions, "UTOPIA - 5'11\" x 19\" x 2 7/16\" - 28.5L")
    assert (got["length"], got["width"], got["thickness"], got["volume"]) == ("5'11\"", "19", "2 7/16", "28.5")


def test_slug_dimensions(spark):
    read = lambda text: tuple(value(spark, D.slug_dimensions, text)[c] for c in ("length", "width", "thickness", "volume"))
    assert read("510-19-2-5-28-5l") == ("5'10", "19", "2.5", "28.5")
    assert read("510-19-1-4-2-3-8-28-5l") == ("5'10", "19 1/4", "2 3/8", "28.5")
    assert read("5'10 | 19 1/2 | 2 1/2 | 30L") == ("5'10", "19 1/2", "2 1/2", "30")
    assert read("nothing here") == (None, None, None, None)


@pytest.mark.parametrize("text,expected", [("€ 1.234,50", 1234.5), ("1,234.50", 1234.5), ("749,00 EUR", 749.0), ("$899", 899.0), ("POA", None)])
def test_price(spark, text, expected):
    got = value(spark, D.parse_price, text)
    assert (None if got is None else float(got)) == expected


@pytest.mark.parametrize("text,expected", [("The Puddle Jumper Round", "puddle jumper"), ("Fish", "fish"), ("Twin Fish Squash Tail", "twin")])
def test_family(spark, text, expected):
    assert value(spark, T.model_family, text) == expected


@pytest.mark.parametrize("title,brand,expected", [
    ("Pyzel Surfboards - Ghost - 6'0\" x 19\"", "Pyzel", "Ghost"), ("Lost Puddle Jumper 5'7 PU", "Lost", "Puddle Jumper 5'7"),
    ("PRE ORDER | Firewire Seaside", "Firewire", "Seaside"), ("Chilli Rarest Bird white", "Chilli", "Rarest Bird"), ("", "Chilli", ""),
])
def test_model_hint(spark, title, brand, expected):
    assert value(spark, lambda t, b: T.model_hint(t, b, ["pyzel", "lost", "firewire"]), title, brand) == expected


def test_tolerant_key(spark):
    assert value(spark, T.tolerant_model_key, "Mini Driver") == "mini driver re issue"
    assert value(spark, T.tolerant_model_key, "Highline II black") == "highline 2"


def test_word_runs(spark):
    assert sorted(value(spark, lambda c: T.word_ngrams(c, 2), "a b c")) == ["a", "a b", "b", "b c", "c"]


def test_neighbours(spark):
    got = spark.range(1).select(D.neighbour_lengths(F.lit(72)).alias("v")).first()["v"]
    assert (got["one_down"], got["one_up"], got["two_down"], got["two_up"]) == ("5'11", "6'1", "5'10", "6'2")


def test_percentages(spark):
    got = spark.range(1).select(D.pct(F.lit(1), F.lit(0)).alias("a"), D.clamp_pct(F.lit(130.0)).alias("b"), D.avg_pct(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)).alias("c")).first()
    assert tuple(got) == (0.0, 100.0, 1.5)


def test_generic_model_scores_less(spark):
    models = spark.createDataFrame([(1, "B", 1, "Fish"), (1, "B", 2, "Seaside")], "brand_id int, brand_name string, model_id long, model_name string")
    rows = spark.createDataFrame([("a", 1, "B", "B Fish 5'6", None, "Fish"), ("b", 1, "B", "B Seaside", None, "Seaside")],
                                 "inventory_id string, brand_id int, brand_name string, title string, normalised_title string, hint string")
    got = {r["inventory_id"]: r["score"] for r in L.model_candidates(rows, models).collect()}
    assert got == {"a": 14000 + 40 - 1500, "b": 14000 + 70}
