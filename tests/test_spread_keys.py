"""Rows without a key are not dealt to one task by the joins that look for their key."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockloom.operators import events as ev
from stockloom.operators import linkage as lk


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, as on large tables."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    n = Counter(r["_p"] for r in df.select("*", F.spark_partition_id().alias("_p")).collect())
    return max(n.values()) / sum(n.values())


def _listings(spark, n=800):
    return spark.range(n).repartition(8).selectExpr(
        "string(id) AS inventory_id", "1 AS brand_id", "'Maker' AS brand_name", "5L AS model_id", "NULL AS size_id", "concat('Maker board ', id) AS title", "if(id < 0, 'x', NULL) AS normalised_title",
        "'6\\'0' AS length", "string(NULL) AS width", "string(NULL) AS thickness", "string(NULL) AS volume", "string(NULL) AS construction").withColumn("size_id", F.col("size_id").cast("long"))


def test_listings_without_a_normalised_title(shuffled):
    a = shuffled.createDataFrame([("Maker", 1, 1)], "alias string, brand_id int, position int")
    df = lk.reconcile_brands(_listings(shuffled), a)
    assert largest_share(df) < 0.5
    assert {(r.reconciled_brand_id, r.changed) for r in df.collect()} == {(1, False)}


def test_listings_that_have_a_model(shuffled):
    a = shuffled.createDataFrame([("Maker", 1, "Maker")], "alias string, brand_id int, brand_name string")
    m = shuffled.createDataFrame([(1, "Maker", 5, "board")], "brand_id int, brand_name string, model_id long, model_name string")
    z = shuffled.createDataFrame([(9, 5, "6'0", None, None, None, None)], "size_id long, model_id long, length string, width string, thickness string, volume string, construction string")
    kept = []

    def keep(df):
        kept.append(df.localCheckpoint() if not kept else df)
        return kept[-1]

    # the brand's lookup has one row and deals all listings out by it; here the models' lookup counts
    out = lk.project_links(_listings(shuffled), a, ["Maker"], m, z, keep=lambda df: keep(df.repartition(8)) if not kept else keep(df))
    assert largest_share(kept[1]) < 0.5
    assert {(r.effective_model_id, r.new_model_id, r.new_size_id) for r in out.collect()} == {(5, None, 9)}


def test_saved_items_without_size_or_model(shuffled):
    rows = [(f"i{i}", 1 if i % 40 == 0 else None, 7 if i % 40 == 1 else 8 if i % 40 == 2 else None) for i in range(800)]
    items = shuffled.createDataFrame(rows, "item_id string, size_id long, model_id long").repartition(8)
    z = shuffled.createDataFrame([(1, 7, "6'0"), (2, None, "5'0"), (None, 7, "5'1")], "size_id long, model_id long, length string")
    m = shuffled.createDataFrame([(7, 3, "ray"), (9, 3, "other"), (None, 3, "none")], "model_id long, brand_id int, model_name string")
    df = ev.saved_items(items, z, m, shuffled.createDataFrame([(3, "Maker")], "brand_id int, brand_name string"))
    assert largest_share(df) < 0.5
    got = Counter((r.model_id, r.length, r.brand_id, r.model_name, r.brand_name) for r in df.collect())
    assert got == {(7, "6'0", 3, "ray", "Maker"): 20, (7, None, 3, "ray", "Maker"): 20, (8, None, None, None, None): 20, (None, None, None, None, None): 740}
