"""Bucketed snapshots: the same events as the plain comparison, and no exchange in its plan."""

import random
import uuid

from pyspark.sql import functions as F

from stockloom.operators import movement as mv


def test_bucketed_events_equal_the_plain_ones_without_exchange(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for date in ("2024-01-01", "2024-01-02"):
        for i in range(400):
            hot = rng.random() < 0.3
            rows.append((date, "EU", "hot" if hot else rng.choice(["a", "b", None]), "u1" if hot else f"u{rng.randint(0, 30)}", rng.choice([None, "", "5'1"]), "B", "m", i, float(rng.randint(1, 9)), rng.choice([None, "in stock"])))
    schema = "snapshot_date string, region_code string, retailer_name string, product_url string, length string, brand_name string, model_name string, inventory_id long, price double, stock_status string"
    s = spark.createDataFrame(rows, schema).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    name = f"t_{uuid.uuid4().hex}"
    mv.write_bucketed(s, name, str(tmp_path), 8)
    mv.write_bucketed(s.filter("snapshot_date = DATE'2024-01-02'"), name, str(tmp_path), 8)  # a date again: replaced, not doubled
    before, after = (F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-02"))
    df = mv.bucketed_deltas(spark, name, before, after)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # a broadcast of so small a table would hide the buckets
    try:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    want = mv.latest_deltas(s).select(*df.columns)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.count() > 0
