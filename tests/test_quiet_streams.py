"""A movement stream in which nothing moves."""

from pyspark.sql import functions as F

from stockloom.streaming.movement import process_batch, read_movement

_SCHEMA = ("snapshot_date string, region_code string, retailer_name string, product_url string, length string, brand_name string, "
           "model_name string, inventory_id long, price double, stock_status string")


def _batch(spark, dates):
    rows = [(d, "EU", "shop", "u", "6'0", "maker", "model", 1, 10.0, "In Stock") for d in dates]
    return spark.createDataFrame(rows, _SCHEMA).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


def test_no_events_at_all(spark, tmp_path):
    process_batch(_batch(spark, ["2024-01-01", "2024-04-01"]), 0, str(tmp_path))
    df = read_movement(spark, str(tmp_path))
    assert df.collect() == [] and {"event_date", "event_type", "inventory_id"} <= set(df.columns)


def test_one_date_and_then_a_movement(spark, tmp_path):
    process_batch(_batch(spark, ["2024-01-01"]), 0, str(tmp_path))
    assert read_movement(spark, str(tmp_path)).collect() == []
    other = _batch(spark, ["2024-04-01"]).withColumn("product_url", F.lit("v"))
    process_batch(other, 1, str(tmp_path))
    assert sorted(r.event_type for r in read_movement(spark, str(tmp_path)).collect()) == ["NEW_STOCK", "SOLD_OUT"]
