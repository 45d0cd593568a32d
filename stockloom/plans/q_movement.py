"""Snapshot and movement queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.operators import movement as mv
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.session import shared_folder
from stockloom.streaming.movement import read_movement, stream_movement

_DELTA_COLS = ["event_type", "region_code", "inventory_id", "retailer_name", "brand_name", "model_name", "product_url",
               "length", "price", "previous_price", "current_price", "previous_status", "current_status"]


def _shape(df):
    return df.select(F.col("event_date").cast("string").alias("event_date"), *_DELTA_COLS)


def jn2(spark, sf):
    inv = fx.inventory(spark, sf).drop("retailer_name", "brand_name", "country")
    d = mv.denormalise(inv, fx.retailers(spark, sf), fx.brands(spark, sf), fx.models(spark, sf))
    return d.groupBy("retailer_name", "brand_name", "model_name").agg(
        F.count("*").alias("n"), F.round(F.max("price"), 2).alias("max_price"))


def ev1(spark, sf):
    s = mv.snapshot(fx.inventory(spark, sf), F.lit("2024-01-31").cast("date"))
    return s.groupBy("snapshot_date", "region_code", "stock_status").agg(F.count("*").alias("n")).select(
        F.col("snapshot_date").cast("string").alias("snapshot_date"), "region_code", "stock_status", "n")


def ev2(spark, sf):
    return mv.snapshot_dates(fx.snapshots(spark, sf)).select(
        F.col("current_date").cast("string").alias("current_date"), F.col("previous_date").cast("string").alias("previous_date"))


def ev3(spark, sf):
    return _shape(mv.all_deltas(fx.snapshots(spark, sf)))


def ev3b(spark, sf):
    """The events of the latest two dates, from tables that are bucketed by movement key."""
    s = fx.snapshots(spark, sf)
    dates = mv.snapshot_dates(s).first()
    table, both = f"movement_{uuid.uuid4().hex}", (dates["previous_date"], dates["current_date"])
    mv.write_bucketed(s.filter(F.col("snapshot_date").isin(*both)), table, f"{shared_folder(spark)}/{table}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _shape(mv.bucketed_deltas(spark, table, *[F.lit(d).cast("date") for d in both]))


def _one_side(kind):
    def run(spark, sf):
        return _shape(mv.latest_deltas(fx.snapshots(spark, sf)).filter(F.col("event_type") == kind))
    return run


def ev10(spark, sf):
    """The stream over the snapshots, which arrive in several files with rows of every date."""
    path = f"{shared_folder(spark)}/movement-{uuid.uuid4().hex}"
    s = fx.snapshots(spark, sf)
    s.repartition(3, "inventory_id").write.parquet(f"{path}/feed")
    arriving = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/feed")
    stream_movement(arriving, f"{path}/store", f"{path}/progress").awaitTermination()
    return _shape(read_movement(spark, f"{path}/store"))


def ag9(spark, sf):
    return mv.delta_counts(mv.all_deltas(fx.snapshots(spark, sf))).select(
        F.col("event_date").cast("string").alias("event_date"), "sold_out", "new_stock")


def ag10(spark, sf):
    s = fx.snapshots(spark, sf)
    return mv.delta_summary(s, mv.latest_deltas(s)).select(
        F.col("current_date").cast("string").alias("current_date"), F.col("previous_date").cast("string").alias("previous_date"),
        "current_rows", "sold_out", "new_stock")


def _by(dim):
    return lambda spark, sf: mv.movement_by(mv.latest_deltas(fx.snapshots(spark, sf)), dim)


def tk3(spark, sf):
    d = _shape(mv.latest_deltas(fx.snapshots(spark, sf)))
    order = [F.desc("inventory_id"), *[F.asc_nulls_first(c) for c in ("event_type", "retailer_name", "product_url", "length", "price", "current_status", "previous_status")]]
    return mv.latest_events(d, order)


def jn6(spark, sf):
    return mv.latest_vs_previous(fx.snapshots(spark, sf)).select(
        "region_code", F.col("latest_date").cast("string").alias("latest_date"), "latest_rows",
        F.col("previous_date").cast("string").alias("previous_date"), "previous_rows", "drop_pct")


def wn1(spark, sf):
    return mv.inventory_drop(fx.snapshots(spark, sf)).select(
        "region_code", "latest_rows", "previous_rows", "drop_pct", F.col("is_drop").cast("int").alias("is_drop"))


QUERIES = {
    "jn2_denormalise": jn2, "ev1_snapshot": ev1, "ev2_snapshot_dates": ev2, "ev3_all_deltas": ev3, "ev3_bucketed_deltas": ev3b,
    "ev10_stream_movement": ev10, "jn4_sold_out": _one_side("SOLD_OUT"), "jn5_new_stock": _one_side("NEW_STOCK"), "ag9_delta_counts": ag9,
    "ag10_delta_summary": ag10, "tk2_movement_by_retailer": _by("retailer_name"), "tk2_movement_by_brand": _by("brand_name"),
    "tk3_latest_events": tk3, "jn6_latest_vs_previous": jn6, "wn1_inventory_drop": wn1,
}

_PAIRS = "SELECT DISTINCT a.snapshot_date AS cur, (SELECT max(b.snapshot_date) FROM snapshots b WHERE b.snapshot_date < a.snapshot_date) AS prev FROM snapshots a"
_SAME = "coalesce(x.retailer_name,'') = coalesce(y.retailer_name,'') AND coalesce(x.product_url,'') = coalesce(y.product_url,'') AND coalesce(x.length,'') = coalesce(y.length,'')"
_DELTAS = f"""
SELECT p.cur AS event_date, 'SOLD_OUT' AS event_type, region_code, inventory_id, retailer_name, brand_name, model_name, product_url, length, price,
  price AS previous_price, CAST(NULL AS DOUBLE) AS current_price, stock_status AS previous_status, CAST(NULL AS VARCHAR) AS current_status
FROM snapshots x JOIN pairs p ON x.snapshot_date = p.prev
WHERE NOT EXISTS (SELECT 1 FROM snapshots y WHERE y.snapshot_date = p.cur AND {_SAME})
UNION ALL
SELECT p.cur, 'NEW_STOCK', region_code, inventory_id, retailer_name, brand_name, model_name, product_url, length, price,
  NULL, price, NULL, stock_status
FROM snapshots x JOIN pairs p ON x.snapshot_date = p.cur
WHERE p.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshots y WHERE y.snapshot_date = p.prev AND {_SAME})"""
_EV = "CAST(event_date AS VARCHAR) AS event_date, " + ", ".join(_DELTA_COLS)
_LATEST = "event_date = (SELECT max(snapshot_date) FROM snapshots)"


def _d(body: str) -> str:
    return sql("snapshots", body, pairs=_PAIRS, deltas=_DELTAS)


def _move(dim: str) -> str:
    return _d(f"""SELECT {dim}, count(*) FILTER (event_type='SOLD_OUT') AS sold_out, count(*) FILTER (event_type='NEW_STOCK') AS new_stock
FROM deltas WHERE {_LATEST} GROUP BY {dim} ORDER BY sold_out DESC, new_stock DESC, {dim} LIMIT 12""")


_DROP = """SELECT region_code, snapshot_date, count(*) AS n,
row_number() OVER (PARTITION BY region_code ORDER BY snapshot_date DESC) AS rn FROM snapshots GROUP BY region_code, snapshot_date"""

ORACLE = {
    "jn2_denormalise": sql("inventory brands models retailers", """SELECT r.retailer_name, b.brand_name, m.model_name, count(*) AS n, round(max(i.price),2) AS max_price
FROM inventory i JOIN retailers r ON i.retailer_id = r.retailer_id LEFT JOIN brands b ON i.brand_id = b.brand_id LEFT JOIN models m ON i.model_id = m.model_id GROUP BY ALL"""),
    "ev1_snapshot": sql("inventory", """SELECT '2024-01-31' AS snapshot_date, region_code, stock_status, count(*) AS n FROM inventory
WHERE is_active AND product_url IS NOT NULL AND (stock_status IS NULL OR lower(trim(stock_status)) IN ('in stock','instock','available','true')) GROUP BY ALL"""),
    "ev2_snapshot_dates": sql("snapshots", """SELECT CAST(max(snapshot_date) AS VARCHAR) AS "current_date",
CAST((SELECT max(snapshot_date) FROM snapshots WHERE snapshot_date < (SELECT max(snapshot_date) FROM snapshots)) AS VARCHAR) AS previous_date FROM snapshots"""),
    "ev3_all_deltas": _d(f"SELECT {_EV} FROM deltas"), "ev10_stream_movement": _d(f"SELECT {_EV} FROM deltas"),
    "ev3_bucketed_deltas": _d(f"SELECT {_EV} FROM deltas WHERE {_LATEST}"),
    "jn4_sold_out": _d(f"SELECT {_EV} FROM deltas WHERE event_type = 'SOLD_OUT' AND {_LATEST}"),
    "jn5_new_stock": _d(f"SELECT {_EV} FROM deltas WHERE event_type = 'NEW_STOCK' AND {_LATEST}"),
    "ag9_delta_counts": _d("""SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) FILTER (event_type='SOLD_OUT') AS sold_out,
count(*) FILTER (event_type='NEW_STOCK') AS new_stock FROM deltas GROUP BY 1"""),
    "ag10_delta_summary": _d(f"""SELECT CAST((SELECT max(cur) FROM pairs) AS VARCHAR) AS "current_date", CAST((SELECT max(prev) FROM pairs) AS VARCHAR) AS previous_date,
(SELECT count(*) FROM snapshots WHERE snapshot_date = (SELECT max(cur) FROM pairs)) AS current_rows,
(SELECT count(*) FROM deltas WHERE {_LATEST} AND event_type='SOLD_OUT') AS sold_out,
(SELECT count(*) FROM deltas WHERE {_LATEST} AND event_type='NEW_STOCK') AS new_stock"""),
    "tk2_movement_by_retailer": _move("retailer_name"), "tk2_movement_by_brand": _move("brand_name"),
    "tk3_latest_events": _d(f"""SELECT {_EV} FROM deltas WHERE {_LATEST} ORDER BY inventory_id DESC, event_type, retailer_name, product_url,
length NULLS FIRST, price, current_status NULLS FIRST, previous_status NULLS FIRST LIMIT 25"""),
    "jn6_latest_vs_previous": sql("snapshots", """SELECT a.region_code, CAST(a.snapshot_date AS VARCHAR) AS latest_date, a.n AS latest_rows,
CAST(b.snapshot_date AS VARCHAR) AS previous_date, b.n AS previous_rows,
CASE WHEN b.n > 0 THEN round((b.n - a.n) * 100.0 / b.n, 2) ELSE 0.0 END AS drop_pct FROM c a LEFT JOIN c b ON a.region_code = b.region_code AND b.rn = 2 WHERE a.rn = 1""", c=_DROP),
    "wn1_inventory_drop": sql("snapshots", """SELECT a.region_code, a.n AS latest_rows, b.n AS previous_rows,
CASE WHEN b.n > 0 THEN round((b.n - a.n) * 100.0 / b.n, 2) ELSE 0.0 END AS drop_pct,
CASE WHEN b.n > 0 AND a.n < b.n THEN 1 ELSE 0 END AS is_drop FROM c a LEFT JOIN c b ON a.region_code = b.region_code AND b.rn = 2 WHERE a.rn = 1""", c=_DROP),
}
