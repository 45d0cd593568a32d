"""Snapshots of available stock and the events between two snapshot dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions.fixed_values import SNAPSHOT_STATUSES
from stockloom.functions.status import is_available_status

KEYS = ("retailer_name", "product_url", "length")
#: Parts into which the rows of one key are split.
SALTS = 4


def _key(name: str) -> Column:
    """NULL and the empty string are the same key value."""
    return F.coalesce(F.col(name), F.lit("")).alias(f"_k_{name}")


def denormalise(inventory: DataFrame, retailers: DataFrame, brands: DataFrame, models: DataFrame) -> DataFrame:
    """Listing with retailer (required), brand and model (optional) names."""
    return (
        inventory.join(retailers.select("retailer_id", "retailer_name"), "retailer_id")
        .join(brands.select("brand_id", "brand_name"), "brand_id", "left")
        .join(models.select("model_id", "model_name"), "model_id", "left")
    )


def snapshot(inventory: DataFrame, snapshot_date: Column, statuses: Sequence[str] = SNAPSHOT_STATUSES) -> DataFrame:
    """Active, linked-to-a-page, available listings stamped with the snapshot date."""
    return inventory.filter(
        F.col("is_active") & F.col("product_url").isNotNull() & is_available_status("stock_status", statuses)
    ).withColumn("snapshot_date", snapshot_date)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Idempotent by date: only the dates present in ``df`` are replaced."""
    (
        df.repartition("snapshot_date", F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in KEYS]), F.lit(64)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
    )


def _bucket_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_k_{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in KEYS})


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Store snapshots so that comparing two dates needs no shuffle.

    ``table`` holds the rows, dealt into buckets by movement key and salt; ``table``_keys the
    distinct keys of every date, given to all salts, in the same buckets.  Both are partitioned
    by date, and only the dates present in ``df`` are replaced.
    """
    names = [f"_k_{k}" for k in KEYS] + ["_salt"]
    salted = _bucket_columns(df).withColumn("_salt", F.pmod(F.xxhash64("inventory_id", "price"), F.lit(SALTS)).cast("int"))
    keys = _bucket_columns(df).select("snapshot_date", *names[:-1]).distinct().withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    spark = df.sparkSession
    for rows, name in ((salted, table), (keys, f"{table}_keys")):
        out = rows.repartition(buckets, *names).write.option("partitionOverwriteMode", "dynamic")
        if spark.catalog.tableExists(name):
            rows.select(*spark.table(name).columns).repartition(buckets, *names).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").insertInto(name)
        else:
            out.mode("overwrite").partitionBy("snapshot_date").bucketBy(buckets, *names).sortBy(*names).option("path", f"{path}/{name}").saveAsTable(name)


def bucketed_deltas(spark: SparkSession, table: str, previous: Column, current: Column) -> DataFrame:
    """Events between two stored dates: anti joins of buckets with buckets."""
    names = [f"_k_{k}" for k in KEYS] + ["_salt"]
    at = lambda name, date: spark.table(name).filter(F.col("snapshot_date") == date)

    def against(mine: Column, other: Column) -> DataFrame:
        rows = at(table, mine).join(at(f"{table}_keys", other).select(*names), names, "left_anti")
        return rows.withColumn("previous_date", previous).withColumn("current_date", current).drop(*names, "snapshot_date")

    none = F.lit(None)
    gone = _event(against(previous, current), "SOLD_OUT", F.col("price"), none.cast("double"), F.col("stock_status"), none.cast("string"))
    return gone.unionByName(_event(against(current, previous), "NEW_STOCK", none.cast("double"), F.col("price"), none.cast("string"), F.col("stock_status")))


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    """One row: the latest date and the one before it."""
    two = snapshots.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2)
    return two.agg(
        F.max("snapshot_date").alias("current_date"),
        F.when(F.count("snapshot_date") == 2, F.min("snapshot_date")).alias("previous_date"))


def date_pairs(snapshots: DataFrame) -> DataFrame:
    """(previous_date, current_date) for every consecutive pair of snapshot dates.

    One row per date ever taken: the window runs over the calendar, not over the rows.
    """
    dates = snapshots.select("snapshot_date").distinct()
    return dates.select(
        F.col("snapshot_date").alias("current_date"),
        F.lag("snapshot_date").over(Window.orderBy("snapshot_date")).alias("previous_date"),
    ).filter("previous_date IS NOT NULL")


def _against(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose key is absent from ``other`` in the same pair of dates.

    ``other`` is reduced to its distinct keys before the shuffle, so a key that holds many
    listings costs one row on that side, given to every salt; the rows of a hot key on the left
    are spread over the salts.
    """
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    present = other.select("current_date", *[_key(k) for k in KEYS]).distinct().select("*", salts)
    salt = F.pmod(F.xxhash64("inventory_id", "price"), F.lit(SALTS)).cast("int").alias("_salt")
    keyed = rows.select("*", *[_key(k) for k in KEYS], salt)
    names = [f"_k_{k}" for k in KEYS]
    return keyed.join(present, ["current_date", *names, "_salt"], "left_anti").drop(*names, "_salt")


def _event(df: DataFrame, kind: str, previous_price: Column, current_price: Column, prev_s: Column, cur_s: Column) -> DataFrame:
    return df.select(
        F.col("current_date").alias("event_date"), F.lit(kind).alias("event_type"), "previous_date", "current_date",
        "region_code", "inventory_id", "retailer_name", "brand_name", "model_name", "product_url", "length", "price",
        previous_price.alias("previous_price"), current_price.alias("current_price"),
        prev_s.alias("previous_status"), cur_s.alias("current_status"),
    )


def sold_out(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the previous snapshot gone from the current one; both carry their pair of dates."""
    none = F.lit(None)
    gone = _against(previous, current)
    return _event(gone, "SOLD_OUT", F.col("price"), none.cast("double"), F.col("stock_status"), none.cast("string"))


def new_stock(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the current snapshot not in the previous one; both carry their pair of dates."""
    none = F.lit(None)
    fresh = _against(current, previous)
    return _event(fresh, "NEW_STOCK", none.cast("double"), F.col("price"), none.cast("string"), F.col("stock_status"))


def all_deltas(snapshots: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Events of every consecutive date pair (or of the pairs given) in one plan.

    Both sides of the comparison are cut to the dates of the pairs first.
    """
    pairs = date_pairs(snapshots) if pairs is None else pairs
    as_previous = snapshots.join(pairs, snapshots.snapshot_date == pairs.previous_date).drop("snapshot_date")
    as_current = snapshots.join(pairs, snapshots.snapshot_date == pairs.current_date).drop("snapshot_date")
    return sold_out(as_previous, as_current).unionByName(new_stock(as_previous, as_current))


def latest_deltas(snapshots: DataFrame) -> DataFrame:
    """Events between the latest two snapshot dates only."""
    pair = snapshot_dates(snapshots).filter("previous_date IS NOT NULL")
    return all_deltas(snapshots, pair)


def write_deltas(deltas: DataFrame, path: str) -> None:
    """Replaces the event dates present in ``deltas``."""
    deltas.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def count_of(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)), F.lit(0)).cast("long")


def delta_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("event_date").agg(
        count_of("SOLD_OUT").alias("sold_out"), count_of("NEW_STOCK").alias("new_stock")
    )


def delta_summary(snapshots: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row: latest and previous date, rows of the latest date, its event counts."""
    two = snapshots.groupBy("snapshot_date").agg(F.count("*").alias("n")).orderBy(F.desc("snapshot_date")).limit(2)
    row = F.struct("snapshot_date", "n")
    top = two.groupBy().agg(F.max(row).alias("cur"), F.min(row).alias("low"), F.count("*").alias("k")).filter("k > 0").select(
        "cur", F.when(F.col("k") == 2, F.col("low")).alias("prev"))
    counts = delta_counts(deltas)
    return top.join(counts, F.col("cur.snapshot_date") == F.col("event_date"), "left").select(
        F.col("cur.snapshot_date").alias("current_date"), F.col("prev.snapshot_date").alias("previous_date"),
        F.col("cur.n").alias("current_rows"), F.coalesce("sold_out", F.lit(0)).cast("long").alias("sold_out"),
        F.coalesce("new_stock", F.lit(0)).cast("long").alias("new_stock"),
    )


def movement_by(deltas: DataFrame, dim: str, n: int = 12) -> DataFrame:
    """The ``n`` values of ``dim`` with most sold-out, then most new events."""
    return (
        deltas.groupBy(dim)
        .agg(count_of("SOLD_OUT").alias("sold_out"), count_of("NEW_STOCK").alias("new_stock"))
        .orderBy(F.desc("sold_out"), F.desc("new_stock"), F.asc(dim)).limit(n)
    )


def latest_events(deltas: DataFrame, order: Sequence[Column], n: int = 25) -> DataFrame:
    return deltas.orderBy(*order).limit(n)


def latest_vs_previous(snapshots: DataFrame, by: str = "region_code") -> DataFrame:
    """Row counts of each region's latest and previous snapshot and the drop in percent.

    Counting comes first, so the window sees one row per (region, date).
    """
    counts = snapshots.groupBy(by, "snapshot_date").agg(F.count("*").alias("rows"))
    w = Window.partitionBy(by).orderBy("snapshot_date")
    last = Window.partitionBy(by).orderBy(F.desc("snapshot_date"))
    return (
        counts.select(
            by, "snapshot_date", "rows", F.lag("snapshot_date").over(w).alias("previous_date"),
            F.lag("rows").over(w).alias("previous_rows"), F.row_number().over(last).alias("rn"))
        .filter("rn = 1")
        .select(
            by, F.col("snapshot_date").alias("latest_date"), F.col("rows").alias("latest_rows"), "previous_date", "previous_rows",
            F.when(F.col("previous_rows") > 0, F.round((F.col("previous_rows") - F.col("rows")) * 100.0 / F.col("previous_rows"), 2))
            .otherwise(F.lit(0.0)).alias("drop_pct"))
    )


def inventory_drop(snapshots: DataFrame, by: str = "region_code", threshold: float = 0.0) -> DataFrame:
    """Marks regions whose latest snapshot lost more than ``threshold`` percent of its rows: by default any drop."""
    return latest_vs_previous(snapshots, by).withColumn("is_drop", F.col("drop_pct") > threshold)
