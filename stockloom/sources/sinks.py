"""Loads and sinks: scoped replacement, upserts, rollback sets, reports.

``replace_region`` and ``replace_scope`` write; the others return the rows to write, so a
caller chooses the format and path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text as T


def replace_region(df: DataFrame, path: str, region: str) -> None:
    """Replace one region's partition; other partitions are not touched.

    A load without a row of the region is refused: it would leave the old rows in place.
    """
    rows = df.filter(F.col("region_code") == region)
    if rows.isEmpty():
        raise ValueError(f"no rows of {region} to load")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_code").parquet(path)


def replace_scope(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows outside the scopes present in ``incoming``, plus the incoming rows."""
    scopes = incoming.select(*keys).distinct()
    cond = None
    for k in keys:
        c = existing[k].eqNullSafe(scopes[k])
        cond = c if cond is None else cond & c
    return existing.join(scopes, cond, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_inventory(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], volume: str = "volume", ident: str = "inventory_id") -> DataFrame:
    """Incoming rows with the stored id they update, and untouched stored rows; ``action`` tells.

    A row is found by its keys and volume, else by its keys where the stored volume is
    missing.  Incoming rows of equal keys and volume are one row (the first by all columns).  A
    stored row is matched by one incoming row at most: the bare one goes to the smallest
    volume of its keys that has no full match.
    """
    k = [f"_k_{c}" for c in keys]
    keyed = lambda d: d.withColumns({**{f"_k_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys}, "_v": F.coalesce(F.col(volume).cast("string"), F.lit(""))})
    ex = keyed(existing)
    full = ex.filter(F.col(volume).isNotNull()).groupBy(*k, "_v").agg(F.min(ident).alias("_full"))
    bare = ex.filter(F.col(volume).isNull()).groupBy(*k).agg(F.min(ident).alias("_bare"))
    rows = keyed(incoming.drop(ident))
    one = Window.partitionBy(*k, "_v").orderBy(*[F.col(c).cast("string") for c in incoming.columns if c != ident])
    inc = rows.withColumn("_one", F.row_number().over(one)).filter("_one = 1").join(full, [*k, "_v"], "left")
    # the candidates for bare rows are ranked by themselves, by keys that are never null
    open_rows = inc.filter("_full IS NULL").groupBy(*k).agg(F.min(F.struct(F.col(volume).isNotNull().alias("a"), F.col(volume).alias("b"), F.col("_v").alias("v"))).alias("_w"))
    chosen = open_rows.join(bare, k).select(*k, F.col("_w.v").alias("_v"), "_bare")
    inc = inc.join(chosen, [*k, "_v"], "left").withColumn(ident, F.coalesce("_full", "_bare"))
    inc = inc.withColumn("action", F.when(F.col(ident).isNotNull(), "update").otherwise("insert")).drop(*k, "_v", "_full", "_bare", "_one")
    kept = existing.join(inc.filter("action = 'update'").select(ident), ident, "left_anti").withColumn("action", F.lit("keep"))
    return inc.unionByName(kept, allowMissingColumns=True)


def deactivate_then_load(existing: DataFrame, incoming: DataFrame, region: str) -> DataFrame:
    """The region's stored rows become inactive; the incoming rows are added active."""
    off = existing.withColumn("is_active", F.when(F.col("region_code") == region, False).otherwise(F.col("is_active")))
    return off.unionByName(incoming.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def rollback_plan(before: DataFrame, after: DataFrame, key: str, compare: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(before-images of changed rows, ids of inserted rows)."""
    stamp = lambda d, n: d.select(key, F.xxhash64(*[F.col(c) for c in compare]).alias(n))
    changed = stamp(before, "_b").join(stamp(after, "_a"), key).filter("_a <> _b").select(key)
    return before.join(changed, key, "left_semi"), after.join(before.select(key), key, "left_anti").select(key)


def merge_reject_audit(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rejected rows merged on (brand, title, url, reason); the newest wins."""
    keys = [F.lower(T.clean(c)) for c in ("brand", "title", "source_url", "reason")]
    w = Window.partitionBy(*keys).orderBy(F.desc("rejected_at"), F.desc("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def report_rows(df: DataFrame, order: Sequence[Column | str], cap: int = 5000) -> DataFrame:
    """The sample a report shows: the first ``cap`` rows in a total order."""
    return df.orderBy(*order).limit(cap)


def write_report(accepted: DataFrame, rejected: DataFrame, path: str, order: Sequence[str], cap: int = 5000, fmt: str = "json") -> None:
    """Accepted and rejected rows whole, and beside them the capped sample that a report shows."""
    accepted.write.mode("overwrite").format(fmt).save(f"{path}/accepted")
    rejected.write.mode("overwrite").format(fmt).save(f"{path}/rejected")
    report_rows(rejected, order, cap).write.mode("overwrite").format(fmt).save(f"{path}/rejected_sample")
