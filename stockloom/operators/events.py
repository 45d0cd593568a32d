"""Operational and user events: typed views, latest state, counts.

The functions work on batch and streaming DataFrames unless they rank rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.functions.status import age_hours

# fixed values: payload keys whose values are never kept
SENSITIVE_KEY_RX = r"(?i)(password|secret|token|api[_-]?key|connection[_-]?string|authorization)"
PROTECTED_KEYS = ("message", "user_message", "prompt", "page_context", "conversation", "request_body", "content")


def event_fields(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Payload columns by a declared schema; malformed JSON gives NULLs."""
    return df.withColumn("_p", F.from_json(payload, schema)).select(*df.columns, "_p.*")


def parse_list(c: Column | str) -> Column:
    """JSON array or comma-separated text → array of trimmed, non-empty strings."""
    c = T.clean(c)
    raw = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def redact(df: DataFrame, payload: str = "payload", protected: Sequence[str] = ()) -> DataFrame:
    """Payload as map<string,string> with the values of sensitive keys replaced."""
    m = F.from_json(payload, "map<string,string>")
    names = [*PROTECTED_KEYS, *[p.lower() for p in protected]]

    def hide(k: Column, v: Column) -> Column:
        return F.when(F.lower(k).isin(*names) | k.rlike(SENSITIVE_KEY_RX), "[REDACTED]").otherwise(v)

    return df.withColumn(payload, F.transform_values(m, hide))


def service_events(df: DataFrame, service: str) -> DataFrame:
    return df.filter(F.col("service") == service)


def clean_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): an event needs a user or an anonymous id; a blank type gets a default."""
    typed = df.withColumn("event_type", F.when(T.blank("event_type"), "UnknownEvent").otherwise(F.trim("event_type")))
    known = ~T.blank("user_id") | ~T.blank("anonymous_id")
    return typed.filter(known), typed.filter(~known)


def freshness_issues(df: DataFrame, now: Column, keys: Sequence[str] = ("event", "region")) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("ts").alias("last_seen")).withColumn("age_hours", F.round(age_hours("last_seen", now), 2))


def daily_counts(df: DataFrame, value: Column, keys: Sequence[str] = ("region",), watermark: str | None = None) -> DataFrame:
    """Highest row count per day and key; a stream needs the watermark."""
    src = df.withWatermark("ts", watermark) if watermark else df
    g = src.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.max(value).alias("rows"))
    return g.select(F.col("w.start").alias("day"), *keys, "rows")


def latest_execution(df: DataFrame, keys: Sequence[str] = ("service", "region"), order: Column | None = None) -> DataFrame:
    """Latest event per key: one aggregation, combined before the shuffle."""
    o = F.struct("ts", "event_id") if order is None else order
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), o).alias("_l")).select(*keys, "_l.*")


def failures(df: DataFrame, keys: Sequence[str] = ("service", "event", "region")) -> DataFrame:
    return df.filter(F.lower("status").isin("failed", "error", "failure")).groupBy(*keys).agg(F.count("*").alias("failures"))


def job_state(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per job: last status, latest success, and failures after that success.

    Two aggregations instead of an ordered window: the latest success per key is found
    first, then failures after it are counted, so a busy job is never sorted in one task.
    """
    at = F.struct("ts", "event_id")
    ok = F.lower("status") == "success"
    last = df.groupBy(*keys).agg(
        F.max(F.when(ok, at)).alias("_ok"), F.max(F.when(ok, F.col("ts"))).alias("latest_success"),
        F.max_by("status", at).alias("last_status"), F.count("*").alias("runs"))
    after = df.filter(F.lower("status") == "failed").join(last.select(*keys, "_ok"), list(keys)).filter(
        F.col("_ok").isNull() | (F.struct("ts", "event_id") > F.col("_ok")))
    n = after.groupBy(*keys).agg(F.count("*").alias("consecutive_failures"))
    return last.drop("_ok").join(n, list(keys), "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def user_activity(df: DataFrame, n: int = 20, user: str = "user_id") -> DataFrame:
    """Latest ``n`` events per user."""
    w = Window.partitionBy(user).orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def event_counts(df: DataFrame, since: Column, user: str = "user_id") -> DataFrame:
    return df.filter(F.col("ts") >= since).groupBy(user, "event").agg(F.count("*").alias("events"))


def latest_consent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def _left_join_known(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join by ``key``; rows without one get a key each that nothing has, or they would all be dealt to one task."""
    spread = F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    mine = rows.withColumn("_key", F.struct(F.col(key).alias("k"), spread.alias("spread")))
    theirs = other.filter(F.col(key).isNotNull()).withColumn("_key", F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("spread"))).drop(key)
    return mine.join(theirs, "_key", "left").drop("_key")


def saved_items(items: DataFrame, sizes: DataFrame, models: DataFrame, brands: DataFrame) -> DataFrame:
    """Saved items with names: the item's own model, else the model of its size."""
    s = sizes.select("size_id", F.col("model_id").alias("_size_model"), "length")
    j = _left_join_known(items, s, "size_id").withColumn("model_id", F.coalesce("model_id", "_size_model")).drop("_size_model")
    named = models.select("model_id", "brand_id", "model_name").join(brands, "brand_id", "left")
    return _left_join_known(j, named, "model_id")


def profile_strength(df: DataFrame, fields: Sequence[str | Sequence[str]], required: Sequence[str | Sequence[str]], partial: int = 3) -> DataFrame:
    """Number of useful fields and strong / partial / none.

    An entry that is a list counts when any of its columns is filled.  A profile is strong
    when every required entry is filled, partial from ``partial`` useful fields on.
    """
    def filled(entry) -> Column:
        names = [entry] if isinstance(entry, str) else list(entry)
        out = F.lit(False)
        for n in names:
            out = out | ~T.blank(n)
        return out

    n = sum((filled(f).cast("int") for f in fields), F.lit(0))
    strong = F.lit(True)
    for r in required:
        strong = strong & filled(r)
    d = df.withColumn("useful_fields", n)
    return d.withColumn("strength", F.when(strong, "strong").when(F.col("useful_fields") >= partial, "partial").otherwise("none"))
