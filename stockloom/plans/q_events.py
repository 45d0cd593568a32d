"""Event and user-activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import events as ev
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql


def _now():
    return F.lit(fx.NOW).cast("timestamp")


def _s(df, *cols):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in ("ts", "last_seen", "latest_success") else F.col(c) for c in cols])


def ev4(spark, sf):
    return _s(ev.freshness_issues(fx.job_events(spark, sf), _now()), "event", "region", "last_seen", "age_hours")


def ev5(spark, sf):
    d = ev.daily_counts(fx.job_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), F.coalesce("rows", F.lit(0.0)), ("service", "region"))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "service", "region", "rows")


def ev6(spark, sf):
    return _s(ev.latest_execution(fx.job_events(spark, sf)), "service", "region", "ts", "event_id", "event", "status", "payload")


def ev7(spark, sf):
    return ev.failures(fx.job_events(spark, sf))


def ev8(spark, sf):
    e = ev.event_fields(ev.service_events(fx.job_events(spark, sf), "svc1"), "k INT")
    return e.select("event_id", "event", "region", "status", "k")


def tx17(spark, sf):
    e = ev.event_fields(fx.job_events(spark, sf), "k INT")
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit('["a'), F.col("k"), F.lit('", "b"]'))).otherwise(F.concat(F.lit(" x, y"), F.col("k"), F.lit(", ")))
    return e.select("event_id", F.array_join(ev.parse_list(text), "|").alias("items"))


def pf21(spark, sf):
    e = fx.job_events(spark, sf).withColumn("payload", F.concat(F.lit('{"api_key": "z", "message": "hi", "user_id": "'), F.col("user_id"), F.lit('"}')))
    return ev.redact(e).select("event_id", *[F.element_at("payload", k).alias(k) for k in ("api_key", "message", "user_id")])


def _raw(spark, sf):
    e = fx.table(spark, sf, "events")
    k = F.col("event_id")
    return e.select("event_id", F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("user_id"), F.when(k % 4 == 0, F.concat(F.lit("anon"), k)).alias("anonymous_id"),
                    F.when(k % 5 != 0, F.col("event_type")).alias("event_type"))


def ev9(spark, sf):
    good, bad = ev.clean_events(_raw(spark, sf))
    return good.withColumn("kept", F.lit(1)).unionByName(bad.withColumn("kept", F.lit(0))).select("event_id", "event_type", "kept")


def wn12(spark, sf):
    return _s(ev.job_state(fx.job_events(spark, sf), ["service", "region"]), "service", "region", "latest_success", "last_status", "runs", "consecutive_failures")


def ag24(spark, sf):
    return ev.user_activity(fx.job_events(spark, sf), 5).select("user_id", "event_id", "event", "rank")


def ag24c(spark, sf):
    return ev.event_counts(fx.job_events(spark, sf), F.lit("2024-01-15").cast("timestamp"))


def ag24l(spark, sf):
    e = fx.job_events(spark, sf).withColumn("value", F.col("status"))
    return ev.latest_consent(e, ["user_id", "event"]).select("user_id", "event", "value")


def jn3(spark, sf):
    k = F.col("l_orderkey")
    items = fx.table(spark, sf, "lineitem").select(
        F.concat_ws("-", k, "l_linenumber").alias("item_id"), F.when(k % 3 != 0, F.col("l_partkey")).alias("size_id"), F.when(k % 2 == 0, F.col("l_partkey")).alias("model_id"))
    return ev.saved_items(items, fx.sizes(spark, sf), fx.models(spark, sf), fx.brands(spark, sf)).select("item_id", "model_name", "brand_name", "length")


def pf22(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    p = c.select(k.alias("user_id"), F.when(k % 2 == 0, "180").alias("height"), F.when(k % 3 == 0, "80").alias("weight"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("ability"),
                 F.when(k % 7 == 0, "30").alias("volume_min"), F.when(k % 4 == 0, "34").alias("volume_max"), F.when(k % 6 != 1, "").alias("region"))
    return ev.profile_strength(p, ["height", "weight", "ability", ["volume_min", "volume_max"], "region"], ["height", "weight", "ability", ["volume_min", "volume_max"]]).select("user_id", "useful_fields", "strength")


QUERIES = {"ev4_freshness_issues": ev4, "ev5_daily_counts": ev5, "ev6_latest_execution": ev6, "ev7_failures": ev7, "ev8_service_events": ev8, "tx17_parse_list": tx17, "pf21_redact": pf21,
           "ev9_clean_events": ev9, "wn12_job_state": wn12, "ag24_user_activity": ag24, "ag24_event_counts": ag24c, "ag24_latest_consent": ag24l, "jn3_saved_items": jn3, "pf22_profile_strength": pf22}

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {1}"
ORACLE = {
    "ev4_freshness_issues": sql("job_events", f"SELECT event, region, {_T.format('max(ts)', 'last_seen')}, round((epoch(TIMESTAMP '{fx.NOW}') - epoch(max(ts)))/3600.0, 2) AS age_hours FROM job_events GROUP BY event, region"),
    "ev5_daily_counts": sql("job_events", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, service, region, max(coalesce(rows, 0)) AS rows FROM job_events GROUP BY ALL"),
    "ev6_latest_execution": sql("job_events", f"SELECT service, region, {_T.format('ts', 'ts')}, event_id, event, status, payload FROM job_events QUALIFY row_number() OVER (PARTITION BY service, region ORDER BY job_events.ts DESC, event_id DESC) = 1"),
    "ev7_failures": sql("job_events", "SELECT service, event, region, count(*) AS failures FROM job_events WHERE status = 'failed' GROUP BY ALL"),
    "ev8_service_events": sql("job_events", "SELECT event_id, event, region, status, CAST(payload->>'k' AS INT) AS k FROM job_events WHERE service = 'svc1'"),
    "tx17_parse_list": "SELECT event_id, CASE WHEN CAST(props->>'k' AS INT) % 2 = 0 THEN 'a' || (props->>'k') || '|b' ELSE 'x|y' || (props->>'k') END AS items FROM events",
    "pf21_redact": "SELECT event_id, '[REDACTED]' AS api_key, '[REDACTED]' AS message, CAST(user_id AS VARCHAR) AS user_id FROM events",
    "ev9_clean_events": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'UnknownEvent' ELSE event_type END AS event_type, CASE WHEN event_id % 3 <> 0 OR event_id % 4 = 0 THEN 1 ELSE 0 END AS kept FROM events",
    "wn12_job_state": sql("job_events", f"""SELECT service, region, {_T.format("max(ts) FILTER (status='success')", 'latest_success')}, arg_max(status, (ts, event_id)) AS last_status, count(*) AS runs,
count(*) FILTER (status='failed' AND g = 0) AS consecutive_failures FROM (SELECT *, count(*) FILTER (status='success') OVER (PARTITION BY service, region ORDER BY ts DESC, event_id DESC) AS g FROM job_events) GROUP BY service, region"""),
    "ag24_user_activity": sql("job_events", "SELECT user_id, event_id, event, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM job_events QUALIFY rank <= 5"),
    "ag24_event_counts": sql("job_events", "SELECT user_id, event, count(*) AS events FROM job_events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL"),
    "ag24_latest_consent": sql("job_events", "SELECT user_id, event, arg_max(status, (ts, event_id)) AS value FROM job_events GROUP BY ALL"),
    "jn3_saved_items": sql("sizes models brands", """SELECT l_orderkey || '-' || l_linenumber AS item_id, m.model_name, b.brand_name, z.length FROM lineitem LEFT JOIN sizes z ON l_orderkey % 3 <> 0 AND z.size_id = l_partkey
LEFT JOIN models m ON m.model_id = coalesce(CASE WHEN l_orderkey % 2 = 0 THEN l_partkey END, z.model_id) LEFT JOIN brands b ON b.brand_id = m.brand_id"""),
    "pf22_profile_strength": """SELECT user_id, h + w + a + v AS useful_fields, CASE WHEN h + w + a + v = 4 THEN 'strong' WHEN h + w + a + v >= 3 THEN 'partial' ELSE 'none' END AS strength FROM (
SELECT c_custkey AS user_id, (c_custkey % 2 = 0)::INT AS h, (c_custkey % 3 = 0)::INT AS w, (c_custkey % 5 <> 0)::INT AS a, (c_custkey % 7 = 0 OR c_custkey % 4 = 0)::INT AS v FROM customer)""",
}
