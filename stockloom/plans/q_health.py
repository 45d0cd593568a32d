"""Health, score, alert and guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions.status import in_order, is_available_status
from stockloom.operators import events as ev
from stockloom.operators import health as H
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.session import checkpointed

S = fx.SUPPORTED
NOW = "2001-11-30 00:00:00"
_GRID = ("AFRICA", "ASIA", "EUROPE", "NOWHERE")


def _now():
    return F.lit(NOW).cast("timestamp")


def _retail(spark, sf):
    """Some blank regions, to exercise the <NULL> bucket."""
    i = fx.inventory(spark, sf)
    return i.withColumn("region_code", F.when(F.col("true_size_id") % 17 == 0, " ").otherwise(F.col("region_code")))


def _direct(spark, sf):
    return fx.direct(spark, sf).withColumn("checked_at", F.col("scraped_at"))


def _rm(spark, sf):
    return H.region_metrics(fx.inventory(spark, sf))


def _dm(spark, sf):
    return H.region_metrics(_direct(spark, sf), "brand_id", available=F.col("is_available"))


def _ts(df, c="latest_refresh"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))


def ag3(spark, sf):
    return _ts(H.region_metrics(_retail(spark, sf)))


def ag4(spark, sf):
    return _ts(H.source_metrics(fx.inventory(spark, sf), "retailer_name"))


def ag4b(spark, sf):
    return _ts(H.source_metrics(_direct(spark, sf), "brand_name", available=F.col("is_available")))


def ag5(spark, sf):
    return H.link_health(fx.inventory(spark, sf))


def ag6(spark, sf):
    return H.supported_counts(fx.inventory(spark, sf), S)


def _link(spark, sf):
    return H.linkage_metrics(fx.inventory(spark, sf), S)


def ag8(spark, sf):
    return H.availability_health(fx.inventory(spark, sf))


def jn10(spark, sf):
    moved = fx.inventory(spark, sf).withColumn("region_code", F.when(F.col("true_size_id") % 19 == 0, "ASIA").otherwise(F.col("region_code")))
    return H.region_leakage(moved, fx.retailers(spark, sf))


def _gaps(spark, sf):
    m = fx.models(spark, sf).filter(F.col("brand_name").isin(*S))
    live = fx.inventory(spark, sf).filter("is_active").filter(F.col("brand_name").isin(*S))
    d = fx.direct(spark, sf).filter(F.col("brand_name").isin(*S) & F.col("is_available"))
    return H.coverage_gaps(m, live, d, fx.REGIONS)


def _expect(spark, sf):
    """Expectations for every retailer in two regions: its own and a derived one."""
    r = fx.retailers(spark, sf)
    k = F.col("retailer_id") % 6
    a = F.when(k == 0, "planned").when(k == 1, "not_applicable").when(k == 2, "dealer_network_only").otherwise("expected")
    return r.select("region_code", "retailer_name", a.alias("applicability"))


def _matrix(spark, sf):
    m = H.source_metrics(fx.inventory(spark, sf), "retailer_name")
    return H.source_matrix(_expect(spark, sf), m, "retailer_name", _now())


def jn17(spark, sf):
    return _ts(_matrix(spark, sf))


def jn17g(spark, sf):
    m = H.source_metrics(fx.inventory(spark, sf), "retailer_name")
    return _ts(H.source_grid(_expect(spark, sf), m, "retailer_name", _GRID, _now()))


def ob1(spark, sf):
    return _matrix(spark, sf).groupBy("region_code", "color", "label").agg(F.count("*").alias("sources"))


class _States:
    """Both fact tables read once each; what every report of a dashboard needs."""

    def __init__(self, spark, sf):
        self.retail = checkpointed(H.metric_states(fx.inventory(spark, sf), ["retailer_id", "retailer_name", "brand_name"], is_available_status("stock_status")))
        live = F.col("is_available")
        self.direct = checkpointed(H.metric_states(_direct(spark, sf), ["brand_id", "brand_name"], live, models_of=live))
        self.models, self.expected = fx.models(spark, sf).filter(F.col("brand_name").isin(*S)), _expect(spark, sf)

    def overview(self):
        named = lambda df: df.filter(F.col("brand_name").isin(*S))
        gaps = H.coverage_gaps_of(self.models, named(self.retail), named(self.direct), fx.REGIONS)
        return H.region_overview(H.region_metrics_of(self.retail, "retailer_id"), H.region_metrics_of(self.direct, "brand_id"), self.linkage(), gaps, _now())

    def linkage(self):
        return H.linkage_metrics_of(self.retail, S)

    def catalogue(self):
        h = (F.col("brand_id") % 2 == 0).cast("long")
        return self.direct.select("region_code", "brand_id").distinct().groupBy("region_code").agg(F.count("*").alias("brands"), F.sum(h).alias("healthy_brands"))

    def retailers(self):
        return H.retailer_health(H.source_matrix(self.expected, H.source_metrics_of(self.retail, "retailer_name"), "retailer_name", _now()), self.linkage())

    def brands(self):
        x = self.direct.select("region_code", "brand_name").distinct().withColumn("applicability", F.lit("expected"))
        return H.source_matrix(x, H.source_metrics_of(self.direct, "brand_name"), "brand_name", _now())


def _overview(spark, sf):
    return _States(spark, sf).overview()


def ob6(spark, sf):
    s = _States(spark, sf)
    return H.region_readiness(s.overview(), s.catalogue())


def ob7(spark, sf):
    s = _States(spark, sf)
    return H.inventory_counts(H.region_metrics_of(s.retail, "retailer_id"), H.region_metrics_of(s.direct, "brand_id"), H.supported_counts_of(s.retail, S))


def ob7b(spark, sf):
    return H.search_quality(_link(spark, sf))


def _rh(spark, sf):
    return H.retailer_health(_matrix(spark, sf), _link(spark, sf))


def ob8(spark, sf):
    return H.retailer_health_summary(_rh(spark, sf))


def tk5(spark, sf):
    return H.order_by_severity(_rh(spark, sf), "color", "active_rows", "retailer_name").select("retailer_name", "color", "active_rows")


def tk4(spark, sf):
    r = _rm(spark, sf)
    return r.orderBy(in_order("region_code", ("EUROPE", "ASIA")), "region_code").select("region_code", "active_rows")


def _jobs(spark, sf):
    e = ev.job_state(fx.job_events(spark, sf), ["service", "region"])
    st = e.select(F.col("service").alias("job_name"), F.col("region").alias("region_code"), "latest_success", "last_status", "consecutive_failures")
    x = fx.job_events(spark, sf).select(F.col("service").alias("job_name"), F.col("region").alias("region_code")).distinct().select(
        "*", F.when(F.col("job_name") == "svc0", "GLOBAL").otherwise(F.col("region_code")).alias("expected_region"),
        (F.substring("job_name", 4, 1).cast("int") + 1).alias("freshness_hours"))
    return H.job_health(st, x, F.lit(fx.NOW).cast("timestamp") - F.expr("INTERVAL 1 DAY"))


def ob10(spark, sf):
    return _jobs(spark, sf).select("job_name", "region_code", "age_hours", "color", "consecutive_failures")


def ob9(spark, sf):
    s = _States(spark, sf)
    return H.alerts(s.overview(), s.retailers(), s.brands(), _jobs(spark, sf)).groupBy(
        "region_code", "category", "alert_group", "color", "severity").agg(F.count("*").alias("alerts"))


def ob11(spark, sf):
    st = fx.job_events(spark, sf).groupBy(F.col("region").alias("region_code")).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"), (F.count("*") % 4).alias("consecutive_failures"))
    return H.region_health(_rm(spark, sf), _dm(spark, sf), st, _now(), 240, 24)


def ob15(spark, sf):
    return H.pipeline_stages(_overview(spark, sf), _jobs(spark, sf), "svc0")


def ob12(spark, sf):
    mins = fx.retailers(spark, sf).select("retailer_id", F.lit(620).alias("minimum"))
    return H.minimum_violations(fx.inventory(spark, sf), mins, "retailer_id").select("retailer_id", "minimum", "rows")


def ob13(spark, sf):
    d = fx.inventory(spark, sf).groupBy("retailer_id").agg(F.count("size_id").alias("accepted"), F.sum((F.col("true_size_id") % 1000 == 7).cast("long")).alias("failures"))
    return H.failure_budget(d).select("retailer_id", "accepted", "failures", "budget", "verdict")


def ob14(spark, sf):
    b = fx.inventory(spark, sf)
    a = b.withColumn("region_code", F.when(F.col("true_size_id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("region_code")))
    return H.protected_violations(b, a, "ASIA")


QUERIES = {
    "ag3_region_metrics": ag3, "ag4_retailer_metrics": ag4, "ag4_brand_metrics": ag4b, "ag5_link_health": ag5, "ag6_supported_counts": ag6,
    "ag7_linkage_metrics": _link, "ag8_availability_health": ag8, "jn10_region_leakage": jn10, "st1_coverage_gaps": _gaps, "jn17_source_matrix": jn17, "jn17_source_grid": jn17g,
    "ob1_source_status": ob1, "ob5_region_overview": _overview, "ob6_region_readiness": ob6, "ob7_inventory_counts": ob7, "ob7_search_quality": ob7b,
    "ob8_retailer_health": ob8, "tk5_order_by_severity": tk5, "tk4_order_regions": tk4, "ob10_job_health": ob10, "ob9_alerts": ob9, "ob11_region_health": ob11,
    "ob15_pipeline_stages": ob15, "ob12_minimums": ob12, "ob13_failure_budget": ob13, "ob14_protected": ob14,
}

_AV = "(stock_status IS NULL OR lower(trim(stock_status)) IN ('in stock','instock','in_stock','available','true'))"
_SUP = "brand_name IN ('Maker 0','Maker 1','Maker 2')"


def _metrics(src: str, by: str, av: str, extra: str, ts: str, where: str = "is_active") -> str:
    return f"""SELECT {by}, count(*) AS active_rows, count(*) FILTER ({av}) AS available_rows, count(model_id) AS linked_model_rows, count(size_id) AS linked_size_rows,
{extra} max({ts}) AS latest FROM {src} WHERE {where} GROUP BY ALL"""


_RM = _metrics("inventory", "region_code", _AV, "count(DISTINCT retailer_id) AS source_count,", "checked_at")
_DM = _metrics("direct", "region_code", "is_available", "count(DISTINCT brand_id) AS source_count,", "scraped_at")
_RS = _metrics("inventory", "region_code, retailer_name", _AV, "", "checked_at")
_BS = _metrics("direct", "region_code, brand_name", "is_available", "", "scraped_at")
_FAM = "model_id IS NOT NULL AND construction IS NOT NULL AND length IS NOT NULL"


def _lk(level: str, r: str, s: str, b: str, by: str) -> str:
    return f"""SELECT '{level}' AS level, {r} AS region_code, {s} AS retailer_name, {b} AS brand_name, count(*) AS supported_rows, count(model_id) AS model_rows,
count(*) FILTER ({_FAM}) AS family_rows, count(size_id) AS size_rows, round(count(model_id)*100.0/count(*),2) AS model_pct,
round(count(*) FILTER ({_FAM})*100.0/count(*),2) AS family_pct, round(count(size_id)*100.0/count(*),2) AS size_pct FROM inventory WHERE is_active AND {_SUP} GROUP BY {by}"""


_N = "CAST(NULL AS VARCHAR)"
_LINK = " UNION ALL ".join([_lk("region", "region_code", _N, _N, "region_code"), _lk("retailer", "region_code", "retailer_name", _N, "region_code, retailer_name"),
                            _lk("brand", "region_code", _N, "brand_name", "region_code, brand_name")])
_GAPS = f"""SELECT r_name AS region_code, (SELECT count(*) FROM models WHERE {_SUP}) AS supported_models,
(SELECT count(*) FROM models WHERE {_SUP}) - (SELECT count(DISTINCT model_id) FROM inventory i WHERE is_active AND {_SUP} AND i.region_code = r_name) AS no_retail,
(SELECT count(*) FROM models WHERE {_SUP}) - (SELECT count(DISTINCT model_id) FROM direct d WHERE is_available AND {_SUP} AND d.region_code = r_name) AS no_direct,
(SELECT count(*) FROM models WHERE {_SUP}) - (SELECT count(*) FROM (SELECT model_id FROM inventory i WHERE is_active AND {_SUP} AND i.region_code = r_name AND model_id IS NOT NULL UNION SELECT model_id FROM direct d WHERE is_available AND {_SUP} AND d.region_code = r_name AND model_id IS NOT NULL)) AS no_stock_anywhere,
(SELECT count(*) FROM (SELECT model_id FROM direct d WHERE is_available AND {_SUP} AND d.region_code = r_name AND model_id IS NOT NULL EXCEPT SELECT model_id FROM inventory i WHERE is_active AND {_SUP} AND i.region_code = r_name)) AS only_direct,
(SELECT count(*) FROM (SELECT model_id FROM inventory i WHERE is_active AND {_SUP} AND i.region_code = r_name AND model_id IS NOT NULL EXCEPT SELECT model_id FROM direct d WHERE is_available AND {_SUP} AND d.region_code = r_name)) AS only_retail FROM region"""
_GAPS2 = f"SELECT *, round(no_stock_anywhere * 100.0 / supported_models, 2) AS no_stock_pct FROM ({_GAPS})"


def _age(ts: str) -> str:
    return f"(epoch(TIMESTAMP '{NOW}') - epoch({ts})) / 3600.0"


def _color(app: str, ts: str, rows: str, what: str = "color") -> str:
    v = [("grey", "dealer_network_only"), ("grey", "not_applicable"), ("yellow", "partial"), ("yellow", "planned"), ("red", "missing"), ("red", "zero_rows"),
         ("green", "healthy"), ("yellow", "stale"), ("red", "stale")]
    v = [f"'{a if what == 'color' else b}'" for a, b in v]
    return f"""CASE WHEN {app} = 'dealer_network_only' THEN {v[0]} WHEN {app} = 'not_applicable' THEN {v[1]} WHEN {app} = 'planned' AND coalesce({rows},0) > 0 THEN {v[2]}
WHEN {app} = 'planned' THEN {v[3]} WHEN {ts} IS NULL THEN {v[4]} WHEN {rows} <= 0 THEN {v[5]} WHEN {_age(ts)} <= 24 THEN {v[6]} WHEN {_age(ts)} <= 48 THEN {v[7]} ELSE {v[8]} END"""


_EXP = """SELECT region_code, retailer_name, CASE retailer_id % 6 WHEN 0 THEN 'planned' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'dealer_network_only' ELSE 'expected' END AS applicability FROM retailers"""
_MATRIX = f"""SELECT coalesce(e.region_code, m.region_code) AS region_code, coalesce(e.retailer_name, m.retailer_name) AS retailer_name, coalesce(applicability,'not_applicable') AS applicability,
{_color("coalesce(applicability,'not_applicable')", 'latest', 'active_rows')} AS color, {_color("coalesce(applicability,'not_applicable')", 'latest', 'active_rows', 'label')} AS label,
coalesce(active_rows,0) AS active_rows, coalesce(available_rows,0) AS available_rows, coalesce(linked_model_rows,0) AS linked_model_rows, coalesce(linked_size_rows,0) AS linked_size_rows, latest
FROM e FULL JOIN rs m ON e.region_code = m.region_code AND e.retailer_name = m.retailer_name"""
_WORST = "CASE WHEN 'red' IN ({0}) THEN 'red' WHEN 'yellow' IN ({0}) THEN 'yellow' WHEN 'green' IN ({0}) THEN 'green' ELSE 'grey' END"
_OV = f"""SELECT *, {_WORST.format('retailer_status, direct_status, search_status')} AS overall_status FROM (SELECT g.region_code, coalesce(r.active_rows,0) AS retail_rows, coalesce(r.available_rows,0) AS retail_available,
coalesce(d.active_rows,0) AS direct_rows, supported_models, no_stock_anywhere, no_stock_pct, coalesce(supported_rows,0) AS supported_rows, model_pct, family_pct, size_pct,
{_color("'expected'", 'r.latest', 'r.active_rows')} AS retailer_status, {_color("'expected'", 'd.latest', 'd.active_rows')} AS direct_status,
CASE WHEN model_pct IS NULL OR family_pct IS NULL THEN 'yellow' WHEN model_pct >= 85 AND family_pct >= 60 THEN 'green' WHEN model_pct >= 75 AND family_pct >= 40 THEN 'yellow' ELSE 'red' END AS search_status,
CASE WHEN no_stock_pct < 20 THEN 'green' WHEN no_stock_pct <= 40 THEN 'yellow' ELSE 'red' END AS coverage_status
FROM gaps g LEFT JOIN rm r USING (region_code) LEFT JOIN dm d USING (region_code) LEFT JOIN (SELECT * FROM link WHERE level = 'region') k USING (region_code))"""
_STATE = """SELECT service AS job_name, region AS region_code, max(ts) FILTER (status = 'success') AS latest_success, arg_max(status, (ts, event_id)) AS last_status,
count(*) FILTER (status = 'failed' AND (ls IS NULL OR (ts, event_id) > ls)) AS consecutive_failures FROM (SELECT *, max((ts, event_id)) FILTER (status='success') OVER (PARTITION BY service, region) AS ls FROM job_events) GROUP BY ALL"""
_JOBS = f"""SELECT *, round(age, 2) AS age_hours, CASE WHEN latest_success IS NULL OR age > 2*lim THEN 'red' WHEN last_status='failed' AND consecutive_failures >= 2 THEN 'red'
WHEN age > lim OR last_status = 'failed' THEN 'yellow' ELSE 'green' END AS color FROM (SELECT *, CAST(substr(job_name,4,1) AS INT)+1 AS lim,
CASE WHEN job_name='svc0' THEN 'GLOBAL' ELSE region_code END AS expected_region, (epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(latest_success))/3600.0 AS age FROM st)"""


def h(body: str, *names: str) -> str:
    ctes = {"rm": _RM, "dm": _DM, "rs": _RS, "bs": _BS, "link": _LINK, "gaps": _GAPS2, "e": _EXP, "matrix": _MATRIX, "ov": _OV, "st": _STATE, "jobs": _JOBS}
    return sql("inventory direct models retailers job_events", body, **{n: ctes[n] for n in ctes if n in names})


_D = "strftime(latest, '%Y-%m-%d') AS latest_refresh"
_BAD = "('yellow','red')"
_SEV = "CASE color WHEN 'red' THEN 'critical' WHEN 'yellow' THEN 'warning' ELSE 'info' END"
_FRESH = "CASE WHEN {t} IS NULL THEN 'High' WHEN last_status='failed' AND {a} <= {h} AND consecutive_failures >= 2 THEN 'High' WHEN last_status='failed' AND {a} <= {h} THEN 'Warning' WHEN {a} > {h} THEN 'High' ELSE 'Healthy' END"

ORACLE = {
    "ag3_region_metrics": sql("inventory", f"SELECT * EXCLUDE (latest), {_D} FROM (" + _metrics("(SELECT * REPLACE (CASE WHEN true_size_id % 17 = 0 THEN '<NULL>' ELSE region_code END AS region_code) FROM inventory)", "region_code", _AV, "count(DISTINCT retailer_id) AS source_count,", "checked_at") + ")"),
    "ag4_retailer_metrics": h(f"SELECT * EXCLUDE (latest), {_D} FROM rs", "rs"),
    "ag4_brand_metrics": h(f"SELECT * EXCLUDE (latest), {_D} FROM bs", "bs"),
    "ag5_link_health": sql("inventory", " UNION ALL ".join(f"""SELECT '{lv}' AS level, {r} AS region_code, {s} AS retailer_name, count(*) AS active_rows, count(model_id) AS linked_model_rows, count(size_id) AS linked_size_rows,
round(count(model_id)*100.0/count(*),2) AS model_pct, round(count(size_id)*100.0/count(*),2) AS size_pct FROM inventory WHERE is_active {by}""" for lv, r, s, by in
        [("total", _N, _N, ""), ("region", "region_code", _N, "GROUP BY region_code"), ("retailer", "region_code", "retailer_name", "GROUP BY region_code, retailer_name")])),
    "ag6_supported_counts": sql("inventory", f"""SELECT region_code, count(*) FILTER ({_SUP}) AS supported_rows, count(*) FILTER (brand_name IS NULL OR NOT {_SUP}) AS unsupported_rows,
count(*) FILTER ({_SUP} AND title ILIKE '%used%') AS used_supported_rows FROM inventory WHERE is_active GROUP BY region_code"""),
    "ag7_linkage_metrics": sql("inventory", _LINK),
    "ag8_availability_health": sql("inventory", f"""SELECT region_code, brand_name, count(*) AS rows, count(*) FILTER ({_AV}) AS available_rows, count(DISTINCT model_id) FILTER ({_AV}) AS live_models,
count(DISTINCT size_id) FILTER ({_AV}) AS live_sizes, count(DISTINCT retailer_id) FILTER ({_AV}) AS live_retailers, count(*) FILTER ({_AV} AND product_url IS NULL) AS live_without_url,
count(*) FILTER ({_AV} AND price IS NULL) AS live_without_price FROM inventory WHERE is_active GROUP BY ALL"""),
    "jn10_region_leakage": sql("inventory retailers", """SELECT 'ASIA' AS region_code, region_code AS retailer_region, count(*) AS rows FROM inventory WHERE true_size_id % 19 = 0 AND region_code <> 'ASIA' GROUP BY 2"""),
    "st1_coverage_gaps": h("SELECT * FROM gaps", "gaps"),
    "jn17_source_grid": h(f"""SELECT region_code, retailer_name, applicability, {_color("applicability", 'latest', 'active_rows')} AS color, {_color("applicability", 'latest', 'active_rows', 'label')} AS label,
coalesce(active_rows,0) AS active_rows, coalesce(available_rows,0) AS available_rows, coalesce(linked_model_rows,0) AS linked_model_rows, coalesce(linked_size_rows,0) AS linked_size_rows, {_D}
FROM (SELECT g.region_code, s.retailer_name, coalesce(e.applicability, 'not_applicable') AS applicability, m.* EXCLUDE (region_code, retailer_name) FROM (SELECT retailer_name FROM e UNION SELECT retailer_name FROM rs) s
CROSS JOIN (SELECT unnest({list(_GRID)}) AS region_code) g LEFT JOIN e ON e.region_code = g.region_code AND e.retailer_name = s.retailer_name LEFT JOIN rs m ON m.region_code = g.region_code AND m.retailer_name = s.retailer_name)""", "rs", "e"),
    "jn17_source_matrix": h(f"SELECT * EXCLUDE (latest), {_D} FROM matrix", "rs", "e", "matrix"),
    "ob1_source_status": h("SELECT region_code, color, label, count(*) AS sources FROM matrix GROUP BY ALL", "rs", "e", "matrix"),
    "ob5_region_overview": h("SELECT * FROM ov", "rm", "dm", "link", "gaps", "ov"),
    "ob6_region_readiness": h("""SELECT *, round(operational*0.35 + search*0.30 + coverage*0.20 + catalogue*0.15, 2) AS overall FROM (SELECT o.region_code,
round((list_sum(list_transform([retailer_status, direct_status, overall_status], lambda s: CASE WHEN s IN ('green','grey') THEN 100.0 WHEN s='yellow' THEN 70.0 ELSE 40.0 END)))/3.0, 2)::DOUBLE AS operational,
round(CAST(model_pct AS DOUBLE)*0.55::DOUBLE + family_pct*0.35::DOUBLE + size_pct*0.10::DOUBLE, 2) AS search, round(100.0::DOUBLE - no_stock_pct, 2) AS coverage, round(c.healthy*100.0/c.n, 2) AS catalogue, supported_rows, retail_available AS fallback_rows
FROM ov o JOIN (SELECT region_code, count(DISTINCT brand_id) AS n, count(DISTINCT brand_id) FILTER (brand_id % 2 = 0) AS healthy FROM direct GROUP BY 1) c USING (region_code))""", "rm", "dm", "link", "gaps", "ov"),
    "ob7_inventory_counts": h(f"""SELECT region_code, r.active_rows AS retail_rows, r.available_rows AS retail_available, d.active_rows AS direct_rows, d.available_rows AS direct_available,
count(*) FILTER ({_SUP}) AS supported_rows, count(*) FILTER (brand_name IS NULL OR NOT {_SUP}) AS unsupported_rows, count(*) FILTER ({_SUP} AND title ILIKE '%used%') AS used_supported_rows
FROM rm r JOIN dm d USING (region_code) JOIN (SELECT * FROM inventory WHERE is_active) i USING (region_code) GROUP BY ALL""", "rm", "dm"),
    "ob7_search_quality": h("""SELECT region_code, supported_rows, model_pct, family_pct, size_pct, supported_rows - model_rows AS unlinked_models, model_rows - size_rows AS models_without_size,
CASE WHEN model_pct >= 85 AND family_pct >= 60 THEN 'green' WHEN model_pct >= 75 AND family_pct >= 40 THEN 'yellow' ELSE 'red' END AS status FROM link WHERE level = 'region'""", "link"),
    "ob8_retailer_health": h("""SELECT m.region_code, count(*) AS retailers, count(*) FILTER (color='green') AS healthy, count(*) FILTER (color='yellow') AS stale, count(*) FILTER (color='red') AS failing,
count(*) FILTER (color='grey') AS not_applicable, sum(active_rows)::BIGINT AS active_rows, sum(available_rows)::BIGINT AS available_rows, (2 * sum(CAST(round(model_pct * 100) AS BIGINT)) + count(model_pct)) // (2 * count(model_pct)) / 100.0 AS avg_model_pct, (2 * sum(CAST(round(size_pct * 100) AS BIGINT)) + count(size_pct)) // (2 * count(size_pct)) / 100.0 AS avg_size_pct,
count(*) FILTER (coalesce(model_pct<60,false) OR coalesce(family_pct<60,false) OR coalesce(size_pct<60,false)) AS low_linkage
FROM matrix m LEFT JOIN (SELECT * FROM link WHERE level='retailer') k ON m.region_code = k.region_code AND m.retailer_name = k.retailer_name WHERE applicability <> 'not_applicable' GROUP BY 1""", "rs", "link", "e", "matrix"),
    "tk5_order_by_severity": h("""SELECT retailer_name, color, active_rows FROM matrix WHERE applicability <> 'not_applicable'
ORDER BY CASE color WHEN 'red' THEN 3 WHEN 'yellow' THEN 2 WHEN 'green' THEN 1 ELSE 0 END DESC, active_rows DESC, retailer_name""", "rs", "e", "matrix"),
    "tk4_order_regions": h("SELECT region_code, active_rows FROM rm ORDER BY CASE region_code WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 99 END, region_code", "rm"),
    "ob10_job_health": h("SELECT job_name, region_code, age_hours, color, consecutive_failures FROM jobs", "st", "jobs"),
    "ob9_alerts": h(f"""SELECT region_code, category, alert_group, color, {_SEV} AS severity, count(*) AS alerts FROM (
SELECT region_code, 'retailer_inventory' AS category, 'stale_sources' AS alert_group, retailer_status AS color FROM ov WHERE retailer_status IN {_BAD}
UNION ALL SELECT region_code, 'manufacturer_availability', 'stale_sources', direct_status FROM ov WHERE direct_status IN {_BAD}
UNION ALL SELECT region_code, 'search_quality', 'linkage_warnings', search_status FROM ov WHERE search_status IN {_BAD}
UNION ALL SELECT region_code, 'market_coverage', 'linkage_warnings', coverage_status FROM ov WHERE coverage_status IN {_BAD}
UNION ALL SELECT region_code, 'retailer_source', 'critical', color FROM matrix WHERE color='red' AND applicability <> 'not_applicable' AND region_code NOT IN (SELECT region_code FROM ov WHERE retailer_status IN {_BAD})
UNION ALL SELECT region_code, 'mfa_source', 'critical', 'red' FROM bs WHERE {_color("'expected'", 'latest', 'active_rows')} = 'red' AND region_code NOT IN (SELECT region_code FROM ov WHERE direct_status IN {_BAD})
UNION ALL SELECT region_code, 'job_health', CASE color WHEN 'red' THEN 'critical' ELSE 'stale_sources' END, color FROM jobs WHERE color IN {_BAD} AND NOT (expected_region='GLOBAL' AND color='yellow')) GROUP BY ALL""",
                    "rm", "dm", "rs", "bs", "link", "gaps", "e", "matrix", "ov", "st", "jobs"),
    "ob11_region_health": h(f"""SELECT *, CASE WHEN 'High' IN (inventory_status, direct_status) THEN 'High' WHEN 'Warning' IN (inventory_status, direct_status) THEN 'Warning' ELSE 'Healthy' END AS status FROM (
SELECT region_code, r.active_rows AS retail_rows, round(r.linked_model_rows*100.0/r.active_rows,2) AS retail_model_rate, round(r.linked_size_rows*100.0/r.active_rows,2) AS retail_size_rate,
d.active_rows AS direct_rows, round(d.linked_model_rows*100.0/d.active_rows,2) AS direct_model_rate, round(d.linked_size_rows*100.0/d.active_rows,2) AS direct_size_rate, last_status, consecutive_failures,
{_FRESH.format(t='r.latest', a=_age('r.latest'), h=240)} AS inventory_status, {_FRESH.format(t='d.latest', a=_age('d.latest'), h=24)} AS direct_status FROM rm r JOIN dm d USING (region_code)
JOIN (SELECT region AS region_code, arg_max(status, (ts, event_id)) AS last_status, count(*) % 4 AS consecutive_failures FROM job_events GROUP BY 1) s USING (region_code))""", "rm", "dm"),
    "ob15_pipeline_stages": h("""SELECT stage, color, metric, CASE WHEN color IN ('yellow','red') THEN r END AS worst_region, CASE WHEN color IN ('yellow','red') THEN r || ': ' || color ELSE 'All expected regions are healthy.' END AS issue
FROM (SELECT stage, arg_max(color, sv) AS color, sum(metric)::BIGINT AS metric, min_by(region_code, (-sv, region_code)) AS r FROM (SELECT *, CASE color WHEN 'red' THEN 3 WHEN 'yellow' THEN 2 WHEN 'green' THEN 1 ELSE 0 END AS sv FROM (
SELECT region_code, 'retailer_inventory' AS stage, retailer_status AS color, retail_rows AS metric FROM ov UNION ALL SELECT region_code, 'manufacturer_direct', direct_status, direct_rows FROM ov
UNION ALL SELECT region_code, 'search_linkage', search_status, supported_rows FROM ov UNION ALL SELECT region_code, 'coverage', coverage_status, no_stock_anywhere FROM ov
UNION ALL SELECT region_code, 'jobs', color, 1 FROM jobs)) GROUP BY stage)
UNION ALL SELECT 'global_catalogue', coalesce(arg_min(color, region_code), 'grey'), count(*), NULL, CASE WHEN count(*) = 0 THEN 'No recent global catalogue execution' ELSE coalesce('Last success ' || strftime(arg_min(latest_success, region_code), '%Y-%m-%d'), 'No recent global catalogue success') END
|| CASE WHEN arg_min(color, region_code) = 'yellow' THEN '; canonical truth preserved' ELSE '' END FROM jobs WHERE job_name = 'svc0'""", "rm", "dm", "link", "gaps", "ov", "st", "jobs"),
    "ob12_minimums": sql("inventory retailers", "SELECT retailer_id, 620 AS minimum, count(inventory_id) AS rows FROM retailers LEFT JOIN inventory USING (retailer_id) GROUP BY 1 HAVING count(inventory_id) < 620"),
    "ob13_failure_budget": sql("inventory", """SELECT *, CASE WHEN accepted <= 0 OR failures > budget THEN 'hard' ELSE 'soft' END AS verdict FROM (SELECT *, least(20, greatest(1, ceil(accepted*0.01)))::BIGINT AS budget FROM (
SELECT retailer_id, count(size_id) AS accepted, count(*) FILTER (true_size_id % 1000 = 7) AS failures FROM inventory GROUP BY 1)) WHERE failures > 0"""),
    "ob14_protected": sql("inventory", """SELECT region_code, count(*) AS before, count(*) FILTER (true_size_id % 50 <> 0) AS "after" FROM inventory WHERE region_code <> 'ASIA' GROUP BY 1
UNION ALL SELECT NULL, 0, count(*) FROM inventory WHERE true_size_id % 50 = 0"""),
}
