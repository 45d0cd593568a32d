"""Health metrics, statuses, scores, guards and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import dims as D
from stockloom.functions import text as T
from stockloom.functions.status import (
    age_hours, combine_status, is_available_status, region_or_null, search_health, severity, source_status,
)


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


# --------------------------------------------------------------------------- aggregates


def _metric_columns(available: Column) -> list[Column]:
    return [
        F.count("*").alias("active_rows"), _n(available).alias("available_rows"),
        _n(F.col("model_id").isNotNull()).alias("linked_model_rows"), _n(F.col("size_id").isNotNull()).alias("linked_size_rows"),
    ]


def region_metrics(inv: DataFrame, source: str = "retailer_id", times: Sequence[str] = ("checked_at",), available: Column | None = None) -> DataFrame:
    """Active rows per region: counts, links, distinct sources, latest refresh."""
    a = is_available_status("stock_status") if available is None else available
    return inv.filter("is_active").groupBy(region_or_null("region_code").alias("region_code")).agg(
        *_metric_columns(a), F.countDistinct(source).alias("source_count"), F.max(F.coalesce(*times)).alias("latest_refresh"))


def source_metrics(inv: DataFrame, dim: str, times: Sequence[str] = ("checked_at",), available: Column | None = None) -> DataFrame:
    """The same per region and ``dim`` (retailer or brand name)."""
    a = is_available_status("stock_status") if available is None else available
    return inv.filter("is_active").groupBy(region_or_null("region_code").alias("region_code"), dim).agg(
        *_metric_columns(a), F.max(F.coalesce(*times)).alias("latest_refresh"))


def link_health(inv: DataFrame) -> DataFrame:
    """Total, region and region × retailer in one pass."""
    i = inv.filter("is_active").withColumn("region_code", region_or_null("region_code"))
    n = F.col("active_rows")
    g = i.rollup("region_code", "retailer_name").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("active_rows"),
        _n(F.col("model_id").isNotNull()).alias("linked_model_rows"), _n(F.col("size_id").isNotNull()).alias("linked_size_rows"))
    level = F.when(F.col("gid") == 0, "retailer").when(F.col("gid") == 1, "region").otherwise("total")
    return g.select(level.alias("level"), "region_code", "retailer_name", "active_rows", "linked_model_rows", "linked_size_rows",
                    D.pct(F.col("linked_model_rows"), n).alias("model_pct"), D.pct(F.col("linked_size_rows"), n).alias("size_pct"))


def supported_counts(inv: DataFrame, supported: Sequence[str]) -> DataFrame:
    s = F.coalesce(F.col("brand_name").isin(*supported), F.lit(False))
    used = F.lower(F.coalesce("title", F.lit(""))).contains("used")
    return inv.filter("is_active").groupBy(region_or_null("region_code").alias("region_code")).agg(
        _n(s).alias("supported_rows"), _n(~s).alias("unsupported_rows"), _n(s & used).alias("used_supported_rows"))


def linkage_metrics(inv: DataFrame, supported: Sequence[str]) -> DataFrame:
    """Supported rows by region, region × retailer, region × brand, with the family rule."""
    r, s, b = F.col("region_code"), F.col("retailer_name"), F.col("brand_name")
    i = inv.filter(F.col("is_active") & b.isin(*supported)).withColumn("region_code", region_or_null("region_code"))
    family = F.col("model_id").isNotNull() & ~T.blank("construction") & ~T.blank("length")
    g = i.groupingSets([[r], [r, s], [r, b]], r, s, b).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("supported_rows"), _n(F.col("model_id").isNotNull()).alias("model_rows"),
        _n(family).alias("family_rows"), _n(F.col("size_id").isNotNull()).alias("size_rows"))
    level = F.when(F.col("gid") == 3, "region").when(F.col("gid") == 1, "retailer").otherwise("brand")
    n = F.col("supported_rows")
    return g.select(level.alias("level"), "region_code", "retailer_name", "brand_name", "supported_rows", "model_rows", "family_rows", "size_rows",
                    *[D.pct(F.col(f"{x}_rows"), n).alias(f"{x}_pct") for x in ("model", "family", "size")])


def availability_health(inv: DataFrame) -> DataFrame:
    """Region × brand: rows, available rows, and distinct models, sizes and retailers with stock."""
    live = is_available_status("stock_status")
    return inv.filter("is_active").groupBy(region_or_null("region_code").alias("region_code"), "brand_name").agg(
        F.count("*").alias("rows"), _n(live).alias("available_rows"), F.countDistinct(F.when(live, F.col("model_id"))).alias("live_models"),
        F.countDistinct(F.when(live, F.col("size_id"))).alias("live_sizes"), F.countDistinct(F.when(live, F.col("retailer_id"))).alias("live_retailers"),
        _n(live & F.col("product_url").isNull()).alias("live_without_url"), _n(live & F.col("price").isNull()).alias("live_without_price"))


def region_leakage(inv: DataFrame, retailers: DataFrame) -> DataFrame:
    """Listings whose region differs from their retailer's, counted by the two regions."""
    r = retailers.select("retailer_id", F.col("region_code").alias("retailer_region"))
    j = inv.select("retailer_id", "region_code").join(r, "retailer_id").filter(F.col("region_code") != F.col("retailer_region"))
    return j.groupBy("region_code", "retailer_region").agg(F.count("*").alias("rows"))


def coverage_gaps(models: DataFrame, retail: DataFrame, direct: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Per region: models without stock at retailers, direct, anywhere; and only on one side.

    The per-region id sets are joined once; the total number of models is a one-row side.
    """
    a = retail.select("region_code", "model_id").filter("model_id IS NOT NULL").distinct().withColumn("r", F.lit(1))
    b = direct.select("region_code", "model_id").filter("model_id IS NOT NULL").distinct().withColumn("d", F.lit(1))
    both = a.join(b, ["region_code", "model_id"], "full").groupBy("region_code").agg(
        F.count("r").alias("nr"), F.count("d").alias("nd"), F.count("*").alias("na"),
        _n(F.col("r").isNull()).alias("only_direct"), _n(F.col("d").isNull()).alias("only_retail"))
    # one row per region and the total, without a cross join
    total = models.select("model_id").distinct().agg(F.count("*").alias("supported_models")).select(
        "supported_models", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region_code"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap = lambda c: F.greatest(F.lit(0), F.col("supported_models") - z(c))
    return total.join(both, "region_code", "left").select(
        "region_code", "supported_models", gap("nr").alias("no_retail"), gap("nd").alias("no_direct"), gap("na").alias("no_stock_anywhere"),
        z("only_direct").alias("only_direct"), z("only_retail").alias("only_retail"), D.pct(gap("na"), F.col("supported_models")).alias("no_stock_pct"))


def coverage_status(no_stock_pct: Column, supported: Column) -> Column:
    return F.when(supported <= 0, "grey").when(no_stock_pct < 20, "green").when(no_stock_pct <= 40, "yellow").otherwise("red")


# --------------------------------------------------------------------------- one pass for every report
#
# Every report above is a sum, a maximum or a distinct count over the same active rows.  States per
# (region, source, brand) hold what these need and merge: counts add up, times keep the latest, and
# distinct models are bitmaps joined by "or".  One scan makes the states, and reports read them.


def metric_states(rows: DataFrame, keys: Sequence[str], available: Column, times: Sequence[str] = ("checked_at",), models_of: Column | None = None) -> DataFrame:
    """States of active rows per region, ``keys`` and range of 32,768 model ids.

    ``models_of`` tells which rows' models are remembered; all by default.
    """
    family = F.col("model_id").isNotNull() & ~T.blank("construction") & ~T.blank("length")
    used = F.lower(F.coalesce("title", F.lit(""))).contains("used") if "title" in rows.columns else F.lit(False)
    model = F.col("model_id") if models_of is None else F.when(models_of, F.col("model_id"))
    live = rows.filter("is_active").withColumn("region_code", region_or_null("region_code")).withColumn("_model", model)
    return live.groupBy("region_code", *keys, F.bitmap_bucket_number("_model").alias("bucket")).agg(
        *_metric_columns(available), _n(family).alias("family_rows"), _n(used).alias("used_rows"), F.max(F.coalesce(*times)).alias("latest_refresh"),
        F.bitmap_construct_agg(F.bitmap_bit_position("_model")).alias("models"))


def _merged() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("active_rows", "available_rows", "linked_model_rows", "linked_size_rows")]


def region_metrics_of(states: DataFrame, source: str) -> DataFrame:
    """``region_metrics`` from states."""
    return states.groupBy("region_code").agg(*_merged(), F.countDistinct(source).alias("source_count"), F.max("latest_refresh").alias("latest_refresh"))


def source_metrics_of(states: DataFrame, dim: str) -> DataFrame:
    """``source_metrics`` from states."""
    return states.groupBy("region_code", dim).agg(*_merged(), F.max("latest_refresh").alias("latest_refresh"))


def supported_counts_of(states: DataFrame, supported: Sequence[str]) -> DataFrame:
    """``supported_counts`` from states."""
    s = F.coalesce(F.col("brand_name").isin(*supported), F.lit(False))
    of = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    return states.groupBy("region_code").agg(of(s, "active_rows").alias("supported_rows"), of(~s, "active_rows").alias("unsupported_rows"), of(s, "used_rows").alias("used_supported_rows"))


def linkage_metrics_of(states: DataFrame, supported: Sequence[str]) -> DataFrame:
    """``linkage_metrics`` from states."""
    r, s, b = F.col("region_code"), F.col("retailer_name"), F.col("brand_name")
    g = states.filter(b.isin(*supported)).groupingSets([[r], [r, s], [r, b]], r, s, b).agg(
        F.grouping_id().alias("gid"), F.sum("active_rows").alias("supported_rows"), F.sum("linked_model_rows").alias("model_rows"),
        F.sum("family_rows").alias("family_rows"), F.sum("linked_size_rows").alias("size_rows"))
    level = F.when(F.col("gid") == 3, "region").when(F.col("gid") == 1, "retailer").otherwise("brand")
    return g.select(level.alias("level"), "region_code", "retailer_name", "brand_name", "supported_rows", "model_rows", "family_rows", "size_rows",
                    *[D.pct(F.col(f"{x}_rows"), F.col("supported_rows")).alias(f"{x}_pct") for x in ("model", "family", "size")])


def coverage_gaps_of(models: DataFrame, retail: DataFrame, direct: DataFrame, regions: Sequence[str]) -> DataFrame:
    """``coverage_gaps`` from the states of the supported brands: unions of bitmaps instead of sets of ids."""
    of = lambda df, side: df.filter("bucket IS NOT NULL").groupBy("region_code", "bucket").agg(F.bitmap_or_agg("models").alias("m")).withColumn("side", F.lit(side))
    # a bucket has one bitmap a side
    ranges = of(retail, "r").unionByName(of(direct, "d")).groupBy("region_code", "bucket").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == x, F.bitmap_count("m"))), F.lit(0)).alias(x) for x in "rd"], F.bitmap_count(F.bitmap_or_agg("m")).alias("a"))
    both = ranges.groupBy("region_code").agg(*[F.sum(c).alias(f"n{c}") for c in "rda"])
    total = models.select("model_id").distinct().agg(F.count("*").alias("supported_models")).select(
        "supported_models", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region_code"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap = lambda c: F.greatest(F.lit(0), F.col("supported_models") - z(c))
    return total.join(both, "region_code", "left").select(
        "region_code", "supported_models", gap("nr").alias("no_retail"), gap("nd").alias("no_direct"), gap("na").alias("no_stock_anywhere"),
        (z("na") - z("nr")).alias("only_direct"), (z("na") - z("nd")).alias("only_retail"), D.pct(gap("na"), F.col("supported_models")).alias("no_stock_pct"))


# --------------------------------------------------------------------------- statuses


def freshness_status(latest: Column, now: Column, hours: int, last_status: Column, failures: Column) -> Column:
    fresh = age_hours(latest, now) <= hours
    failed = F.coalesce(F.lower(last_status) == "failed", F.lit(False))
    return (
        F.when(latest.isNull(), "High").when(failed & fresh & (F.coalesce(failures, F.lit(0)) >= 2), "High")
        .when(failed & fresh, "Warning").when(~fresh, "High").otherwise("Healthy")
    )


def worst_level(a: Column, b: Column) -> Column:
    out = F.lit("Healthy")
    for level in ("Warning", "High", "Critical"):
        out = F.when((a == level) | (b == level), level).otherwise(out)
    return out


def source_matrix(expectations: DataFrame, metrics: DataFrame, source: str, now: Column) -> DataFrame:
    """Every expected (source, region) pair with its metrics and status.

    ``expectations`` lists the pairs it knows (source, region_code, applicability), so no
    cross join is needed; pairs with metrics but no expectation are "not_applicable".
    """
    m = metrics.select("region_code", source, "active_rows", "available_rows", "linked_model_rows", "linked_size_rows", "latest_refresh")
    j = expectations.join(m, ["region_code", source], "full").withColumn("applicability", F.coalesce("applicability", F.lit("not_applicable")))
    st = source_status("applicability", "latest_refresh", "active_rows", now)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("region_code", source, "applicability", st["color"].alias("color"), st["label"].alias("label"),
                    *[z(c) for c in ("active_rows", "available_rows", "linked_model_rows", "linked_size_rows")], "latest_refresh")


def source_grid(expectations: DataFrame, metrics: DataFrame, source: str, regions: Sequence[str], now: Column) -> DataFrame:
    """Every known source in every listed region, also where it has neither expectation nor metrics.

    Sources are those of either table; blank and unknown ones are left out.  The list of
    regions is short and repeats each source, so no cross join is planned.
    """
    named = lambda df: df.select(source).filter(~T.blank(source) & (F.col(source) != "<unknown>"))
    cells = named(expectations).unionByName(named(metrics)).distinct().select(source, F.explode(F.array(*[F.lit(r) for r in regions])).alias("region_code"))
    known = expectations.select(source, "region_code", "applicability")
    j = cells.join(known, [source, "region_code"], "left").withColumn("applicability", F.coalesce("applicability", F.lit("not_applicable")))
    return source_matrix(j.select(source, "region_code", "applicability"), metrics.filter(F.col("region_code").isin(*regions) & F.col(source).isNotNull()), source, now)


def region_overview(retail: DataFrame, direct: DataFrame, linkage: DataFrame, gaps: DataFrame, now: Column) -> DataFrame:
    """One row per region with its four statuses and the worst of the first three.

    ``retail`` and ``direct`` are region metrics, ``linkage`` the region level of
    ``linkage_metrics``, ``gaps`` the coverage gaps.
    """
    r = retail.select("region_code", F.col("active_rows").alias("retail_rows"), F.col("available_rows").alias("retail_available"), F.col("latest_refresh").alias("rt"))
    d = direct.select("region_code", F.col("active_rows").alias("direct_rows"), F.col("latest_refresh").alias("dt"))
    k = linkage.filter("level = 'region'").select("region_code", "supported_rows", "model_pct", "family_pct", "size_pct")
    j = gaps.join(r, "region_code", "left").join(d, "region_code", "left").join(k, "region_code", "left")
    exp = F.lit("expected")
    j = j.select(
        "region_code", F.coalesce("retail_rows", F.lit(0)).alias("retail_rows"), F.coalesce("retail_available", F.lit(0)).alias("retail_available"),
        F.coalesce("direct_rows", F.lit(0)).alias("direct_rows"), "supported_models", "no_stock_anywhere", "no_stock_pct",
        F.coalesce("supported_rows", F.lit(0)).alias("supported_rows"), "model_pct", "family_pct", "size_pct",
        source_status(exp, F.col("rt"), F.col("retail_rows"), now)["color"].alias("retailer_status"),
        source_status(exp, F.col("dt"), F.col("direct_rows"), now)["color"].alias("direct_status"),
        search_health("model_pct", "family_pct").alias("search_status"),
        coverage_status(F.col("no_stock_pct"), F.col("supported_models")).alias("coverage_status"))
    return j.withColumn("overall_status", combine_status("retailer_status", "direct_status", "search_status"))


def region_readiness(overview: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Operational, search, coverage, catalogue and overall score per region.

    ``catalogue`` has region_code, brands and healthy_brands.
    """
    def score(c: str) -> Column:
        return F.when(F.col(c).isin("green", "grey"), 100.0).when(F.col(c) == "yellow", 70.0).otherwise(40.0)

    ops = F.round((score("retailer_status") + score("direct_status") + score("overall_status")) / 3.0, 2)
    search = F.round(D.clamp_pct(F.col("model_pct")) * 0.55 + D.clamp_pct(F.col("family_pct")) * 0.35 + D.clamp_pct(F.col("size_pct")) * 0.10, 2)
    cov = F.round(D.clamp_pct(100.0 - F.coalesce("no_stock_pct", F.lit(0.0))), 2)
    cat = F.when(F.coalesce("brands", F.lit(0)) > 0, F.round(F.col("healthy_brands") * 100.0 / F.col("brands"), 2)).otherwise(F.lit(100.0))
    s = overview.join(catalogue, "region_code", "left").select(
        "region_code", ops.alias("operational"), search.alias("search"), cov.alias("coverage"), cat.alias("catalogue"),
        "supported_rows", F.col("retail_available").alias("fallback_rows"))
    overall = F.col("operational") * 0.35 + F.col("search") * 0.30 + F.col("coverage") * 0.20 + F.col("catalogue") * 0.15
    return s.withColumn("overall", F.round(overall, 2))


def inventory_counts(retail: DataFrame, direct: DataFrame, supported: DataFrame) -> DataFrame:
    r = retail.select("region_code", F.col("active_rows").alias("retail_rows"), F.col("available_rows").alias("retail_available"))
    d = direct.select("region_code", F.col("active_rows").alias("direct_rows"), F.col("available_rows").alias("direct_available"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return r.join(d, "region_code", "full").join(supported, "region_code", "left").select(
        "region_code", *[z(c) for c in ("retail_rows", "retail_available", "direct_rows", "direct_available", "supported_rows", "unsupported_rows", "used_supported_rows")])


def search_quality(linkage: DataFrame) -> DataFrame:
    k = linkage.filter("level = 'region'")
    return k.select("region_code", "supported_rows", "model_pct", "family_pct", "size_pct",
                    F.greatest(F.lit(0), F.col("supported_rows") - F.col("model_rows")).alias("unlinked_models"),
                    F.greatest(F.lit(0), F.col("model_rows") - F.col("size_rows")).alias("models_without_size"),
                    search_health("model_pct", "family_pct").alias("status"))


def retailer_health(matrix: DataFrame, linkage: DataFrame, low: float = 60.0) -> DataFrame:
    """Applicable retailers with link percentages, low-linkage flag and severity."""
    k = linkage.filter("level = 'retailer'").select("region_code", "retailer_name", "model_pct", "family_pct", "size_pct")
    j = matrix.filter("applicability <> 'not_applicable'").join(k, ["region_code", "retailer_name"], "left")
    flag = F.lit(False)
    for c in ("model_pct", "family_pct", "size_pct"):
        flag = flag | F.coalesce(F.col(c) < low, F.lit(False))
    return j.withColumn("low_linkage", flag).withColumn("severity", severity("color"))


def _mean_pct(name: str) -> Column:
    """Mean of percentages with two decimals, from whole hundredths, so that it depends on no order of rows; halves go up."""
    total, n = F.sum(F.round(F.col(name) * 100).cast("long")), F.count(name)
    return F.when(n > 0, F.floor((total * 2 + n) / (n * 2)) / 100.0)


def retailer_health_summary(health: DataFrame) -> DataFrame:
    c = F.col("color")
    return health.groupBy("region_code").agg(
        F.count("*").alias("retailers"), _n(c == "green").alias("healthy"), _n(c == "yellow").alias("stale"), _n(c == "red").alias("failing"),
        _n(c == "grey").alias("not_applicable"), F.sum("active_rows").alias("active_rows"), F.sum("available_rows").alias("available_rows"),
        _mean_pct("model_pct").alias("avg_model_pct"), _mean_pct("size_pct").alias("avg_size_pct"), _n(F.col("low_linkage")).alias("low_linkage"))


def order_by_severity(df: DataFrame, color: str, size: str, name: str) -> DataFrame:
    return df.orderBy(severity(color).desc(), F.desc(size), F.asc(name))


def alerts(overview: DataFrame, retailers: DataFrame, brands: DataFrame, jobs: DataFrame) -> DataFrame:
    """Region, source and job alerts; a degraded region silences its per-source alerts."""
    bad = ("yellow", "red")
    sev = lambda c: F.when(c == "red", "critical").when(c == "yellow", "warning").otherwise("info")
    kinds = [("retailer_inventory", "stale_sources", "retailer_status"), ("manufacturer_availability", "stale_sources", "direct_status"),
             ("search_quality", "linkage_warnings", "search_status"), ("market_coverage", "linkage_warnings", "coverage_status")]
    each = F.array(*[F.struct(F.lit(a).alias("category"), F.lit(g).alias("alert_group"), F.col(c).alias("color")) for a, g, c in kinds])
    region = overview.select("region_code", F.explode(each).alias("e")).select("region_code", "e.*", F.lit(None).cast("string").alias("source")).filter(F.col("color").isin(*bad))

    def per_source(df: DataFrame, name: str, status: str, category: str) -> DataFrame:
        quiet = overview.filter(F.col(status).isin(*bad)).select("region_code")
        return df.filter("color = 'red'").join(quiet, "region_code", "left_anti").select(
            "region_code", F.lit(category).alias("category"), F.lit("critical").alias("alert_group"), "color", F.col(name).alias("source"))

    job = jobs.filter(F.col("color").isin(*bad) & ~((F.col("expected_region") == "GLOBAL") & (F.col("color") == "yellow"))).select(
        "region_code", F.lit("job_health").alias("category"), F.when(F.col("color") == "red", "critical").otherwise("stale_sources").alias("alert_group"), "color", F.col("job_name").alias("source"))
    out = region.unionByName(per_source(retailers, "retailer_name", "retailer_status", "retailer_source"))
    out = out.unionByName(per_source(brands, "brand_name", "direct_status", "mfa_source")).unionByName(job)
    return out.withColumn("severity", sev(F.col("color")))


def job_health(states: DataFrame, expectations: DataFrame, now: Column) -> DataFrame:
    """Configured jobs with age and colour: fresh green, older yellow, twice as old red.

    ``expectations``: job_name, region_code, expected_region, freshness_hours.
    ``states``: job_name, region_code, latest_success, last_status, consecutive_failures.
    """
    j = expectations.join(states, ["job_name", "region_code"], "left")
    age, limit = age_hours("latest_success", now), F.col("freshness_hours")
    failed = F.coalesce(F.lower("last_status") == "failed", F.lit(False))
    color = (
        F.when(F.col("latest_success").isNull(), "red").when(age > limit * 2, "red")
        .when(failed & (F.coalesce("consecutive_failures", F.lit(0)) >= 2), "red").when((age > limit) | failed, "yellow").otherwise("green"))
    return j.withColumn("age_hours", F.round(age, 2)).withColumn("color", color)


def region_health(retail: DataFrame, direct: DataFrame, states: DataFrame, now: Column, inventory_hours: int, direct_hours: int) -> DataFrame:
    """Worst of the inventory and direct status per region, with link rates."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("region_code", F.col("active_rows").alias(f"{p}_rows"), D.pct(F.col("linked_model_rows"), F.col("active_rows")).alias(f"{p}_model_rate"),
                         D.pct(F.col("linked_size_rows"), F.col("active_rows")).alias(f"{p}_size_rate"), F.col("latest_refresh").alias(f"{p}_latest"))
    j = side(retail, "retail").join(side(direct, "direct"), "region_code", "full").join(states, "region_code", "left")
    a = freshness_status(F.col("retail_latest"), now, inventory_hours, F.col("last_status"), F.col("consecutive_failures"))
    b = freshness_status(F.col("direct_latest"), now, direct_hours, F.col("last_status"), F.col("consecutive_failures"))
    j = j.withColumn("inventory_status", a).withColumn("direct_status", b)
    return j.withColumn("status", worst_level(F.col("inventory_status"), F.col("direct_status"))).drop("retail_latest", "direct_latest")


def _catalogue_stage(jobs: DataFrame, name: str) -> DataFrame:
    """The stage of the global catalogue job: its colour, and its latest success as the issue; grey without such a job."""
    g = jobs.filter((F.upper("expected_region") == "GLOBAL") & (F.col("job_name") == name)).agg(
        F.min_by("color", "region_code").alias("color"), F.min_by("latest_success", "region_code").alias("at"), F.count("*").alias("n"))
    said = F.when(F.col("n") == 0, "No recent global catalogue execution").when(F.col("at").isNull(), "No recent global catalogue success").otherwise(
        F.concat(F.lit("Last success "), F.date_format("at", "yyyy-MM-dd")))
    kept = F.when(F.col("color") == "yellow", "; canonical truth preserved").otherwise("")
    return g.select(F.lit("global_catalogue").alias("stage"), F.coalesce("color", F.lit("grey")).alias("color"), F.col("n").alias("metric"), F.lit(None).cast("string").alias("worst_region"), F.concat(said, kept).alias("issue"))


def pipeline_stages(overview: DataFrame, jobs: DataFrame, catalogue_job: str | None = None) -> DataFrame:
    """Per stage: the worst colour over regions, rows handled, and of a yellow or red stage the first
    region by name that has the colour, with the issue in words; the global catalogue job is a stage of its own."""
    stages = [("retailer_inventory", "retailer_status", "retail_rows"), ("manufacturer_direct", "direct_status", "direct_rows"),
              ("search_linkage", "search_status", "supported_rows"), ("coverage", "coverage_status", "no_stock_anywhere")]
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("color"), F.col(m).cast("long").alias("metric")) for s, c, m in stages])
    long = overview.select("region_code", F.explode(each).alias("e")).select("region_code", "e.*")
    j = jobs.select("region_code", F.lit("jobs").alias("stage"), "color", F.lit(1).cast("long").alias("metric"))
    worst = long.unionByName(j).groupBy("stage").agg(
        F.max(F.struct(severity("color").alias("s"), F.col("color").alias("c"))).alias("w"), F.sum("metric").alias("metric"),
        F.min(F.struct((-severity("color")).alias("s"), F.col("region_code").alias("r"))).alias("i"))
    bad = F.col("w.c").isin("yellow", "red")
    out = worst.select(
        "stage", F.col("w.c").alias("color"), "metric", F.when(bad, F.col("i.r")).alias("worst_region"),
        F.when(bad, F.concat_ws(": ", "i.r", "w.c")).otherwise("All expected regions are healthy.").alias("issue"))
    return out if catalogue_job is None else out.unionByName(_catalogue_stage(jobs, catalogue_job))


# --------------------------------------------------------------------------- guards


def minimum_violations(df: DataFrame, minimums: DataFrame, key: str) -> DataFrame:
    """Sources of ``minimums`` (key, minimum) that have fewer rows than required."""
    n = df.groupBy(key).agg(F.count("*").alias("rows"))
    return minimums.join(n, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0))).filter(F.col("rows") < F.col("minimum"))


def raise_if_any(violations: DataFrame, message: str) -> None:
    """Fail the job, naming up to ten offenders."""
    found = violations.limit(10).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def assert_minimums(df: DataFrame, minimums: DataFrame, key: str) -> None:
    raise_if_any(minimum_violations(df, minimums, key), "too few rows")


def failure_budget(df: DataFrame, limit: int = 20, rate: float = 0.01) -> DataFrame:
    """Targets with failures: budget = min(limit, ceil(rate × accepted), at least 1)."""
    accepted, failures = F.coalesce("accepted", F.lit(0)), F.coalesce("failures", F.lit(0))
    budget = F.least(F.lit(limit), F.when(accepted > 0, F.greatest(F.lit(1), F.ceil(accepted * rate))).otherwise(F.lit(0))).cast("long")
    verdict = F.when((accepted <= 0) | (failures > budget), "hard").otherwise("soft")
    return df.filter(failures > 0).withColumn("budget", budget).withColumn("verdict", verdict)


def protected_violations(before: DataFrame, after: DataFrame, region: str) -> DataFrame:
    """Other regions whose row count changed, and any NULL region after the load."""
    b = before.groupBy("region_code").agg(F.count("*").alias("before"))
    a = after.groupBy("region_code").agg(F.count("*").alias("after"))
    j = b.join(a, b.region_code.eqNullSafe(a.region_code), "full").select(
        F.coalesce(b.region_code, a.region_code).alias("region_code"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    changed = (F.col("region_code") != region) & (F.col("before") != F.col("after"))
    return j.filter((F.col("region_code").isNull() & (F.col("after") > 0)) | F.coalesce(changed, F.lit(False)))


def assert_protected(before: DataFrame, after: DataFrame, region: str) -> None:
    raise_if_any(protected_violations(before, after, region), "protected regions changed")
