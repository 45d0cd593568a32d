"""Retailer and dealer network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import network as nw
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql

_WHY = ("", "Domain for sale", "No online surfboard inventory", "A distributor", "Shaper", "Clothing only", "", "accessory shop", "Not suitable", "", "")
_PLATFORMS = ("shopify", "woocommerce", "", "BigCommerce", "neto_maropost", "ecwid", "squarespace", "wix", "opencart")
_R = ("AU", "US", "EU", "ID", "CA", "UK", "JP", "NZ", "BR", "ZA", "MX", "PR", "HI")
_C = ("Australia", "France", "USA", "Japan", "Nowhere", "United States")


def _dealers(spark, sf):
    """Dealer records from customers: shared sites, sometimes none."""
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    country = F.element_at(F.array(*[F.lit(x) for x in _C]), (k % 6 + 1).cast("int"))
    return c.select(k.alias("dealer_id"), F.concat(F.lit("Dealer & Co "), k % 400, F.lit(" Surf Shop")).alias("dealer_name"), F.when(k % 3 != 0, F.concat(F.lit("https://www.D"), k % 250, F.lit(".example.com/x?y=1"))).alias("website"),
                    F.concat(F.lit("City "), k % 10).alias("city"), country.alias("country"), F.when(k % 12 == 2, "Hawaii").alias("state"), F.col("c_mktsegment").alias("manufacturer")).withColumn(
        "region_code", nw.infer_region("country", "state"))


def tx15(spark, sf):
    return _dealers(spark, sf).select("dealer_id", nw.site_key("website").alias("site"), nw.slug("dealer_name").alias("slug"), nw.dealer_key("dealer_name").alias("name_key"))


def tx16(spark, sf):
    return _dealers(spark, sf).groupBy("country", "state", "region_code").agg(F.count("*").alias("n"))


def tx19(spark, sf):
    d = _dealers(spark, sf)
    js = F.to_json(F.struct(F.struct(F.array((F.col("dealer_id") % 180).cast("double"), F.lit(1.5)).alias("coordinates")).alias("geometry"), F.struct(F.col("dealer_name").alias("name"), "website", "city", "country", "state").alias("properties")))
    return nw.dealer_rows(d.select("dealer_id", js.alias("feature"))).select("dealer_id", "dealer_name", "city", "lon", "lat", "region_code")


def _shops(spark, sf):
    return fx.retailers(spark, sf).select("retailer_id", F.concat(F.lit("Dealer and Co "), "retailer_id").alias("retailer_name"), F.when(F.col("retailer_id") % 2 == 0, F.concat(F.lit("http://d"), "retailer_id", F.lit(".example.com"))).alias("website"))


def jn16(spark, sf):
    return nw.match_retailer(_dealers(spark, sf), _shops(spark, sf)).select("dealer_id", "retailer_id")


def _merged(spark, sf):
    return nw.merge_dealers(_dealers(spark, sf), "dealer_id")


def ag15(spark, sf):
    return _merged(spark, sf).select("dealer_group", "dealer_name", "city", "region_code", "manufacturers", "sources")


def ag16(spark, sf):
    return nw.dealer_summary(_merged(spark, sf), nw.dealer_manufacturers(_dealers(spark, sf))).select("region_code", "manufacturer", "dealers", "rank")


def _scored(spark, sf):
    k = F.col("sources")
    d = _merged(spark, sf).withColumns({"known": k % 4 != 1, "blocked": k % 7 == 0, "running": k % 5 == 0, "configured": k % 3 == 0, "enabled": k % 2 == 0, "dealer_type": F.when(F.col("manufacturers") == 1, "distributor")})
    return nw.score_dealers(d, ["AU", "US"], ["EU"])


def pf19(spark, sf):
    return _scored(spark, sf).select("dealer_group", "status", "score")


def ag16s(spark, sf):
    return nw.dealer_status_counts(_scored(spark, sf), _R)


def ag16t(spark, sf):
    return nw.top_candidates(_scored(spark, sf)).select("region_code", "dealer_group", "status", "score", "manufacturers", "rank")


def ag16m(spark, sf):
    return nw.manufacturer_regions(_merged(spark, sf), nw.dealer_manufacturers(_dealers(spark, sf))).select("manufacturer", "region_code", "dealers", "dealer_count")


def pf20(spark, sf):
    d = _dealers(spark, sf)
    k = F.col("dealer_id")
    kind = F.when(k % 31 == 0, F.array(F.lit("Shaper_Direct"))).when(k % 37 == 0, F.array(F.lit("shop"), F.lit("distributor"))).when(k % 2 == 0, F.array(F.lit("shop")))
    c = d.withColumn("priority", F.when(k % 6 != 0, k % 6)).withColumn("retailer_types", kind)
    n = F.col("n")
    site = _merged(spark, sf).filter("website IS NOT NULL").select("website", F.regexp_extract("website", r"D(\d+)\.", 1).cast("int").alias("n"))
    text = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (n % by + 1).cast("int"))
    overrides = site.filter("n < 12").select("website", F.when(n < 8, text(("blocked", "parked_live", "parked_manual"), 3)).alias("status"), F.when(n % 2 == 0, "ECWID").alias("platform"), F.when(n == 3, True).alias("running"), F.when(n % 4 == 0, n).alias("priority_score"))
    discovery = site.filter("n >= 10 AND n < 60").select("website", F.when(n % 2 == 0, "ready_shopify").otherwise(" ").alias("status"), F.when(n % 3 == 0, "Shopify").alias("platform"), F.when(n % 5 != 0, n % 10).alias("priority_score"))
    running = site.filter("n % 3 <> 0").select("website", (n % 4 == 0).alias("enabled"), text(_WHY, 11).alias("governance_reason"), text(("", "stock_status_review", "parser_review"), 3).alias("governance_status"), F.lit("magento").alias("platform"), (n * 40).alias("available"))
    detection = site.filter("n % 5 <> 0").select("website", text(_PLATFORMS, 9).alias("platform"), text(("ok", "blocked", "failed", "ok"), 4).alias("status"))
    return nw.coverage_candidates(c, overrides, discovery, running, detection).select("dealer_id", "status", "platform", "priority_score", "decided_by", F.col("already_running").cast("int").alias("already_running"))


def pf12(spark, sf):
    k = F.col("dealer_id")
    d = _dealers(spark, sf).withColumns({"is_manufacturer": k % 11 == 0, "hardboards": F.when(k % 4 != 0, k % 13 != 0), "platform": F.when(k % 5 == 0, "").when(k % 5 == 1, "Wix").otherwise("Shopify")})
    return nw.activation_status(d, "Australia", ["shopify"]).select("dealer_id", "status", "reason")


def _targets(spark, sf):
    d = _dealers(spark, sf).select(F.col("dealer_id").alias("retailer_id"), "website", "country")
    det = d.withColumn("site", nw.site_key("website")).filter("site IS NOT NULL").groupBy("site").agg(F.min("retailer_id").alias("m")).filter("m % 4 <> 0").select("site", F.when(F.col("m") % 4 == 1, "unknown").otherwise("shopify").alias("platform"))
    ok = det.filter("platform = 'unknown'").select("site").filter(F.col("site").contains("1"))
    return nw.build_targets(d, det, ok)


def pf13(spark, sf):
    return _targets(spark, sf).select("retailer_id", "site", "excluded")


def pf13s(spark, sf):
    return nw.target_sites(_targets(spark, sf)).select("site", "first_retailer", "locations", "platform", F.col("approved").cast("int").alias("approved"))


def pf13l(spark, sf):
    return nw.site_locations(_targets(spark, sf))


def pf13m(spark, sf):
    """Every third site was a target before, as were sites that no dealer has any more."""
    n = F.regexp_extract("site", r"d(\d+)\.", 1).cast("int")
    t = _targets(spark, sf)
    known = nw.target_sites(t).select("site").filter(n % 3 == 0)
    gone = t.filter("site IS NOT NULL").select(F.concat(F.lit("gone-"), "site").alias("site")).distinct()
    old = known.unionByName(gone).withColumn("n", n).select(F.concat(F.lit("http://www."), "site", F.lit("/")).alias("website"), F.when(F.col("n") % 4 == 0, "wix").when(F.col("n") % 4 != 3, "Shopify").alias("platform"),
                                                           F.when(F.col("n") % 5 == 0, "Paused").when(F.col("n") % 5 != 4, " Active").alias("status"), (F.col("n") % 7).alias("priority"))
    approved = nw.target_sites(t).filter("platform = 'unknown'").select("site")
    return nw.merge_targets(nw.target_sites(t), old, approved, ["shopify", "woocommerce"]).select("site", "action", F.col("active").cast("int").alias("active"), "platform", "priority", "locations")


def pf15(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return nw.score_location(d, "text", [" the ", " that "], [" de ", "und "]).select("doc_id", "signals", "antisignals", "location_status")


def _names(spark, sf):
    return _dealers(spark, sf).select("dealer_id", F.when(F.col("dealer_id") % 4 == 0, F.concat(F.lit("Joe "), F.col("dealer_id") % 50)).when(F.col("dealer_id") % 4 == 1, F.concat(F.lit("Login Surf "), F.col("dealer_id") % 30)).otherwise(F.concat(F.lit("Wave Surf Shop "), F.col("dealer_id") % 90)).alias("name"), F.col("manufacturer").alias("brand"))


def pf16(spark, sf):
    return nw.filter_candidate_names(_names(spark, sf), "name", ["joe 1"], ["login", "cart"], ["surf", "board"], ["byron"]).select("name")


def ag17(spark, sf):
    return nw.group_entities(_names(spark, sf)).select("entity", "brand_count", "mentions")


def pf24(spark, sf):
    k = F.col("dealer_id")
    n = _names(spark, sf).withColumn("name", F.when(k % 5 == 0, F.concat(k % 70, F.lit(" High Street"))).when(k % 5 == 1, F.concat(F.lit("a"), k % 60, F.lit("@x.com"))).when(k % 5 == 2, F.upper("name")).otherwise(F.col("name")))
    return nw.review_entities(n, ["joe 3"]).select("name")


def pf24s(spark, sf):
    k = F.col("dealer_id")
    s = _names(spark, sf).withColumn("record_type", F.when(k % 3 == 0, "Retailer ").when(k % 3 == 1, "brand"))
    return nw.clean_seed(s, ["retailer"], ["joe 4"]).select("dealer_id")


def pf17(spark, sf):
    k = F.col("dealer_id")
    r = _dealers(spark, sf).select(
        "dealer_id", F.array(F.lit("https://a.example.com/boards"), F.when(k % 9 == 0, "https://a.example.com/US/p").when(k % 9 == 1, "https://a.example.com/usa/p")).alias("urls"),
        F.when(k % 2 == 0, "bigcommerce").when(k % 3 == 0, "shopify").alias("platform"), F.when(k % 11 != 0, (k % 25).cast("int")).alias("approx_count"), (k % 5 != 0).alias("price_visible"), F.when(k % 13 != 0, k % 4 != 2).alias("stock_visible"),
        F.when(k % 4 == 0, "ready_shopify").when(k % 4 == 1, " ").alias("current_status"), F.when(k % 3 == 1, "few").alias("review_reason"), F.when(k % 6 != 0, (k % 90).cast("int")).alias("priority"))
    return nw.classify_discovery(r).select("dealer_id", "status", "reason", "confidence", "priority")


def ag25(spark, sf):
    d = _dealers(spark, sf).withColumn("priority", (F.col("dealer_id") % 5).cast("int"))
    return nw.group_by_site(d, ["city", "country", "manufacturer"]).select("site", "field", "value", "priority")


def ag23(spark, sf):
    d, k = _dealers(spark, sf), F.col("dealer_id")
    s = k % 333
    n = lambda c, m: F.when(c, (k % m).cast("int"))
    rows = d.select(
        nw.slug(F.concat(F.lit("S "), s)).alias("slug"), F.when(k % 4 == 0, " shopify ").when(k % 4 == 1, "wix").alias("platform"), n(s % 5 != 0, 7).alias("raw"), n((s % 5 != 0) & (s % 3 != 0), 5).alias("verified"),
        n((s % 3 == 1) & (s % 2 == 0), 3).alias("available"), n(s % 2 == 0, 4).alias("normalised"), n(k % 2 == 0, 6).alias("duplicates"),
        F.element_at(F.array(*[F.lit(x) for x in ("failed", "poor", "warning", "fair", "good", "odd")]), (s % 6 + 1).cast("int")).alias("health"))
    active = d.select(nw.slug(F.concat(F.lit("S "), k % 500)).alias("slug"), F.lit("wix").alias("platform")).filter(k % 3 != 0)
    return nw.governance(rows, active, {"s-5": "Closed", "s-7": "Moved"}).select("slug", "platform", "raw", "verified", "available", "normalised", "duplicates", "source_rows", "active_target", "health", "state", "reason")


def tx20(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("category_id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent_id"))
    return nw.expand_categories(p, p.filter("category_id = 5 OR category_id = 11").select("category_id"))


QUERIES = {"tx15_keys": tx15, "tx16_infer_region": tx16, "tx19_dealer_rows": tx19, "jn16_match_retailer": jn16, "ag15_merge_dealers": ag15, "ag16_dealer_summary": ag16, "ag16_status_counts": ag16s, "ag16_top_candidates": ag16t, "ag16_manufacturers": ag16m, "pf19_score_dealers": pf19,
           "pf20_coverage_candidates": pf20, "pf12_activation_status": pf12, "pf13_build_targets": pf13, "pf13_target_sites": pf13s, "pf13_site_locations": pf13l, "pf13_merge_targets": pf13m, "pf15_score_location": pf15, "pf16_candidate_names": pf16,
           "ag17_group_entities": ag17, "pf24_review_entities": pf24, "pf24_clean_seed": pf24s, "pf17_classify_discovery": pf17, "ag25_group_by_site": ag25, "ag23_governance": ag23, "tx20_expand_categories": tx20}

_D0 = """SELECT c_custkey AS id, c_custkey AS k, 'Dealer & Co ' || (c_custkey % 400) || ' Surf Shop' AS dealer_name, CASE WHEN c_custkey % 3 <> 0 THEN 'd' || (c_custkey % 250) || '.example.com' END AS site, 'City ' || (c_custkey % 10) AS city,
(['Australia','France','USA','Japan','Nowhere','United States'])[c_custkey % 6 + 1] AS country, CASE WHEN c_custkey % 12 = 2 THEN 'Hawaii' END AS state, c_mktsegment AS manufacturer FROM customer"""
_D = """SELECT *, CASE WHEN state = 'Hawaii' THEN 'HI' WHEN country = 'Australia' THEN 'AU' WHEN country = 'France' THEN 'EU' WHEN country IN ('USA','United States') THEN 'US' WHEN country = 'Japan' THEN 'JP' ELSE 'OTHER' END AS region_code,
coalesce('site:' || site, 'name:|dealer and co ' || (k % 400) || '|city ' || (k % 10) || '|' || lower(country)) AS g FROM d0"""
_M = "SELECT g AS dealer_group, arg_min(dealer_name, id) AS dealer_name, max(site) AS site, arg_min(city, id) AS city, arg_min(region_code, id) AS region_code, count(DISTINCT manufacturer) AS manufacturers, count(*) AS sources FROM d GROUP BY g"
_NM = """SELECT id, CASE id % 4 WHEN 0 THEN 'Joe ' || (id % 50) WHEN 1 THEN 'Login Surf ' || (id % 30) ELSE 'Wave Surf Shop ' || (id % 90) END AS name, manufacturer AS brand FROM d"""


def n(body: str) -> str:
    return sql("", body, d0=_D0, d=_D, m=_M, nm=_NM)


_PF19 = """SELECT dealer_group, region_code, dealer_name, manufacturers, status, CASE status WHEN 'Blocked' THEN 1 WHEN 'Already running' THEN 5 WHEN 'Known but disabled' THEN CASE WHEN region_code IN ('AU','US') THEN 4 ELSE 3 END WHEN 'Configured but inactive' THEN 4
ELSE greatest(1, least(5, 1 + CASE WHEN region_code IN ('AU','US') THEN 2 WHEN region_code = 'EU' THEN 1 ELSE 0 END + (manufacturers >= 2)::INT + (site IS NOT NULL)::INT - (manufacturers = 1)::INT)) END AS score FROM (SELECT *, CASE WHEN sources % 7 = 0 THEN 'Blocked' WHEN sources % 5 = 0 THEN 'Already running'
WHEN sources % 3 = 0 AND sources % 2 = 0 THEN 'Configured but inactive' WHEN sources % 3 = 0 THEN 'Known but disabled' WHEN sources % 4 = 1 AND site IS NOT NULL THEN 'Candidate' ELSE 'Manual review' END AS status FROM m)"""
_TG = """SELECT id AS retailer_id, site, CASE WHEN site IS NULL THEN 'missing_website' WHEN mk % 4 = 1 AND contains(site,'1') THEN NULL WHEN mk % 4 = 0 THEN 'platform_unknown' WHEN mk % 4 = 1 THEN 'unsupported_platform' END AS excluded,
country, CASE WHEN mk % 4 = 0 THEN NULL WHEN mk % 4 = 1 THEN 'unknown' ELSE 'shopify' END AS platform, (mk % 4 = 1 AND contains(site,'1'))::INT AS approved FROM (SELECT *, min(id) OVER (PARTITION BY site) AS mk FROM d)"""
ORACLE = {
    "tx15_keys": n("SELECT id AS dealer_id, site, 'dealer-co-' || (id % 400) || '-surf-shop' AS slug, 'dealer and co ' || (id % 400) AS name_key FROM d"),
    "tx16_infer_region": n("SELECT country, state, region_code, count(*) AS n FROM d GROUP BY ALL"),
    "tx19_dealer_rows": n("SELECT id AS dealer_id, dealer_name, city, CAST(id % 180 AS DOUBLE) AS lon, 1.5 AS lat, region_code FROM d"),
    "jn16_match_retailer": n("SELECT id AS dealer_id, coalesce(a.s_suppkey, b.s_suppkey) AS retailer_id FROM d LEFT JOIN supplier a ON a.s_suppkey % 2 = 0 AND d.site = 'd' || a.s_suppkey || '.example.com' LEFT JOIN supplier b ON b.s_suppkey = d.id % 400"),
    "ag15_merge_dealers": n("SELECT dealer_group, dealer_name, city, region_code, manufacturers, sources FROM m"),
    "ag16_dealer_summary": n("""SELECT region_code, manufacturer, dealers, rank FROM (SELECT *, row_number() OVER (PARTITION BY region_code ORDER BY dealers DESC, manufacturer) AS rank FROM (SELECT m.region_code, d.manufacturer, count(DISTINCT m.dealer_group) AS dealers
FROM m JOIN d ON d.g = m.dealer_group GROUP BY ALL)) WHERE rank <= 5"""),
    "pf19_score_dealers": n(f"SELECT dealer_group, status, score FROM ({_PF19})"),
    "ag16_status_counts": n(f"""SELECT r AS region_code, count(dealer_group) AS total_discovered, count(*) FILTER (status = 'Already running') AS already_running, count(*) FILTER (status = 'Candidate') AS candidates,
count(*) FILTER (status IN ('Candidate','Known but disabled','Configured but inactive') AND score >= 4) AS high_priority, count(*) FILTER (status = 'Manual review') AS manual_review
FROM (SELECT unnest({list(_R)}) AS r) LEFT JOIN ({_PF19}) ON region_code = r GROUP BY 1"""),
    "ag16_top_candidates": n(f"""SELECT region_code, dealer_group, status, score, manufacturers, row_number() OVER (PARTITION BY region_code ORDER BY score DESC, manufacturers DESC, dealer_name, dealer_group) AS rank FROM ({_PF19})
WHERE status IN ('Candidate','Known but disabled','Configured but inactive') QUALIFY rank <= 10"""),
    "ag16_manufacturers": n("""SELECT manufacturer, region_code, dealers, sum(dealers) OVER (PARTITION BY manufacturer)::BIGINT AS dealer_count FROM (SELECT d.manufacturer, m.region_code, count(DISTINCT m.dealer_group) AS dealers FROM m JOIN d ON d.g = m.dealer_group GROUP BY ALL)"""),
    "pf20_coverage_candidates": n(f"""SELECT dealer_id, status, CASE WHEN pl = 'ecwid' THEN 'opencart' ELSE pl END AS platform, coalesce(os, nullif(ds, 0), CASE status WHEN 'already_running' THEN least(99, 40 + av // 80) WHEN 'parked_live' THEN 18 WHEN 'parked_manual' THEN 5
ELSE greatest(0, CASE status {" ".join(f"WHEN '{k}' THEN {v}" for k, v in nw.COVERAGE_PRIORITIES.items())} ELSE 0 END - (coalesce(pr, 3) - 1) * 3) END)::INT AS priority_score, dby AS decided_by, coalesce(orun, run)::INT AS already_running FROM (SELECT *, coalesce(o, d0, CASE
WHEN run THEN 'already_running' WHEN dealer_id % 31 = 0 THEN 'shaper_only' WHEN dealer_id % 37 = 0 THEN 'distributor_only' WHEN contains(why, 'domain unavailable') OR contains(why, 'domain for sale') THEN 'closed_or_redirected'
WHEN contains(why, 'no online surfboard inventory') THEN 'no_online_boards' WHEN contains(why, 'distributor') THEN 'distributor_only' WHEN contains(why, 'shaper') THEN 'shaper_only' WHEN contains(why, 'clothing') OR contains(why, 'accessory')
OR contains(why, 'not suitable') OR contains(why, 'does not sell hardboard') OR contains(why, 'not a surfboard retailer') THEN 'unsupported' WHEN gov = 'stock_status_review' THEN 'manual_review' WHEN det = 'blocked' THEN 'blocked'
WHEN fp IN ('shopify','woocommerce','bigcommerce','neto_maropost') THEN 'ready_' || fp WHEN fp IN ('opencart','ecwid') THEN 'ready_opencart' WHEN fp IN ('magento','squarespace') THEN 'ready_custom_high_value'
WHEN det = 'failed' OR gov = 'parser_review' THEN 'manual_review' ELSE 'unsupported' END) AS status, CASE WHEN o IS NOT NULL THEN 'override' WHEN d0 IS NOT NULL THEN 'discovery' ELSE 'default' END AS dby,
lower(coalesce(op, dp, nullif(tp, ''), rp, 'unknown')) AS pl FROM (SELECT *, lower(coalesce(nullif(tp, ''), rp, '')) AS fp FROM (SELECT id AS dealer_id, nullif(id % 6, 0) AS pr, CASE WHEN q < 8 THEN (['blocked','parked_live','parked_manual'])[q % 3 + 1] END AS o, CASE WHEN q < 12 AND q % 2 = 0 THEN 'ecwid' END AS op,
CASE WHEN q = 3 THEN true END AS orun, CASE WHEN q < 12 AND q % 4 = 0 THEN q END AS os, CASE WHEN q >= 10 AND q < 60 AND q % 2 = 0 THEN 'ready_shopify' END AS d0, CASE WHEN q >= 10 AND q < 60 AND q % 3 = 0 THEN 'shopify' END AS dp, CASE WHEN q >= 10 AND q < 60 AND q % 5 <> 0 THEN q % 10 END AS ds,
coalesce(q % 3 <> 0 AND q % 4 = 0, false) AS run, CASE WHEN q % 3 <> 0 THEN lower(({list(_WHY)})[q % 11 + 1]) ELSE '' END AS why, CASE WHEN q % 3 <> 0 THEN (['','stock_status_review','parser_review'])[q % 3 + 1] ELSE '' END AS gov, CASE WHEN q % 3 <> 0 THEN 'magento' END AS rp, CASE WHEN q % 3 <> 0 THEN q * 40 ELSE 0 END AS av,
CASE WHEN q % 5 <> 0 THEN ({list(_PLATFORMS)})[q % 9 + 1] END AS tp, CASE WHEN q % 5 <> 0 THEN (['ok','blocked','failed','ok'])[q % 4 + 1] ELSE '' END AS det FROM (SELECT id, CASE WHEN site IS NOT NULL THEN id % 250 END AS q FROM d))))"""),
    "pf12_activation_status": n("""SELECT id AS dealer_id, CASE WHEN reason = 'supported_retailer' THEN 'active' ELSE 'excluded' END AS status, reason FROM (SELECT id, CASE WHEN country <> 'Australia' THEN 'foreign_country' WHEN id % 11 = 0 THEN 'manufacturer_or_brand' WHEN id % 4 <> 0 AND id % 13 = 0 THEN 'not_hardboard_retailer'
WHEN id % 5 = 0 THEN 'platform_unknown' WHEN id % 5 = 1 THEN 'unsupported_platform_wix' WHEN site IS NULL THEN 'missing_website' ELSE 'supported_retailer' END AS reason FROM d)"""),
    "pf13_build_targets": n(f"SELECT retailer_id, site, excluded FROM ({_TG})"),
    "pf13_target_sites": n(f"SELECT site, min(retailer_id) AS first_retailer, count(DISTINCT country) AS locations, max(platform) AS platform, max(approved) AS approved FROM ({_TG}) WHERE excluded IS NULL GROUP BY site"),
    "pf13_site_locations": n(f"SELECT DISTINCT site, retailer_id, country FROM ({_TG}) WHERE excluded IS NULL"),
    "pf13_merge_targets": n(f"""SELECT * FROM (WITH t AS ({_TG}), g AS (SELECT site, count(DISTINCT country) AS locations, max(platform) AS platform, CAST(regexp_extract(site, 'd([0-9]+)', 1) AS INT) AS q FROM t WHERE excluded IS NULL GROUP BY site),
o AS (SELECT site, q FROM g WHERE q % 3 = 0 UNION ALL SELECT DISTINCT 'gone-' || site, CAST(regexp_extract(site, 'd([0-9]+)', 1) AS INT) FROM t WHERE site IS NOT NULL)
SELECT coalesce(g.site, o.site) AS site, CASE WHEN o.site IS NULL THEN 'new' WHEN g.site IS NOT NULL THEN 'merged' ELSE 'preserved' END AS action, (o.site IS NOT NULL OR g.platform = 'unknown')::INT AS active,
coalesce(g.platform, CASE WHEN o.q % 4 = 0 THEN 'wix' WHEN o.q % 4 <> 3 THEN 'Shopify' END) AS platform, o.q % 7 AS priority, g.locations FROM g FULL JOIN o ON g.site = o.site WHERE g.site IS NOT NULL OR (o.q % 5 <> 0 AND o.q % 4 IN (1, 2)))"""),
    "pf15_score_location": """SELECT *, CASE WHEN signals > 0 AND antisignals = 0 THEN 'likely' WHEN signals > 0 THEN 'mixed' ELSE 'unknown' END AS location_status FROM (SELECT doc_id, contains(p,' the ')::INT + contains(p,' that ')::INT AS signals, contains(p,' de ')::INT + contains(p,'und ')::INT AS antisignals
FROM (SELECT doc_id, ' ' || lower(trim(coalesce(text,''))) || ' ' AS p FROM documents))""",
    "pf16_candidate_names": n("SELECT DISTINCT name FROM nm WHERE name LIKE 'Wave%'"),
    "ag17_group_entities": n("SELECT lower(name) AS entity, count(DISTINCT brand) AS brand_count, count(*) AS mentions FROM nm GROUP BY 1"),
    "pf24_review_entities": n("SELECT DISTINCT name FROM (SELECT CASE WHEN id % 5 = 2 THEN upper(name) ELSE name END AS name FROM nm WHERE id % 5 >= 2) WHERE NOT (name = upper(name) AND length(name) > 12) AND lower(name) <> 'joe 3' QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY name) = 1"),
    "pf24_clean_seed": n("SELECT id AS dealer_id FROM nm WHERE id % 3 = 0 OR lower(name) = 'joe 4'"),
    "pf17_classify_discovery": n("""SELECT dealer_id, CASE WHEN off THEN 'manual_review' WHEN ready THEN 'ready_bigcommerce' WHEN dealer_id % 4 = 0 THEN 'ready_shopify' ELSE 'manual_review' END AS status, CASE WHEN off THEN 'non_au_catalogue_surface' WHEN ready OR dealer_id % 3 <> 1 THEN '' ELSE 'few' END AS reason,
CASE WHEN off THEN 'medium' WHEN ready THEN 'high' WHEN c <> 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN off THEN least(p, 30) WHEN ready THEN greatest(p, 65) ELSE p END AS priority FROM (SELECT id AS dealer_id, id % 9 = 0 AS off, c, p, id % 2 = 0 AND c >= 10 AND id % 5 <> 0 AND id % 13 <> 0 AND id % 4 <> 2 AS ready
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 0 ELSE id % 25 END AS c, CASE WHEN id % 6 = 0 THEN 0 ELSE id % 90 END AS p FROM d))"""),
    "ag25_group_by_site": n("""SELECT DISTINCT site, field, value, min(p) OVER (PARTITION BY site) AS priority FROM (SELECT site, id % 5 AS p, unnest(['city','country','manufacturer']) AS field, unnest([city, country, manufacturer]) AS value FROM d WHERE site IS NOT NULL)"""),
    "ag23_governance": n("""SELECT slug, platform, raw, verified, available, normalised, duplicates, source_rows, active_target, health, CASE WHEN slug IN ('s-5','s-7') THEN 'business_disabled' ELSE st END AS state, CASE slug WHEN 's-5' THEN 'Closed' WHEN 's-7' THEN 'Moved' ELSE CASE st
WHEN 'production' THEN 'Producing available surfboard inventory' WHEN 'stock_status_review' THEN 'Surfboards identified but no available inventory' WHEN 'parser_review' THEN 'Products scraped but surfboard filter did not identify boards' WHEN 'endpoint_review' THEN 'No raw products returned from scrape output' END END AS reason
FROM (SELECT *, CASE WHEN available > 0 AND verified > 0 THEN 'production' WHEN verified > 0 THEN 'stock_status_review' WHEN raw > 0 THEN 'parser_review' ELSE 'endpoint_review' END AS st FROM (SELECT coalesce(h.slug, a.slug) AS slug, coalesce(h.platform, 'wix') AS platform, coalesce(raw, 0) AS raw, coalesce(verified, 0) AS verified,
coalesce(available, 0) AS available, coalesce(normalised, 0) AS normalised, coalesce(duplicates, 0) AS duplicates, coalesce(source_rows, 0) AS source_rows, a.slug IS NOT NULL AS active_target, CASE WHEN h.slug IS NULL THEN 'missing' WHEN available > 0 THEN 'good' WHEN x < 4 THEN (['failed','poor','warning','fair'])[x + 1] ELSE 'unknown' END AS health
FROM (SELECT 's-' || s AS slug, any_value(s % 6) AS x, string_agg(DISTINCT p, ', ' ORDER BY p) AS platform, coalesce(sum(id % 7) FILTER (s % 5 <> 0), 0) AS raw, coalesce(sum(id % 5) FILTER (s % 5 <> 0 AND s % 3 <> 0), 0) AS verified, coalesce(sum(id % 3) FILTER (s % 3 = 1 AND s % 2 = 0), 0) AS available,
coalesce(sum(id % 4) FILTER (s % 2 = 0), 0) AS normalised, coalesce(sum(id % 6) FILTER (id % 2 = 0), 0) AS duplicates, count(*) AS source_rows FROM (SELECT id, id % 333 AS s, CASE id % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'wix' ELSE 'unknown' END AS p FROM d) GROUP BY s) h
FULL JOIN (SELECT DISTINCT 's-' || (id % 500) AS slug FROM d WHERE id % 3 <> 0) a ON h.slug = a.slug))"""),
    "tx20_expand_categories": "WITH RECURSIVE t AS (SELECT p_partkey AS category_id FROM part WHERE p_partkey IN (5, 11) UNION SELECT p.p_partkey FROM part p JOIN t ON p.p_partkey // 3 = t.category_id) SELECT category_id FROM t",
}
