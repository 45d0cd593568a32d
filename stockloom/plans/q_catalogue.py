"""Catalogue, audit and direct-linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import catalogue as cg
from stockloom.operators import linkage as L
from stockloom.operators import listings as ls
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.plans.q_linkage import key, linker
from stockloom.plans.q_listings import _REASONS, _REG, _regional


def pf1b(spark, sf):
    return cg.list_brands(fx.models(spark, sf))


def pf1m(spark, sf):
    return cg.list_models(fx.models(spark, sf), "Maker 2")


def pf1c(spark, sf):
    return cg.list_constructions(fx.sizes(spark, sf), 4)


def pf2(spark, sf):
    return cg.list_sizes(fx.sizes(spark, sf)).select("model_id", "construction", "size_id", "label")


def jn1(spark, sf):
    return cg.official_sizes(fx.sizes(spark, sf), fx.models(spark, sf), fx.brands(spark, sf)).select("size_id", "model_name", "brand_name", "length")


def _flat(spark, sf):
    k = F.col("size_id")
    return fx.parts(spark, sf).select(k, F.concat("brand_name", F.lit(" "), "model_name").alias("model_name"), F.when(k % 3 == 0, F.col("construction")).otherwise("").alias("board_category"),
                                      F.when(k % 5 == 0, F.concat(F.lit("text "), k)).alias("description"), (k % 97 != 0).alias("is_active"))


def ag12(spark, sf):
    return cg.build_models(_flat(spark, sf), ["board_category", "description"], "size_id").select("model_name", "board_category", "description", F.col("is_active").cast("int").alias("is_active"))


def _incoming(spark, sf):
    return fx.models(spark, sf).filter(F.col("model_id") % 7 != 3)


def _after_drop(spark, sf):
    """Two brands lose their red models; the others keep them."""
    return fx.models(spark, sf).filter(~(F.col("model_name").startswith("red ") & F.col("brand_id").isin(0, 1)))


def st3(spark, sf):
    return cg.missing_models(fx.models(spark, sf), _after_drop(spark, sf))


def st3g(spark, sf):
    return cg.missing_guard(fx.models(spark, sf), _after_drop(spark, sf)).select("brand_name", "existing", "missing", F.col("blocked").cast("int").alias("blocked"))


def st2(spark, sf):
    z = fx.sizes(spark, sf).withColumn("tail_shape", F.lit(None).cast("string"))
    inc = z.unionByName(z.withColumn("size_id", F.col("size_id") + 1000000)).withColumn("volume", F.when(F.col("size_id") % 1000000 % 4 == 0, F.col("volume") + 1).otherwise(F.col("volume")).cast("decimal(10,2)"))
    return cg.new_sizes(z, inc, "size_id").select("size_id", F.col("volume").cast("double").alias("volume"))


def st5(spark, sf):
    r = fx.retailers(spark, sf)
    c = fx.table(spark, sf, "customer").select(F.concat(F.lit("SUPPLIER "), F.lpad((F.col("c_custkey") % 300).cast("string"), 9, "0")).alias("name"))
    return cg.merge_entities(r.select(F.col("retailer_name").alias("name")), c).select(F.upper(F.regexp_replace("name", "[#]", " ")).alias("name"))


def tx21(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in (" Squash", " - Round Pin", "", " swallow")]), (F.col("model_id") % 4 + 1).cast("int"))
    m = fx.models(spark, sf).withColumn("model_name", F.concat("model_name", t))
    return cg.split_tail(m, ["squash", "round pin", "swallow"]).select("model_id", "model_name", F.lower("tail_shape").alias("tail_shape"))


def ag26(spark, sf):
    p = fx.parts(spark, sf).withColumn("slug", F.replace("model_name", F.lit(" "), F.lit("-")))
    st = F.struct("length", "construction")
    n = p.groupBy("slug", "brand_id").agg(F.min("size_id").alias("ord"), F.collect_list(st).alias("sizes"), F.collect_set("construction").alias("constructions"))
    return cg.clean_nested(n, {"economy": "eco", "small": "eco"}, "pu", "ord").select("slug", "ord", F.size("sizes").alias("sizes"), "removed", F.array_join("constructions", "|").alias("constructions"))


def _sources(spark, sf):
    m = fx.models(spark, sf)
    src = m.select("brand_name", F.when(F.col("model_id") % 5 == 1, F.concat("model_name", F.lit(" xl"))).otherwise(F.col("model_name")).alias("model_name"), "model_id")
    al = src.filter(F.col("model_id") % 10 == 1).select("brand_name", F.col("model_name").alias("source_key"), F.regexp_replace("model_name", " xl$", "").alias("canonical_key"))
    return src, m.filter(F.col("model_id") % 9 != 2), al


def st4(spark, sf):
    return cg.catalogue_diff(*_sources(spark, sf))


def ag11(spark, sf):
    src, can, al = _sources(spark, sf)
    m = can.withColumn("description", F.when(F.col("model_id") % 3 == 0, "x")).withColumn("url", F.when(F.col("model_id") % 2 == 0, "u"))
    m = m.unionByName(m.filter(F.col("model_id") % 11 == 0).withColumn("model_id", F.col("model_id") + 1000000).withColumn("model_name", F.upper("model_name")))
    h = cg.catalogue_health(m, fx.sizes(spark, sf), cg.catalogue_diff(src, can, al), ["description", "url"])
    return h.select("brand_name", "models", "sizes", "models_without_sizes", "duplicate_keys", "constructions", "missing_models", "retired_models", "alias_models", "description_pct", "url_pct", F.array_join("indicators", ",").alias("indicators"))


def ag19(spark, sf):
    return cg.coverage_counts(fx.inventory(spark, sf))


def _named_direct(spark, sf):
    k = F.col("true_size_id")
    n = F.when(k % 11 == 0, F.concat("model_name", F.lit(" blue"))).when(k % 11 == 1, F.concat("model_name", F.lit(" turbo"))).when(k % 11 == 2, F.concat("model_name", F.lit(" eps"))).otherwise(F.col("model_name"))
    return fx.direct(spark, sf).withColumn("model_name", n)


def lk22(spark, sf):
    return cg.parity_audit(_named_direct(spark, sf), fx.models(spark, sf).filter(F.col("model_id") % 6 != 0))


def _diagnosed(spark, sf):
    return cg.link_diagnostics(_named_direct(spark, sf), fx.models(spark, sf).filter(F.col("model_id") % 6 != 0))


def lk27(spark, sf):
    return _diagnosed(spark, sf).select("direct_id", "blocker")


def lk27t(spark, sf):
    return cg.top_blockers(_diagnosed(spark, sf))


def _projected(spark, sf, sup=None):
    return L.project_links(fx.inventory(spark, sf), fx.aliases(spark, sf), fx.BRANDS, fx.models(spark, sf), fx.sizes(spark, sf), sup, columns=())


def lk21(spark, sf):
    d = L.with_hint(L.resolve_brand(fx.inventory(spark, sf), fx.aliases(spark, sf)), fx.BRANDS)
    return cg.gap_ranking(cg.gap_analysis(d, fx.models(spark, sf), fx.sizes(spark, sf)))


def lk26(spark, sf):
    rows = [("Maker 0", "0.15", "decimal", "missing_ok", "id"), ("Maker 1", "0.35", "text", "missing_ok", "id"), ("Maker 2", "0.75", "quote", "missing_ok", "nearest"), ("Maker 3", "1.0", "none", "missing_ok", "nearest"), ("Maker 4", "0.15", "none", "any", "unique")]
    policy = spark.createDataFrame(rows, "brand_name string, volume_tol string, dims_mode string, construction_mode string, pick string").withColumn("volume_tol", F.col("volume_tol").cast("decimal(12,4)"))
    return cg.link_direct(fx.direct(spark, sf), fx.sizes(spark, sf), policy)


def lk29(spark, sf):
    z = fx.sizes(spark, sf)
    rows = z.select(F.col("size_id").alias("row_id"), F.col("model_id").alias("product_id"), "length", "width", "thickness", "volume")
    v = z.select(F.col("model_id").alias("product_id"), F.col("size_id").alias("variant_id"), F.when(
        F.col("size_id") % 2 == 0, F.concat("length", F.lit(' x '), "width", F.lit('" x '), "thickness", F.lit('" '), F.col("volume").cast("string"), F.lit("L"))).otherwise(F.concat("length", F.lit(" board"))).alias("variant_text"))
    return cg.match_variants(rows, v)


def lk30(spark, sf):
    s = fx.inventory(spark, sf).select("inventory_id", F.col("true_model_id").alias("model_id"), "length", "width", "thickness", "volume")
    return cg.stock_dimension_pairs(s, fx.sizes(spark, sf)).groupBy("inventory_id").agg(F.count("*").alias("n"), F.min("dim_id").alias("first_dim"))


def lk30p(spark, sf):
    d = fx.direct(spark, sf).select("direct_id", "model_name", "length", "width", "thickness", "construction", F.col("true_size_id").alias("k"))
    return cg.prefer_stock(d.filter("k % 4 = 0"), d.filter("k % 4 <> 0"), ["model_name", "length", "width", "thickness", "construction"]).select("direct_id")


def jn13(spark, sf):
    return cg.match_catalogue(fx.inventory(spark, sf), fx.sizes(spark, sf))


def jn13u(spark, sf):
    i = fx.inventory(spark, sf)
    m = cg.match_catalogue(i, fx.sizes(spark, sf))
    return i.join(m, "inventory_id", "left_anti").select("inventory_id")


def jn15(spark, sf):
    return cg.multi_size_models(fx.inventory(spark, sf).filter("is_active")).select("inventory_id")


def jn18(spark, sf):
    d, k = fx.direct(spark, sf), F.col("true_size_id")
    ids = d.withColumn("product_id", F.when(k % 2 == 0, F.concat(F.lit("p"), k))).withColumn("variant_id", F.when(k % 2 == 0, F.col("region_code"))).withColumn("product_url", F.concat("product_url", "region_code"))
    cur = ids.filter(k % 10 != 9).withColumn("model_id", F.when(k % 4 == 0, F.col("model_id"))).withColumn("size_id", F.when(k % 4 == 0, F.col("size_id")))
    return cg.link_audit(ids, cur)


def _projection(spark, sf):
    i = fx.inventory(spark, sf).withColumn("retailer_slug", F.concat(F.lit("shop_"), F.col("retailer_id") % 5)).withColumn("model_name", F.col("normalised_title"))
    rules = spark.createDataFrame([("shop_1", "maker 0", "House A"), ("shop_2", "maker 3", "House B")], "retailer_slug string, brand_key string, house_brand string")
    titles = [("shop_1", [(r"^\d{1,2}'\d{1,2}\"?\s*", ""), (r"(?i)\bused\b", "")]), ("shop_3", [(r"(?i)\bSurfboards\b", ""), (r"\s+", " ")])]
    return cg.project_brand_model(i, rules, titles)


def lk25(spark, sf):
    return _projection(spark, sf).select("inventory_id", "projected_brand", "projected_model", F.array_join("fixes", ",").alias("fixes"))


def lk24(spark, sf):
    p = _projected(spark, sf).select("inventory_id", "new_model_id", "new_size_id", "effective_brand")
    r = ls.excluded_product_type(ls.reject_reasons(_regional(spark, sf), "EUROPE", "EUR"), ["title"])
    j = r.join(p, "inventory_id").select(
        F.coalesce("retailer_name", F.lit("<missing>")).alias("retailer_name"), (F.col("true_model_id") % 50 == 1).alias("duplicate"), (F.size("reject_reasons") > 0).alias("rejected"),
        F.col("excluded_type").isNotNull().alias("excluded"), F.coalesce(F.col("effective_brand").isin(*fx.SUPPORTED), F.lit(False)).alias("eligible"), "new_model_id", "new_size_id")
    return cg.quality_report(j)


QUERIES = {
    "pf1_list_brands": pf1b, "pf1_list_models": pf1m, "pf1_list_constructions": pf1c, "pf2_list_sizes": pf2, "jn1_official_sizes": jn1, "ag12_build_models": ag12, "st3_missing_models": st3,
    "st3_missing_guard": st3g, "st2_new_sizes": st2, "st5_merge_entities": st5, "tx21_split_tail": tx21, "ag26_clean_nested": ag26, "st4_catalogue_diff": st4, "ag11_catalogue_health": ag11,
    "ag19_coverage_counts": ag19, "lk22_parity_audit": lk22, "lk27_link_diagnostics": lk27, "lk27_top_blockers": lk27t, "lk21_gap_analysis": lk21, "lk26_link_direct": lk26, "lk29_match_variants": lk29,
    "lk30_stock_dimension_pairs": lk30, "lk30_prefer_stock": lk30p, "jn13_match_catalogue": jn13, "jn13_unmatched": jn13u, "jn15_multi_size_models": jn15, "jn18_link_audit": jn18,
    "lk25_project_brand_model": lk25, "lk24_quality_report": lk24,
}

_SRC = "SELECT brand_name, CASE WHEN model_id % 5 = 1 THEN model_name || ' xl' ELSE model_name END AS m, model_id FROM models"
_CAN = "SELECT * FROM models WHERE model_id % 9 <> 2"
_ALI = "SELECT brand_name, m AS s, replace(m, ' xl', '') AS c FROM src WHERE model_id % 10 = 1"
_DIFF = """SELECT brand_name, 'missing' AS kind, m AS model_key FROM (SELECT DISTINCT brand_name, m FROM src) x WHERE (brand_name, m) NOT IN (SELECT (brand_name, model_name) FROM can)
AND (brand_name, m) NOT IN (SELECT (a.brand_name, a.s) FROM ali a JOIN can USING (brand_name) WHERE can.model_name = a.c)
UNION ALL SELECT brand_name, 'retired', model_name FROM can WHERE (brand_name, model_name) NOT IN (SELECT (brand_name, m) FROM src)
UNION ALL SELECT a.brand_name, 'alias', a.s FROM ali a JOIN can ON can.brand_name = a.brand_name AND can.model_name = a.c"""
_ND = """SELECT * REPLACE (CASE true_size_id % 11 WHEN 0 THEN model_name || ' blue' WHEN 1 THEN model_name || ' turbo' WHEN 2 THEN model_name || ' eps' ELSE model_name END AS model_name), true_size_id % 11 AS sfx, model_name AS base FROM direct"""
_PAR = """SELECT n.brand_name, n.model_name, n.rows, CASE WHEN m.model_name IS NOT NULL THEN m.model_name END AS canonical, CASE WHEN m.model_name = n.model_name THEN 'exact' WHEN m.model_name IS NOT NULL THEN 'alias'
WHEN n.model_name LIKE '% eps' THEN 'parsing_error' WHEN regexp_matches(n.model_name, '\\b(white|black|blue|red|green|clear|sand|grey|gray)\\b') THEN 'parsing_error' ELSE 'new_model' END AS class
FROM (SELECT brand_name, model_name, count(*) AS rows FROM nd GROUP BY ALL) n LEFT JOIN (SELECT * FROM models WHERE model_id % 6 <> 0) m ON m.brand_name = n.brand_name AND m.model_name = regexp_replace(n.model_name, ' blue$', '')"""
_L29 = """SELECT r.size_id AS row_id, v.size_id AS vid, v.size_id % 2 = 0 AND contains(txt, r.length) AND contains(txt, replace(r.width,' ','')) AND contains(txt, replace(r.thickness,' ',''))
AND (contains(txt, regexp_replace(regexp_replace(CAST(r.volume AS VARCHAR), '0+$', ''), '[.]$', '') || 'l') OR contains(txt, CAST(CAST(r.volume AS DECIMAL(10,1)) AS VARCHAR) || 'l') OR contains(txt, r.volume || 'l')) AS f,
contains(txt, r.length) AS bl FROM sizes r JOIN (SELECT *, CASE WHEN size_id % 2 = 0 THEN length || 'x' || replace(width,' ','') || 'x' || replace(thickness,' ','') || volume || 'l' ELSE length || 'board' END AS txt FROM sizes) v ON r.model_id = v.model_id"""
_AUD = """SELECT d.brand_name, CASE WHEN k % 10 = 9 THEN 0 ELSE 1 END AS fnd, CASE WHEN k % 4 = 0 THEN model_id END AS m0, CASE WHEN k % 4 = 0 THEN size_id END AS s0, model_id AS m1, size_id AS s1, length FROM (SELECT *, true_size_id AS k FROM direct) d"""

_BLOCK = """SELECT d.direct_id, d.region_code, brand_name, CASE WHEN m.model_name IS NOT NULL THEN NULL WHEN EXISTS (SELECT 1 FROM nd e WHERE e.brand_name = d.brand_name AND e.model_name = d.model_name AND e.region_code <> d.region_code) THEN 'other_region_model_not_in_canonical_catalogue'
ELSE 'model_not_in_canonical_catalogue' END AS blocker FROM nd d LEFT JOIN (SELECT brand_name, model_name FROM models WHERE model_id % 6 <> 0) m USING (brand_name, model_name)"""
ORACLE = {
    "pf1_list_brands": sql("brands", "SELECT * FROM brands"),
    "pf1_list_models": sql("models", "SELECT model_id, model_name FROM models WHERE brand_name = 'Maker 2'"),
    "pf1_list_constructions": sql("sizes", "SELECT DISTINCT construction FROM sizes WHERE model_id = 4"),
    "pf2_list_sizes": sql("sizes", """SELECT model_id, construction, min(size_id) AS size_id, length || ' x ' || width || ' x ' || thickness || ' | ' || regexp_replace(regexp_replace(CAST(volume AS VARCHAR), '0+$', ''), '[.]$', '') || 'L' AS label
FROM sizes GROUP BY model_id, construction, length, width, thickness, volume"""),
    "jn1_official_sizes": sql("sizes", "SELECT size_id, model_name, brand_name, length FROM sizes"),
    "ag12_build_models": sql("parts", """SELECT brand_name || ' ' || model_name AS model_name, arg_min(construction, size_id) FILTER (size_id % 3 = 0) AS board_category, arg_min('text ' || size_id, size_id) FILTER (size_id % 5 = 0) AS description,
bool_and(size_id % 97 <> 0)::INT AS is_active FROM parts GROUP BY 1"""),
    "st3_missing_models": sql("models", "SELECT DISTINCT brand_name, model_name FROM models WHERE model_name LIKE 'red %' AND brand_id IN (0, 1)"),
    "st3_missing_guard": sql("models", "SELECT brand_name, existing, missing, (missing > 5 OR (existing >= 10 AND missing > existing * 0.2))::INT AS blocked FROM (SELECT brand_name, count(DISTINCT model_name) AS existing, count(DISTINCT model_name) FILTER (model_name LIKE 'red %' AND brand_id IN (0, 1)) AS missing FROM models GROUP BY 1)"),
    "st2_new_sizes": sql("sizes", """SELECT size_id, CAST(volume + 1 AS DOUBLE) AS volume FROM sizes z WHERE size_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM sizes y WHERE y.model_id = z.model_id AND y.length = z.length AND y.width = z.width AND y.thickness = z.thickness
AND y.volume = z.volume + 1 AND y.construction = z.construction AND y.fin_setup = z.fin_setup) QUALIFY row_number() OVER (PARTITION BY model_id, length, width, thickness, volume, construction, fin_setup ORDER BY size_id) = 1"""),
    "st5_merge_entities": """SELECT upper(replace(s_name, '#', ' ')) AS name FROM supplier UNION SELECT 'SUPPLIER ' || lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0') FROM customer""",
    "tx21_split_tail": sql("models", "SELECT model_id, model_name, (['squash','round pin','','swallow'])[model_id % 4 + 1] AS tail_shape FROM models"),
    "ag26_clean_nested": sql("parts", """SELECT slug, ord, u AS sizes, n - u AS removed, cs AS constructions FROM (SELECT replace(model_name,' ','-') AS slug, min(size_id) AS ord, count(*) AS n, count(DISTINCT (length, construction)) AS u,
string_agg(DISTINCT CASE WHEN construction IN ('ECONOMY','SMALL') THEN 'eco' ELSE lower(construction) END, '|' ORDER BY CASE WHEN construction IN ('ECONOMY','SMALL') THEN 'eco' ELSE lower(construction) END) AS cs FROM parts GROUP BY model_name, brand_id)
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ord) = 1"""),
    "st4_catalogue_diff": sql("models", "SELECT * FROM diff", src=_SRC, can=_CAN, ali=_ALI, diff=_DIFF),
    "ag11_catalogue_health": sql("models sizes", """SELECT brand_name, models, sizes, models_without_sizes, duplicate_keys, constructions, missing_models, retired_models, alias_models, description_pct, url_pct,
array_to_string(list_filter([CASE WHEN models_without_sizes > 0 THEN 'models_without_sizes:' || models_without_sizes END, CASE WHEN duplicate_keys > 0 THEN 'duplicate_normalized_model_names:' || duplicate_keys END,
CASE WHEN missing_models > 0 THEN 'official_models_missing:' || missing_models END], lambda x: x IS NOT NULL), ',') AS indicators FROM (SELECT m.brand_name, count(*) + count(*) FILTER (model_id % 11 = 0) AS models,
sum((SELECT count(*) FROM sizes z WHERE z.model_id = m.model_id))::BIGINT AS sizes, count(*) FILTER (model_id % 11 = 0) AS models_without_sizes, count(*) FILTER (model_id % 11 = 0) AS duplicate_keys,
(SELECT count(DISTINCT construction) FROM sizes z JOIN can c USING (model_id) WHERE c.brand_name = m.brand_name) AS constructions,
(SELECT count(*) FROM diff d WHERE d.brand_name = m.brand_name AND kind='missing') AS missing_models, (SELECT count(*) FROM diff d WHERE d.brand_name = m.brand_name AND kind='retired') AS retired_models,
(SELECT count(*) FROM diff d WHERE d.brand_name = m.brand_name AND kind='alias') AS alias_models,
round((count(*) FILTER (model_id % 3 = 0) + count(*) FILTER (model_id % 33 = 0))*100.0/(count(*) + count(*) FILTER (model_id % 11 = 0)), 2) AS description_pct,
round((count(*) FILTER (model_id % 2 = 0) + count(*) FILTER (model_id % 22 = 0))*100.0/(count(*) + count(*) FILTER (model_id % 11 = 0)), 2) AS url_pct FROM can m GROUP BY 1)""", src=_SRC, can=_CAN, ali=_ALI, diff=_DIFF),
    "ag19_coverage_counts": sql("inventory", "SELECT brand_name, region_code, count(*) AS rows FROM inventory GROUP BY ALL"),
    "lk22_parity_audit": sql("direct models", """SELECT brand_name, model_name, rows, canonical, CASE WHEN class <> 'exact' AND count(*) OVER (PARTITION BY brand_name, coalesce(canonical, model_name)) > 1 THEN 'duplicate' ELSE class END AS class FROM par""", nd=_ND, par=_PAR),
    "lk27_link_diagnostics": sql("direct models", f"SELECT direct_id, blocker FROM ({_BLOCK})", nd=_ND),
    "lk27_top_blockers": sql("direct models", f"SELECT *, row_number() OVER (PARTITION BY region_code, brand_name ORDER BY rows DESC, blocker) AS rank FROM (SELECT region_code, brand_name, blocker, count(*) AS rows FROM ({_BLOCK}) WHERE blocker IS NOT NULL GROUP BY ALL)", nd=_ND),
    "lk21_gap_analysis": linker("""SELECT kind, brand_name, gap, count(*) AS rows FROM (SELECT bn AS brand_name, 'model' AS kind, CASE WHEN model_id IS NOT NULL THEN NULL WHEN old_brand_id IS NULL AND parsed_brand_id IS NOT NULL THEN 'alias_failure'
WHEN coalesce(old_brand_id, parsed_brand_id) IS NULL THEN 'unknown_brand_or_alias_failure' WHEN mm THEN 'exact_catalogue_model_not_linked'
WHEN regexp_matches(hint, '\\b[4-9]\\s*[''’]\\s*[0-9]') THEN 'parsing_failure:length_left_in_model' WHEN regexp_matches(hk, '\\b(white|black|blue|red|orange|pink|sand|grey|gray)\\b') THEN 'parsing_failure:colour_left_in_model'
WHEN regexp_matches(hk, '\\bby\\s+[a-z]') THEN 'parsing_failure:shaper_suffix_left_in_model' ELSE 'genuine_new_model_absent_from_catalogue' END AS gap FROM gap0
UNION ALL SELECT bn, 'size', CASE WHEN size_id IS NOT NULL THEN NULL WHEN model_id IS NULL THEN 'blocked_by_missing_model' WHEN length IS NULL THEN 'parsing_failure:missing_length' WHEN n = 0 THEN 'genuine_new_size_absent_from_catalogue'
WHEN volume IS NULL AND n = 1 THEN 'unique_existing_size_not_linked' WHEN volume IS NULL THEN 'ambiguous_existing_sizes_missing_volume' WHEN d <= 0.20 THEN 'existing_size_within_tolerance_not_linked' ELSE 'genuine_new_size_volume_absent_from_catalogue' END FROM gap0)
WHERE gap IS NOT NULL GROUP BY ALL ORDER BY rows DESC, kind, brand_name NULLS FIRST, gap LIMIT 250""").replace("\nSELECT kind, brand_name", f""", zz AS (SELECT h.inventory_id, count(z.size_id) AS n, min(abs(h.volume - z.volume)) AS d FROM hinted h LEFT JOIN sizes z ON h.model_id = z.model_id AND h.length = z.length GROUP BY 1),
gap0 AS (SELECT h.*, coalesce(h.brand_name, h.parsed_brand) AS bn, zz.n, zz.d, {key('hint')} AS hk, EXISTS (SELECT 1 FROM models m WHERE m.brand_id = coalesce(h.old_brand_id, h.parsed_brand_id) AND m.model_name = {key('hint')}) AS mm
FROM hinted h JOIN zz USING (inventory_id) WHERE h.model_id IS NULL OR h.size_id IS NULL)\nSELECT kind, brand_name""", 1),
    "lk26_link_direct": sql("direct sizes", """SELECT direct_id, sid AS linked_size_id, n AS candidates FROM (SELECT direct_id, z.size_id AS sid, d.brand_name, coalesce(d.construction = z.construction, false) AS ex, count(*) OVER w AS n, count(*) FILTER (d.construction = z.construction) OVER w AS k,
row_number() OVER (PARTITION BY direct_id ORDER BY coalesce(d.construction = z.construction, false) DESC, CASE WHEN d.brand_name IN ('Maker 2','Maker 3') THEN abs(d.volume - z.volume) ELSE 0 END, z.size_id) AS rn
FROM direct d JOIN sizes z ON d.model_id = z.model_id AND d.length = z.length AND abs(d.volume - z.volume) <= CASE d.brand_name WHEN 'Maker 0' THEN 0.15 WHEN 'Maker 1' THEN 0.35 WHEN 'Maker 2' THEN 0.75 WHEN 'Maker 3' THEN 1.0 ELSE 0.15 END
AND (d.brand_name IN ('Maker 3','Maker 4') OR (d.width = z.width AND d.thickness = z.thickness)) AND (d.brand_name = 'Maker 4' OR d.construction IS NULL OR d.construction = z.construction) WINDOW w AS (PARTITION BY direct_id))
WHERE rn = 1 AND (brand_name <> 'Maker 4' OR k > 0 OR n = 1)"""),
    "lk29_match_variants": sql("sizes", """SELECT row_id, coalesce(f, l) AS variant_id, CASE WHEN f IS NOT NULL THEN 'dimensions' ELSE 'only_length' END AS how FROM (SELECT row_id, min(vid) FILTER (f) AS f, CASE WHEN count(*) FILTER (bl) = 1 THEN min(vid) FILTER (bl) END AS l FROM j GROUP BY 1)
WHERE coalesce(f, l) IS NOT NULL""", j=_L29),
    "lk30_stock_dimension_pairs": sql("inventory sizes", """SELECT inventory_id, count(*) AS n, min(z.size_id) AS first_dim FROM inventory i JOIN sizes z ON i.true_model_id = z.model_id AND (i.length IS NULL OR i.length = z.length) AND (i.width IS NULL OR i.width = z.width)
AND (i.thickness IS NULL OR i.thickness = z.thickness) AND (i.volume IS NULL OR abs(i.volume - z.volume) <= 0.15) GROUP BY 1"""),
    "lk30_prefer_stock": sql("direct", """SELECT direct_id FROM direct d WHERE true_size_id % 4 = 0 OR NOT EXISTS (SELECT 1 FROM direct s WHERE s.true_size_id % 4 = 0 AND s.model_name = d.model_name AND coalesce(s.length,'') = coalesce(d.length,'')
AND s.width = d.width AND s.thickness = d.thickness AND coalesce(s.construction,'') = coalesce(d.construction,''))"""),
    "jn13_match_catalogue": sql("inventory sizes", "SELECT inventory_id, record_id, score FROM jm", jm="{JM}"),
    "jn13_unmatched": sql("inventory sizes", "SELECT inventory_id FROM inventory WHERE inventory_id NOT IN (SELECT inventory_id FROM jm)", jm="{JM}"),
    "jn15_multi_size_models": sql("inventory", "SELECT inventory_id FROM inventory WHERE is_active AND model_id IN (SELECT model_id FROM inventory WHERE is_active AND size_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT size_id) >= 2)"),
    "jn18_link_audit": sql("direct", """SELECT brand_name, count(*) FILTER (fnd=0) AS not_found, count(m0) FILTER (fnd=1) AS model_before, count(coalesce(m0,m1)) FILTER (fnd=1) AS model_after, count(s0) FILTER (fnd=1) AS size_before, count(coalesce(s0,s1)) FILTER (fnd=1) AS size_after,
count(*) FILTER (fnd=1 AND coalesce(s0,s1) IS NULL AND coalesce(m0,m1) IS NULL) AS blocked_by_model, count(*) FILTER (fnd=1 AND coalesce(s0,s1) IS NULL AND coalesce(m0,m1) IS NOT NULL AND length IS NULL) AS missing_length,
count(*) FILTER (fnd=1 AND coalesce(s0,s1) IS NULL AND coalesce(m0,m1) IS NOT NULL AND length IS NOT NULL) AS ambiguous_or_absent FROM a GROUP BY 1""", a=_AUD),
    "lk25_project_brand_model": sql("inventory", """SELECT inventory_id, coalesce(hb, coalesce(brand_name,'')) AS projected_brand, coalesce(pm, mn) AS projected_model,
array_to_string(list_filter([CASE WHEN hb IS NOT NULL THEN 'brand_parsing_issue' END, CASE WHEN pm IS NOT NULL AND pm <> mn THEN 'model_parsing_issue' END], lambda x: x IS NOT NULL), ',') AS fixes FROM (SELECT *, coalesce(normalised_title,'') AS mn,
CASE WHEN retailer_id % 5 = 1 AND brand_name = 'Maker 0' THEN 'House A' WHEN retailer_id % 5 = 2 AND brand_name = 'Maker 3' THEN 'House B' END AS hb,
nullif(trim(CASE retailer_id % 5 WHEN 1 THEN regexp_replace(regexp_replace(trim(title), '^[0-9]{1,2}''[0-9]{1,2}"?\\s*', ''), '(?i)\\bused\\b', '') WHEN 3 THEN regexp_replace(regexp_replace(trim(title), '(?i)\\bSurfboards\\b', ''), '\\s+', ' ', 'g') END, ' -#"'), '') AS pm FROM inventory)"""),
    "lk24_quality_report": linker(" UNION ALL ".join(f"""SELECT '{lv}' AS level, {rn} AS retailer_name, count(*) AS source_rows, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup AND rej) AS rejected_rows, count(*) FILTER (imp) AS importable, count(*) FILTER (kept) AS post_exclusion,
count(*) FILTER (el) AS eligible_rows, count(nm) FILTER (el) AS model_linked, count(ns) FILTER (el AND nm IS NOT NULL) AS size_linked, CASE WHEN count(*) FILTER (imp) > 0 THEN round(count(nm) FILTER (el)*100.0/count(*) FILTER (imp),2) ELSE 0 END AS model_pct_importable,
CASE WHEN count(*) FILTER (el) > 0 THEN round(count(nm) FILTER (el)*100.0/count(*) FILTER (el),2) ELSE 0 END AS model_pct_eligible, CASE WHEN count(*) FILTER (el) > 0 THEN round(count(ns) FILTER (el AND nm IS NOT NULL)*100.0/count(*) FILTER (el),2) ELSE 0 END AS size_pct_eligible FROM q0 {by}"""
        for lv, rn, by in (("total", "CAST(NULL AS VARCHAR)", ""), ("retailer", "rn", "GROUP BY rn")))).replace("\nSELECT 'total'", f""", reg AS ({_REG}), q0 AS (SELECT *, NOT dup AND NOT rej AS imp, NOT dup AND NOT rej AND NOT exc AS kept, NOT dup AND NOT rej AND NOT exc AND elig AS el FROM (
SELECT coalesce(rname,'<missing>') AS rn, r.true_model_id % 50 = 1 AS dup, {_REASONS.replace('length IS NULL','r.length IS NULL').replace('volume IS NULL','r.volume IS NULL').replace("region_code","r.region_code").replace("product_url","r.product_url").replace("stock_status","r.stock_status")} <> '' AS rej,
r.title LIKE '% used %' AS exc, coalesce(p.effective_brand IN ('Maker 0','Maker 1','Maker 2'), false) AS elig, p.new_model_id AS nm, p.new_size_id AS ns FROM reg r JOIN projected p USING (inventory_id)))\nSELECT 'total'""", 1),
}
_JM = f"""SELECT inventory_id, size_id AS record_id, score FROM (SELECT i.inventory_id, z.size_id, 45 + CASE WHEN i.length = z.length THEN 20 ELSE 0 END + CASE WHEN abs(i.volume - z.volume) <= 0.15 THEN 20 ELSE 0 END
+ CASE WHEN i.construction = z.construction THEN 10 ELSE 0 END + CASE WHEN i.fin_setup = z.fin_setup THEN 5 ELSE 0 END AS score FROM (SELECT *, ' '||{key('title')}||' ' AS tk FROM inventory) i JOIN (SELECT DISTINCT model_name FROM sizes) m ON contains(i.tk, ' '||m.model_name||' ') JOIN sizes z ON z.model_name = m.model_name) WHERE score >= 65
QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY score DESC, size_id) = 1"""
for _k in ("jn13_match_catalogue", "jn13_unmatched"):
    ORACLE[_k] = ORACLE[_k].replace("{JM}", _JM)
