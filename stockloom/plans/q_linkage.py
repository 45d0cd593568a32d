"""Record-linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.operators import linkage as L
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql



def _named(spark, sf):
    return L.resolve_brand(fx.inventory(spark, sf), fx.aliases(spark, sf))


def _projected(spark, sf, supported=None, ambiguous=False, columns=()):
    return L.project_links(fx.inventory(spark, sf), fx.aliases(spark, sf), fx.BRANDS, fx.models(spark, sf), fx.sizes(spark, sf), supported, ambiguous, columns=columns)


def _hinted(spark, sf):
    d = L.with_hint(_named(spark, sf), fx.BRANDS)
    return d.withColumn("brand_id", F.coalesce("brand_id", "parsed_brand_id"))


def jn14(spark, sf):
    return _named(spark, sf).select("inventory_id", "parsed_brand_id", "parsed_brand")


def jn11(spark, sf):
    return L.model_candidates(_hinted(spark, sf), fx.models(spark, sf)).select("inventory_id", "model_id", "score")


def lk4(spark, sf):
    c = L.model_candidates(_hinted(spark, sf), fx.models(spark, sf))
    return c.groupBy("score", "is_generic").agg(F.count("*").alias("pairs")).select("score", "pairs")


def lk5(spark, sf):
    s = L.select_model(L.model_candidates(_hinted(spark, sf), fx.models(spark, sf)))
    return s.select("inventory_id", "linked_model_id", "linked_model", "score", "candidate_count", "ambiguous_count",
                    F.array_join("top_models", "|").alias("top_models"))


def _true_model(spark, sf):
    return fx.inventory(spark, sf).withColumn("model_id", F.col("true_model_id"))


def jn12(spark, sf):
    return L.size_candidates(_true_model(spark, sf), fx.sizes(spark, sf)).select(
        "inventory_id", F.col("_sid").alias("size_id"), F.col("_inches").alias("inches"))


def lk6(spark, sf):
    return L.link_sizes(_true_model(spark, sf), fx.sizes(spark, sf)).filter("linked_size_id IS NOT NULL").select(
        "inventory_id", "linked_size_id", F.round("volume_delta", 2).alias("volume_delta"), "tolerance", "candidate_count")


def lk7(spark, sf):
    return L.has_size_family(_true_model(spark, sf), fx.sizes(spark, sf)).select("inventory_id")


def lk8(spark, sf):
    return L.linkage_report(_projected(spark, sf, fx.SUPPORTED, columns=("region_code", "retailer_name")))


def lk9(spark, sf):
    p = _projected(spark, sf)
    updates = p.select("inventory_id", "new_brand_id", "new_model_id", "new_size_id")
    return L.apply_links(fx.inventory(spark, sf), updates).select("inventory_id", "brand_id", "model_id", "size_id")


def lk10(spark, sf):
    return L.canonical_link_report(_projected(spark, sf, ambiguous=True))


def ag18(spark, sf):
    p = _projected(spark, sf, columns=("true_size_id",)).withColumn("effective_model_id", F.when(F.col("true_size_id") % 3 != 0, F.col("effective_model_id")))
    return L.top_unmatched(p).select("brand_name", "hint", "rows", F.array_join("titles", "|").alias("titles"))


def jn8(spark, sf):
    return L.link_by_contains(fx.inventory(spark, sf), fx.aliases(spark, sf).select("alias", "brand_id"), fx.models(spark, sf))


def wn3(spark, sf):
    pairs = L.contained_models(fx.inventory(spark, sf), fx.aliases(spark, sf).select("alias", "brand_id"), fx.models(spark, sf))
    return L.longest_first(pairs)


def jn9(spark, sf):
    inv = _true_model(spark, sf).withColumn("size_id", F.lit(None).cast("long"))
    return L.link_sizes_band(inv, fx.sizes(spark, sf)).select("inventory_id", "linked_size_id", F.round("delta", 2).alias("delta"))


def wn4(spark, sf):
    s = fx.sizes(spark, sf).withColumnRenamed("size_id", "sid")
    return L.nearest_volume(_true_model(spark, sf), s, ["model_id", "length"], "sid").select("inventory_id", "sid", F.round("delta", 2).alias("delta"))


def lk23(spark, sf):
    a = fx.aliases(spark, sf).select("alias", "brand_id", F.substring_index("alias", "#", -1).cast("int").alias("position"))
    return L.reconcile_brands(fx.inventory(spark, sf), a).select(
        "inventory_id", "reconciled_brand_id", F.col("changed").cast("int").alias("changed"))


def lk28(spark, sf):
    name = F.when(F.col("size_id") % 3 == 0, F.col("model_name")).when(
        F.col("size_id") % 3 == 1, F.concat(F.col("model_name"), F.lit(" pro"))).otherwise(F.substring_index("model_name", " ", -1))
    rows = fx.parts(spark, sf).select(F.col("size_id").alias("inventory_id"), "brand_id", name.alias("model_text"))
    return L.link_model_fuzzy(rows, fx.models(spark, sf))


def _policy_sides(spark, sf):
    """Listings of a known brand and the sizes of their true models; whether the model counts as matched depends on the listing alone."""
    inv = fx.inventory(spark, sf).filter("brand_id IS NOT NULL")
    left = L.policy_listings(inv, "true_model_id").withColumn("brand_matches", F.lit(True)).withColumn(
        "model_matches", F.coalesce(F.col("model_id") == F.col("true_model_id"), F.lit(False)) | (F.col("true_size_id") % 2 == 0))
    return left, L.policy_sizes(fx.sizes(spark, sf))


def lk1(spark, sf):
    return L.outcome_counts(*_policy_sides(spark, sf)).withColumn("exact", F.col("exact").cast("int"))


def lk2(spark, sf):
    return L.compatibility_counts(*_policy_sides(spark, sf)).withColumn("ok", F.col("ok").cast("int"))


def lk3(spark, sf):
    inv = fx.inventory(spark, sf).filter("brand_id IS NOT NULL")
    return L.equivalent_pairs(L.source_dimensions(inv).withColumn("_m", F.col("true_model_id")), L.policy_sizes(fx.sizes(spark, sf)))


def lk20(spark, sf):
    return L.policy_diff(*_policy_sides(spark, sf))


QUERIES = {
    "jn14_resolve_brand": jn14, "jn11_model_candidates": jn11, "lk4_model_score": lk4, "lk5_select_model": lk5, "jn12_size_candidates": jn12,
    "lk6_select_size": lk6, "lk7_size_family": lk7, "lk8_linkage_report": lk8, "lk9_apply_links": lk9, "lk10_canonical_link_report": lk10,
    "ag18_top_unmatched": ag18, "jn8_link_by_contains": jn8, "wn3_longest_first": wn3, "jn9_link_sizes_band": jn9, "wn4_nearest_volume": wn4,
    "lk23_reconcile_brands": lk23, "lk28_link_model_fuzzy": lk28, "lk1_classify_exact": lk1, "lk2_construction_compatible": lk2,
    "lk3_equivalent_dimensions": lk3, "lk20_policy_diff": lk20,
}


def key(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x},'')),'&',' and '),'[^a-z0-9]+',' ','g'))"


def meas(x: str) -> str:
    """Mixed fraction or decimal text to DECIMAL(12,4)."""
    return (f"(CAST(split_part({x},' ',1) AS DECIMAL(12,4)) + CASE WHEN {x} LIKE '% %' THEN CAST(CAST(split_part(split_part({x},' ',2),'/',1) AS DOUBLE) / "
            f"CAST(split_part({x},'/',2) AS DOUBLE) AS DECIMAL(12,4)) ELSE CAST(0 AS DECIMAL(12,4)) END)")


def inches(x: str) -> str:
    return f"(CAST(split_part({x},'''',1) AS INT) * 12 + CAST(split_part({x},'''',2) AS INT))"


_TD = """'([0-9]+''[0-9]+)" x ([^"]+)" x ([^"]+)" - ([0-9.]+)L'"""
NAMED = """SELECT i.*, coalesce(c.brand_id, t.brand_id) AS parsed_brand_id, coalesce(c.brand_name, t.brand_name) AS parsed_brand
FROM inventory i LEFT JOIN brands c ON i.brand_name = c.brand_name LEFT JOIN aliases t ON regexp_extract(i.title, '^Brand#[0-9]+') = t.alias"""
HINTED = """SELECT * EXCLUDE (brand_id), brand_id AS old_brand_id, coalesce(brand_id, parsed_brand_id) AS brand_id,
CASE WHEN title LIKE '% Surfboards - %' THEN split_part(title, ' - ', 2)
ELSE trim(regexp_replace(regexp_replace(regexp_replace(title, '^Brand#[0-9]+\\s*', ''), '^[0-9]+''[0-9]+\\s*', ''), '\\bPU\\b.*$', '')) END AS hint FROM named"""
CANDS = f"""SELECT inventory_id, model_id, model_name, score FROM (SELECT h.inventory_id, m.model_id, m.model_name,
CASE WHEN hk <> '' AND hk = mk THEN 14000 WHEN starts_with(hk, mk || ' ') THEN 11000 WHEN nk = mk THEN 10000
WHEN contains(' ' || nk || ' ', ' ' || mk || ' ') THEN 7000
WHEN contains(' ' || rk || ' ', ' ' || mk || ' ') AND (hk = '' OR starts_with(hk, mk)) THEN 5000 END + 10 * length(mk) AS score
FROM (SELECT inventory_id, brand_id, {key('hint')} AS hk, {key('title')} AS rk, {key('normalised_title')} AS nk FROM hinted) h
JOIN (SELECT *, {key('model_name')} AS mk FROM models) m ON h.brand_id = m.brand_id) WHERE score IS NOT NULL"""
BEST = """SELECT inventory_id, arg_min(model_id, rn) AS linked_model_id, arg_min(model_name, rn) AS linked_model, max(score) AS score,
count(*) AS candidate_count, count(*) FILTER (score = top) AS ambiguous_count, string_agg(model_name, '|' ORDER BY rn) FILTER (rn <= 5) AS top_models
FROM (SELECT *, max(score) OVER (PARTITION BY inventory_id) AS top, row_number() OVER (PARTITION BY inventory_id ORDER BY score DESC, length(model_name) DESC, model_id) AS rn FROM cands)
GROUP BY inventory_id"""


def dims_cte(source: str, model: str) -> str:
    return f"""SELECT inventory_id, {model} AS mid, nullif(construction,'') AS own_c, title, {inches('lt')} AS li, {meas('wt')} AS w, {meas('tt')} AS t, CAST(vt AS DECIMAL(12,4)) AS v
FROM (SELECT *, coalesce(length, nullif(regexp_extract(title, {_TD}, 1), '')) AS lt, coalesce(width, nullif(regexp_extract(title, {_TD}, 2), '')) AS wt,
coalesce(thickness, nullif(regexp_extract(title, {_TD}, 3), '')) AS tt, coalesce(CAST(volume AS VARCHAR), nullif(regexp_extract(title, {_TD}, 4), '')) AS vt FROM {source}) WHERE {model} IS NOT NULL"""


SZ = f"SELECT size_id AS sid, model_id AS smid, length_inches AS sli, {meas('width')} AS sw, {meas('thickness')} AS st, CAST(volume AS DECIMAL(12,4)) AS sv, {key('construction')} AS sc FROM sizes"
# the fixture names no construction other than PU in titles, and PU listings end in ' PU'
PAIRS = f"""SELECT d.*, s.*, abs(v - sv) AS dv, CASE WHEN v IS NULL THEN 4 WHEN abs(v-sv) = 0 THEN 0 WHEN abs(v-sv) <= 0.05 THEN 1 WHEN abs(v-sv) <= 0.10 THEN 2 WHEN abs(v-sv) <= 0.20 THEN 3 END AS tier,
(w IS NULL OR coalesce(abs(w-sw) <= 0.15, false)) AND (t IS NULL OR coalesce(abs(t-st) <= 0.08, false)) AND
(CASE WHEN title LIKE '% PU' THEN 'pu' ELSE coalesce(nullif({key('own_c')}, 'standard'), '') END IN ('', CASE WHEN sc = 'standard' THEN '' ELSE sc END)) AS ok
FROM dims d JOIN sz s ON d.mid = s.smid AND d.li = s.sli"""
CHOSEN = """SELECT inventory_id, max(size_id) AS linked_size_id, max(dv) AS volume_delta, max(tier) AS tier, max(n) AS candidate_count FROM (
SELECT inventory_id, sid AS size_id, dv, tier, ok, count(*) OVER (PARTITION BY inventory_id) AS n,
count(*) FILTER (ok) OVER (PARTITION BY inventory_id) AS k FROM (SELECT *, min(tier) OVER (PARTITION BY inventory_id) AS mt FROM pairs) WHERE tier = mt)
WHERE k = 1 AND ok GROUP BY inventory_id"""
FAMILY = "SELECT inventory_id, bool_or(ok) AS has_family FROM pairs GROUP BY inventory_id"


def linker(body: str, ambiguous: bool = False, where: str = "true") -> str:
    """The whole linker as CTEs: named, hinted, cands, best, linked, pairs, chosen, projected."""
    take = "true" if ambiguous else "ambiguous_count = 1"
    return sql("inventory aliases brands models sizes", body, named=NAMED, hinted=HINTED + f" WHERE {where}", cands=CANDS, best=BEST,
               linked=f"""SELECT h.*, coalesce(h.parsed_brand, h.brand_name) AS effective_brand, CASE WHEN h.old_brand_id IS NULL THEN h.parsed_brand_id END AS new_brand_id,
CASE WHEN h.model_id IS NULL THEN b.linked_model_id END AS linked_model_id, CASE WHEN h.model_id IS NULL AND {take} THEN b.linked_model_id END AS new_model_id,
coalesce(h.model_id, CASE WHEN {take} THEN b.linked_model_id END) AS effective_model_id FROM hinted h LEFT JOIN best b USING (inventory_id)""",
               dims=dims_cte("(SELECT * FROM linked WHERE size_id IS NULL)", "effective_model_id"), sz=SZ, pairs=PAIRS, chosen=CHOSEN, fam=FAMILY,
               projected="""SELECT l.*, c.linked_size_id AS new_size_id, coalesce(f.has_family, false) AS has_family FROM linked l
LEFT JOIN chosen c USING (inventory_id) LEFT JOIN fam f USING (inventory_id)""")


def sizer(body: str) -> str:
    return sql("inventory sizes", body, dims=dims_cte("inventory", "true_model_id"), sz=SZ, pairs=PAIRS, chosen=CHOSEN)


def _level(name: str, r: str, s: str, b: str, by: str) -> str:
    def p(c: str) -> str:
        return f"round({c} * 100.0 / count(*), 2)"
    ma, fa, sa = "count(effective_model_id)", "count(*) FILTER (sized OR has_family)", "count(*) FILTER (sized)"
    return f"""SELECT '{name}' AS level, {r} AS region_code, {s} AS retailer_name, {b} AS brand_name, count(*) AS supported_rows, count(model_id) AS model_before,
{ma} AS model_after, {fa} AS family_after, count(size_id) AS size_before, {sa} AS size_after,
count(*) FILTER (has_family AND NOT sized AND effective_model_id IS NOT NULL) AS ambiguous_sizes, count(DISTINCT effective_model_id) AS models_after,
{p('count(model_id)')} AS model_before_pct, {p(ma)} AS model_after_pct, {p(fa)} AS family_after_pct, {p('count(size_id)')} AS size_before_pct, {p(sa)} AS size_after_pct
FROM (SELECT *, size_id IS NOT NULL OR new_size_id IS NOT NULL AS sized FROM projected) {by}"""


_N = "CAST(NULL AS VARCHAR)"
_REPORT = " UNION ALL ".join([
    _level("global", _N, _N, _N, ""), _level("region", "region_code", _N, _N, "GROUP BY region_code"),
    _level("retailer", "region_code", "retailer_name", _N, "GROUP BY region_code, retailer_name"),
    _level("brand", "region_code", _N, "effective_brand", "GROUP BY region_code, effective_brand")])

_POLICY = f"""SELECT i.*, z.model_name AS zmodel, z.size_id AS t_size_id, z.length AS t_length, z.width AS t_width, z.thickness AS t_thickness, z.volume AS t_volume, z.construction AS t_construction,
coalesce(i.model_id = i.true_model_id, false) OR i.true_size_id % 2 = 0 AS mm FROM inventory i JOIN sizes z ON i.true_model_id = z.model_id WHERE i.brand_id IS NOT NULL"""
_PD = f"""SELECT p.*, CASE WHEN lt IS NOT NULL THEN {inches('lt')} WHEN title LIKE '% used board' THEN {inches("split_part(title,' ',1)")} END AS li, {inches('t_length')} AS tli,
{meas('wt')} AS w, {meas('tt')} AS t, CAST(vt AS DECIMAL(12,4)) AS v, {meas('t_width')} AS tw, {meas('t_thickness')} AS tth, CAST(t_volume AS DECIMAL(12,4)) AS tv,
CASE WHEN {key('t_construction')} = 'standard' THEN '' ELSE {key('t_construction')} END AS tc, CASE WHEN {key('construction')} = 'standard' THEN '' ELSE {key('construction')} END AS rc,
contains(' ' || {key('title')} || ' ', ' ' || zmodel || ' ') AS strong
FROM (SELECT *, coalesce(length, nullif(regexp_extract(title, {_TD}, 1), '')) AS lt, coalesce(width, nullif(regexp_extract(title, {_TD}, 2), '')) AS wt,
coalesce(thickness, nullif(regexp_extract(title, {_TD}, 3), '')) AS tt, coalesce(CAST(volume AS VARCHAR), nullif(regexp_extract(title, {_TD}, 4), '')) AS vt FROM policy) p"""
_COMP = """CASE WHEN tc = '' THEN 'canonical_construction_unknown' WHEN title LIKE '% PU' AND tc = 'pu' THEN 'title_construction_match' WHEN title LIKE '% PU' THEN 'title_construction_mismatch'
WHEN rc <> '' AND rc = tc THEN 'construction_match' WHEN rc <> '' THEN 'construction_mismatch' ELSE 'construction_unknown' END"""
_EQ = "coalesce(li = tli AND abs(w-tw) <= 0.15 AND abs(t-tth) <= 0.08 AND abs(v-tv) <= 0.75, false)"
_REASONED = f"""SELECT *, CASE WHEN NOT mm THEN 'model_mismatch' WHEN li IS DISTINCT FROM tli THEN 'length_mismatch' WHEN comp LIKE '%mismatch' THEN comp
WHEN coalesce(size_id = t_size_id, false) THEN 'board_size_id' WHEN {_EQ} THEN 'equivalent_dimensions'
WHEN w IS NULL AND t IS NULL AND strong AND coalesce(abs(v-tv) <= 0.75, false) THEN 'length_volume_strong_model'
WHEN v IS NULL THEN 'missing_volume' WHEN w IS NULL OR t IS NULL THEN 'missing_width_or_thickness' ELSE 'dimensions_outside_tolerance' END AS reason
FROM (SELECT *, {_COMP} AS comp FROM pd)"""
_IS_EXACT = "reason IN ('board_size_id','equivalent_dimensions','length_volume_strong_model')"


def policy(body: str) -> str:
    return sql("inventory sizes", body, policy=_POLICY, pd=_PD, reasoned=_REASONED)


_CONTAINED = f"""SELECT i.inventory_id, m.model_id, m.model_name FROM inventory i JOIN models m ON contains(' ' || {key('i.title')} || ' ', ' ' || {key('m.model_name')} || ' ')
JOIN aliases a ON a.brand_id = m.brand_id AND contains(' ' || {key('i.title')} || ' ', ' ' || {key('a.alias')} || ' ')"""
_FUZZY_ROWS = "SELECT size_id AS inventory_id, brand_id, CASE size_id % 3 WHEN 0 THEN model_name WHEN 1 THEN model_name || ' pro' ELSE split_part(model_name, ' ', 2) END AS txt FROM parts"

ORACLE = {
    "jn14_resolve_brand": sql("inventory aliases brands", "SELECT inventory_id, parsed_brand_id, parsed_brand FROM named", named=NAMED),
    "jn11_model_candidates": linker("SELECT inventory_id, model_id, score FROM cands"),
    "lk4_model_score": linker("SELECT score, count(*) AS pairs FROM cands GROUP BY score"),
    "lk5_select_model": linker("SELECT * FROM best"),
    "jn12_size_candidates": sizer("SELECT inventory_id, sid AS size_id, li AS inches FROM pairs"),
    "lk6_select_size": sizer("""SELECT inventory_id, linked_size_id, round(CAST(volume_delta AS DOUBLE), 2) AS volume_delta,
(['exact','plus_minus_0_05','plus_minus_0_10','plus_minus_0_20','length_only_no_retailer_volume'])[tier+1] AS tolerance, candidate_count FROM chosen"""),
    "lk7_size_family": sizer("SELECT DISTINCT inventory_id FROM pairs WHERE ok"),
    "lk8_linkage_report": linker(_REPORT, where="coalesce(parsed_brand, brand_name) IN ('Maker 0','Maker 1','Maker 2')"),
    "lk9_apply_links": linker("SELECT inventory_id, brand_id, coalesce(model_id, new_model_id) AS model_id, coalesce(size_id, new_size_id) AS size_id FROM projected"),
    "lk10_canonical_link_report": linker("""SELECT kind, name, count(*) AS rows FROM (
SELECT 'reason' AS kind, 'unknown_brand' AS name FROM todo WHERE brand_id IS NULL
UNION ALL SELECT 'reason', CASE WHEN linked_model_id IS NOT NULL THEN 'model_link_candidate' WHEN hint = '' THEN 'model_parse_failed' ELSE 'model_not_in_catalogue' END FROM todo WHERE model_id IS NULL
UNION ALL SELECT 'reason', CASE WHEN effective_model_id IS NULL THEN 'size_blocked_by_model' WHEN new_size_id IS NOT NULL THEN 'size_link_candidate' WHEN length IS NULL THEN 'missing_length'
  WHEN volume IS NULL THEN 'ambiguous_length_without_volume' ELSE 'no_size_within_volume_tolerance' END FROM todo WHERE size_id IS NULL
UNION ALL SELECT 'pattern', CASE WHEN len(string_split(title, ' - ')) >= 3 THEN 'structured_brand_model_dimensions' ELSE 'other_title_pattern' END FROM todo) GROUP BY ALL""", ambiguous=True)
    .replace("\nSELECT kind", ", todo AS (SELECT * FROM projected WHERE model_id IS NULL OR size_id IS NULL)\nSELECT kind", 1),
    "ag18_top_unmatched": linker("""SELECT brand_name, hint, rows, titles FROM (SELECT coalesce(effective_brand,'missing') AS brand_name, CASE WHEN hint = '' THEN '<missing>' ELSE hint END AS hint, count(*) AS rows,
array_to_string(list_sort(list_distinct(list(title)))[1:3], '|') AS titles FROM projected WHERE effective_model_id IS NULL OR true_size_id % 3 = 0 GROUP BY 1, 2) ORDER BY rows DESC, brand_name, hint LIMIT 50"""),
    "jn8_link_by_contains": sql("inventory aliases models", """SELECT inventory_id, model_id, model_name FROM pairs WHERE inventory_id IN (SELECT inventory_id FROM inventory WHERE model_id IS NULL)
QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY length(model_name) DESC, model_id) = 1""", pairs=_CONTAINED),
    "wn3_longest_first": sql("inventory aliases models", """SELECT inventory_id, model_id, model_name FROM pairs
QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY length(model_name) DESC, model_id) = 1""", pairs=_CONTAINED),
    "jn9_link_sizes_band": sql("inventory sizes", """SELECT i.inventory_id, z.size_id AS linked_size_id, round(coalesce(CAST(abs(i.volume - z.volume) AS DOUBLE), 999), 2) AS delta
FROM inventory i JOIN sizes z ON i.true_model_id = z.model_id AND i.length = z.length AND (abs(i.volume - z.volume) <= 0.75 OR (i.width = z.width AND i.thickness = z.thickness))
QUALIFY row_number() OVER (PARTITION BY i.inventory_id ORDER BY coalesce(abs(i.volume - z.volume), 999), z.size_id) = 1"""),
    "wn4_nearest_volume": sql("inventory sizes", """SELECT i.inventory_id, z.size_id AS sid, round(coalesce(CAST(abs(i.volume - z.volume) AS DOUBLE), 999), 2) AS delta
FROM inventory i JOIN sizes z ON i.true_model_id = z.model_id AND i.length = z.length
QUALIFY row_number() OVER (PARTITION BY i.inventory_id ORDER BY coalesce(abs(i.volume - z.volume), 999), z.size_id) = 1"""),
    "lk23_reconcile_brands": sql("inventory aliases", """SELECT i.inventory_id, a.brand_id AS reconciled_brand_id, CASE WHEN a.brand_id IS NOT NULL AND i.brand_id IS DISTINCT FROM a.brand_id THEN 1 ELSE 0 END AS changed
FROM inventory i LEFT JOIN aliases a ON i.title LIKE a.alias || ' %'"""),
    "lk28_link_model_fuzzy": sql("parts models", f"""SELECT r.inventory_id, m.model_id, CASE WHEN r.txt = m.model_name THEN 'equal' ELSE 'contained' END AS how FROM r JOIN models m ON r.brand_id = m.brand_id
AND (contains(' ' || r.txt || ' ', ' ' || m.model_name || ' ') OR contains(' ' || m.model_name || ' ', ' ' || r.txt || ' '))
QUALIFY row_number() OVER (PARTITION BY r.inventory_id ORDER BY r.txt = m.model_name DESC, length(m.model_name) DESC, m.model_id) = 1""", r=_FUZZY_ROWS),
    "lk1_classify_exact": policy(f"SELECT reason, CAST({_IS_EXACT} AS INT) AS exact, count(*) AS pairs, count(DISTINCT inventory_id) AS listings FROM reasoned GROUP BY reason"),
    "lk2_construction_compatible": policy("SELECT comp AS reason, CASE WHEN comp LIKE '%mismatch' THEN 0 ELSE 1 END AS ok, count(*) AS pairs FROM reasoned GROUP BY comp"),
    "lk3_equivalent_dimensions": policy(f"SELECT inventory_id, t_size_id FROM (SELECT *, {inches('lt2')} AS li2 FROM (SELECT *, coalesce(length, nullif(regexp_extract(title, {_TD}, 1), '')) AS lt2 FROM pd)) WHERE {_EQ.replace('li = tli', 'li2 = tli')}"),
    "lk20_policy_diff": policy(f"""SELECT brand_name, count(*) AS evaluated, count(*) FILTER (b) AS before_exact, count(*) FILTER (a) AS after_exact,
count(*) FILTER (a) - count(*) FILTER (b) AS net_exact FROM (SELECT brand_name, inventory_id, bool_or({_IS_EXACT}) AS a,
bool_or(strong AND coalesce(length = t_length, false) AND lower(coalesce(construction,'')) = lower(t_construction) AND (volume IS NULL OR abs(volume - t_volume) <= 0.75)) AS b
FROM reasoned WHERE brand_name IS NOT NULL GROUP BY ALL) GROUP BY brand_name"""),
}
