"""Listing classifier, validation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import fixed_values as V
from stockloom.functions.status import is_available_status
from stockloom.operators import listings as ls
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.plans.q_linkage import key

_X = ("board bag", "lesson", "fins")


def pf4(spark, sf):
    return ls.score_listings(fx.feed_text(spark, sf)).select(
        "listing_id", "confidence", F.col("is_board").cast("int").alias("is_board"), F.array_join("reasons", ",").alias("reasons"), "reject_reason")


def pf5(spark, sf):
    p = ls.feed_price("price")
    return fx.feed_text(spark, sf).select("listing_id", p.alias("amount"), ls.price_check(p).alias("verdict"))


def pf6(spark, sf):
    return ls.classify_candidates(fx.feed_text(spark, sf), V.BOARD_TYPES, V.LISTING_BRANDS, _X).select(
        "listing_id", "confidence", F.col("accepted").cast("int").alias("accepted"))


def pf7(spark, sf):
    return ls.guard_catalogue(fx.feed_text(spark, sf)).select("listing_id", "reason", F.col("accepted").cast("int").alias("accepted"))


def _regional(spark, sf):
    i, k = fx.inventory(spark, sf), F.col("true_size_id")
    return i.select(
        "inventory_id", F.when(k % 23 != 0, F.concat(F.lit("shop_"), "retailer_id")).alias("retailer_slug"), F.when(k % 29 != 0, F.col("retailer_name")).alias("retailer_name"),
        "region_code", F.when(k % 9 == 0, "USD").otherwise("EUR").alias("currency"), "title", "product_url", F.when(k % 10 != 0, F.col("price")).alias("price"),
        F.when(k % 4 == 0, F.col("is_active")).alias("is_available"), "stock_status", "length", "volume", "brand_name", "model_id", "true_model_id", "width", "thickness", "construction", "image_url", "fin_setup")


def pf8(spark, sf):
    return ls.reject_reasons(_regional(spark, sf), "EUROPE", "EUR").select("inventory_id", F.array_join("reject_reasons", ",").alias("reasons"))


def pf9(spark, sf):
    return ls.excluded_product_type(fx.inventory(spark, sf), ["retailer_name", "brand_name", "title"]).groupBy("excluded_type").agg(F.count("*").alias("rows"))


def pf10(spark, sf):
    names = fx.retailers(spark, sf).filter(F.col("country") == "NATION_3").select(F.upper("retailer_name").alias("name"))
    return ls.exclude_retailers(fx.inventory(spark, sf), names).groupBy("retailer_name").agg(F.count("*").alias("rows"))


def pf11(spark, sf):
    return ls.fallback_exclusions(fx.inventory(spark, sf))


def tx9(spark, sf):
    return ls.normalise_listings(fx.inventory(spark, sf), fx.BRANDS).select(
        "inventory_id", "length", F.col("width_in").cast("double").alias("width_in"), F.col("thickness_in").cast("double").alias("thickness_in"),
        F.col("volume").cast("double").alias("volume"), "construction", "model_key")


def _tx10(spark, sf):
    k = F.col("true_size_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("€ "), F.format_number("price", 2))).when(
        k % 3 == 1, F.concat(F.regexp_replace(F.col("price").cast("int").cast("string"), r"(\d)(\d{3})$", "$1.$2"), F.lit(",00 EUR"))).otherwise("POA")
    i = fx.inventory(spark, sf).withColumn("price", text).withColumns({
        "retailer_slug": F.when(k % 23 != 0, F.concat(F.lit("shop_"), "retailer_id")), "retailer_name": F.when(k % 29 != 0, F.col("retailer_name")),
        "currency": F.when(k % 9 == 0, "USD").when(k % 9 < 5, " EUR "), "is_available": F.when(k % 4 == 0, F.col("is_active")), "brand_name": F.when(k % 6 == 0, F.concat("brand_name", F.lit(" Surfboards"))).otherwise(F.col("brand_name"))})
    return ls.normalise_regional(i.drop("brand_id"), "EUROPE", "EUR", fx.BRANDS)


def tx10(spark, sf):
    return _tx10(spark, sf).select(
        "inventory_id", F.col("price_amount").cast("double").alias("price_amount"), "stock_text", "currency", F.col("importable").cast("int").alias("importable"))


def tx10r(spark, sf):
    return _tx10(spark, sf).select("inventory_id", "brand_name", "model_name", "length", F.col("volume").cast("double").alias("volume"), "construction", "fin_setup")


def ag13(spark, sf):
    i = fx.inventory(spark, sf)
    n = i.filter("size_id IS NOT NULL").select("retailer_id", F.concat_ws("|", "product_url", "length").alias("_dup"), is_available_status("stock_status").cast("long").alias("available"))
    return ls.retailer_quality(i, i.filter(F.col("true_size_id") % 12 == 0), n)


def ag13t(spark, sf):
    """Retailers 4, 12, 20, … have no raw rows, retailers 8, 16, … only normalised ones."""
    i = fx.inventory(spark, sf)
    n = i.filter("size_id IS NOT NULL").select("retailer_id", F.concat_ws("|", "product_url", "length").alias("_dup"), is_available_status("stock_status").cast("long").alias("available"))
    return ls.retailer_quality_totals(ls.retailer_quality(i.filter("retailer_id % 4 <> 0"), i.filter("true_size_id % 12 = 0 AND retailer_id % 8 <> 0"), n))


def ag14(spark, sf):
    return ls.inventory_quality(fx.inventory(spark, sf))


def ag20(spark, sf):
    i = fx.inventory(spark, sf)
    return ls.funnel(i, i.filter("length IS NOT NULL"), i.filter("model_id IS NOT NULL"), i.filter("size_id IS NOT NULL"), "retailer_name")


def _import_rows(spark, sf):
    """Regional rows with their model's name, some of it blank, and a catalogue of three brands."""
    r = _regional(spark, sf)
    m = fx.models(spark, sf)
    r = r.join(m.select(F.col("model_id").alias("true_model_id"), "model_name"), "true_model_id")
    return ls.reject_reasons(r, "EUROPE", "EUR"), m.filter(F.col("brand_id") < 3)


def _reported(spark, sf):
    return ls.import_report(*_import_rows(spark, sf))


def ag21w(spark, sf):
    return ls.import_reasons(*_import_rows(spark, sf))


def ag21u(spark, sf):
    return ls.import_unknown(*_import_rows(spark, sf))


def ag21(spark, sf):
    return _reported(spark, sf)


def ag21r(spark, sf):
    return ls.recommendation(_reported(spark, sf))


def st6(spark, sf):
    f = fx.feed_text(spark, sf)
    feeds = {"shopify": f.select("listing_id", "title"), "woo": f.select("listing_id", "price"), "wix": f.select("listing_id", "vendor")}
    return ls.union_feeds(feeds).select("platform", "listing_id", "title", "price", "vendor")


def ag22(spark, sf):
    return ls.build_catalogue(fx.feed_text(spark, sf), ["title", "product_type"], "listing_id").select("title", "product_type", "listing_id", "reason")


def tx13(spark, sf):
    v = fx.inventory(spark, sf).select(F.col("true_size_id").alias("product_id"), F.col("inventory_id").alias("variant_id"), F.concat("fin_setup", F.lit(" board")).alias("title"),
                                       F.col("title").alias("variant_title"), F.col("price").cast("int").cast("string").alias("price"), F.col("is_active").alias("available"))
    return ls.direct_rows(v).select("variant_id", "length", F.col("width_in").cast("double").alias("width_in"), F.col("volume").cast("double").alias("volume"), "construction", "fin_setup",
                                    F.col("price").cast("double").alias("price"), F.col("is_available").cast("int").alias("is_available"))


QUERIES = {"pf4_score_listings": pf4, "pf5_price_check": pf5, "pf6_classify_candidates": pf6, "pf7_guard_catalogue": pf7, "pf8_reject_reasons": pf8,
           "pf9_excluded_product_type": pf9, "pf10_exclude_retailers": pf10, "pf11_fallback_exclusions": pf11, "tx9_normalise_listings": tx9, "tx10_normalise_regional": tx10, "tx10_regional_names": tx10r,
           "ag13_retailer_quality": ag13, "ag13_retailer_quality_totals": ag13t, "ag14_inventory_quality": ag14, "ag20_funnel": ag20, "ag21_import_report": ag21, "ag21_import_reasons": ag21w, "ag21_import_unknown": ag21u, "ag21_recommendation": ag21r,
           "st6_union_feeds": st6, "ag22_build_catalogue": ag22, "tx13_direct_rows": tx13}


def _rx(terms) -> str:
    body = "|".join(t.replace(".", "[.]").replace("'", "''") for t in terms)
    return f"'(^|[^a-z0-9])({body})([^a-z0-9]|$)'"


def _q(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


_BLOB = "array_to_string(list_filter([{0}], lambda p: p IS NOT NULL AND p <> ''), ' ')"


def _blob(*cols: str) -> str:
    return _BLOB.format(", ".join(f"lower(trim({c}))" for c in cols))


_F0 = f"""SELECT *, {_blob('title','vendor','product_type','description','url','length','width','thickness','volume_litres')} AS x, {_blob('title','url')} AS tt, {_blob('product_type')} AS cc,
TRY_CAST(CASE WHEN regexp_matches(replace(price,'$',''), '^[0-9]+([.][0-9]{{1,2}})?$') THEN replace(price,'$','') END AS DOUBLE) AS pr FROM feed_text"""
_F1 = f"""SELECT *, CASE WHEN pr IS NULL THEN 'missing_or_unparsed_price' WHEN pr < 250 THEN 'price_too_low' WHEN pr > 5000 THEN 'price_too_high' ELSE 'price_ok' END AS pc,
regexp_matches(x, {_q(V.FULL_DIMENSION_RX)}) AS fd, regexp_matches(x, {_q(V.LENGTH_RX)}) AS le, regexp_matches(x, {_q(V.DECIMAL_LENGTH_RX)}) AS dl, regexp_matches(x, {_q(V.COMPACT_LENGTH_RX)}) AS cl,
regexp_matches(x, {_q(V.LITRE_RX)}) AS li, (length IS NOT NULL)::INT + (width IS NOT NULL)::INT + (volume_litres IS NOT NULL)::INT >= 2 AS sd, regexp_matches(x, {_rx(V.BOARD_TYPES)}) AS bt,
regexp_matches(cc, {_rx(V.BOARD_CATEGORIES)}) AS cb, regexp_matches(x, {_rx(V.LISTING_BRANDS)}) AS br, regexp_matches(x, {_rx(V.CONSTRUCTION_TERMS)}) AS co, regexp_matches(x, {_rx(V.FIN_SYSTEMS)}) AS fi,
regexp_matches(url, {_q(V.BOARD_URL_RX)}) AS uh, regexp_matches(x, {_rx(V.USED_TERMS)}) AS us FROM f0"""
_F2 = f"""SELECT *, us AND coalesce(pr >= 400, false) AND (br OR bt OR cb) AND (le OR dl OR cl OR fd OR sd) AS ub,
CASE WHEN x = '' THEN 'missing_text' WHEN regexp_matches(tt, {_rx(V.HARD_EXCLUDE_TERMS)}) THEN 'hard_excluded_product_type'
WHEN (regexp_matches(tt, {_rx(V.FIN_ACCESSORY_TERMS)}) OR regexp_matches(cc, {_rx(V.FIN_ACCESSORY_TERMS)})) AND NOT cb THEN 'fin_accessory_not_board'
WHEN regexp_matches(tt, {_rx(V.SERVICE_TERMS)}) OR regexp_matches(cc, {_rx(V.SERVICE_TERMS)}) THEN 'service_or_rental_listing' WHEN pc IN ('price_too_low','price_too_high') THEN pc END AS early FROM f1"""
_W = [("full_dimensions", "fd", 4), ("length", "le", 2), ("decimal_length", "dl", 2), ("compact_length", "cl", 1), ("litres", "li", 3), ("structured_dimensions", "sd", 4), ("board_type", "bt", 3),
      ("category_board_signal", "cb", 6), ("brand", "br", 3), ("construction", "co", 1), ("fin_system", "fi", 1), ("url_board_hint", "uh", 1), ("used_board_listing", "ub", 2)]
_CONF = " + ".join(f"{w} * {c}::INT" for _, c, w in _W)
_STRONG = """(br AND (bt OR cb OR fd OR li OR sd)) OR ((fd OR sd) AND (li OR bt OR cb OR br OR uh)) OR ((bt OR cb OR uh) AND (le OR dl OR cl OR li OR sd OR br OR co))
OR (cb AND coalesce(pr >= 400, false)) OR (sd AND (fi OR co OR uh OR br)) OR ub"""
_PF4 = f"""SELECT listing_id, CASE WHEN early IS NULL THEN conf ELSE 0 END AS confidence, (early IS NULL AND conf >= 6 AND strong)::INT AS is_board,
CASE WHEN early IS NULL THEN array_to_string(list_filter([pc, {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _W)}], lambda r: r IS NOT NULL), ',') ELSE '' END AS reasons,
CASE WHEN early IS NOT NULL THEN early WHEN NOT (conf >= 6 AND strong) THEN 'low_confidence_or_missing_board_identity' END AS reject_reason FROM (SELECT *, {_CONF} AS conf, ({_STRONG}) AS strong FROM f2)"""


def _first(col: str, terms) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({col}, {_rx([t])}) THEN '{t}' END" for t in terms) + ")"


_G0 = f"""SELECT *, {_first('a', V.GUARD_HARD_NEGATIVE)} AS hard, {_first('a', V.GUARD_SOFT_NEGATIVE)} AS soft, coalesce({_first('c', V.GUARD_POSITIVE)}, {_first('lower(url)', V.GUARD_URL_POSITIVE)}) AS sig,
(length IS NOT NULL AND (width IS NOT NULL OR volume_litres IS NOT NULL)) OR regexp_matches(d, {_q(V.GUARD_DIMENSION_RX)}) OR (regexp_matches(d, {_q(V.GUARD_LENGTH_RX)}) AND regexp_matches(d, {_q(V.GUARD_VOLUME_RX)})) AS dim
FROM (SELECT *, {_blob('title','product_type','url','description')} AS a, {_blob('product_type','description')} AS c, {_blob('description','title')} AS d FROM feed_text)"""
_G1 = """SELECT *, CASE WHEN hard IS NOT NULL THEN 'negative_term:' || hard WHEN dim THEN 'dimension_signal' WHEN sig IS NOT NULL THEN 'context_signal:' || sig
WHEN soft IS NOT NULL THEN 'negative_term:' || soft ELSE 'missing_surfboard_evidence' END AS reason FROM g0"""
_REG = """SELECT *, CASE WHEN k % 23 <> 0 THEN 'shop_' || retailer_id END AS slug, CASE WHEN k % 29 <> 0 THEN retailer_name END AS rname, CASE WHEN k % 9 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
CASE WHEN k % 10 <> 0 THEN price END AS p, CASE WHEN k % 4 = 0 THEN is_active END AS avail FROM (SELECT *, true_size_id AS k FROM inventory)"""
_REJ = [("slug IS NULL", "missing_retailer_slug"), ("rname IS NULL", "missing_retailer_name"), ("region_code <> 'EUROPE'", "wrong_region"), ("currency <> 'EUR'", "wrong_currency"),
        ("product_url IS NULL", "missing_url"), ("p IS NULL", "missing_price"), ("avail IS NULL AND stock_status IS NULL", "missing_stock_status"), ("length IS NULL AND volume IS NULL", "missing_all_dimensions")]
_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _REJ) + "], lambda r: r IS NOT NULL), ',')"
_AV = "(stock_status IS NULL OR lower(trim(stock_status)) IN ('in stock','instock','in_stock','available','true'))"
_ELIG = f"list_filter([CASE WHEN NOT is_active THEN 'inactive' END, CASE WHEN product_url IS NULL THEN 'missing_product_url' END, CASE WHEN NOT {_AV} THEN 'unsupported_stock_status' END, CASE WHEN brand_id IS NULL THEN 'missing_brand_id' END], lambda r: r IS NOT NULL)"
_TD = """'([0-9]+''[0-9]+)" x ([^"]+)" x ([^"]+)" - ([0-9.]+)L'"""
_ME = "CAST(split_part({0},' ',1) AS DOUBLE) + CASE WHEN {0} LIKE '% %' THEN CAST(split_part(split_part({0},' ',2),'/',1) AS DOUBLE)/CAST(split_part({0},'/',2) AS DOUBLE) ELSE 0 END"
_IMP = f"""SELECT coalesce(rname,'<missing>') AS retailer_name, count(*) AS rows, count(*) FILTER (r='') AS importable, count(*) FILTER (r<>'') AS rejected, count(*) FILTER (r='' AND kb AND km) AS matched,
count(*) FILTER (r='' AND NOT (kb AND km)) AS review, count(*) FILTER (NOT kb) AS unknown_brand, count(*) FILTER (NOT km) AS unknown_model FROM (SELECT rname, {_REASONS} AS r,
coalesce(i.brand_name IN ('Maker 0','Maker 1','Maker 2'), false) AS kb, coalesce(i.brand_name IN ('Maker 0','Maker 1','Maker 2'), false) AS km FROM reg i) GROUP BY 1"""

ORACLE = {
    "pf4_score_listings": sql("feed_text", _PF4, f0=_F0, f1=_F1, f2=_F2),
    "pf5_price_check": sql("feed_text", "SELECT listing_id, pr AS amount, pc AS verdict FROM f1", f0=_F0, f1=_F1),
    "pf6_classify_candidates": sql("feed_text", f"""SELECT listing_id, CASE WHEN ex THEN 0 ELSE c END AS confidence, (NOT ex AND c >= 5)::INT AS accepted FROM (SELECT listing_id, regexp_matches(tt, {_rx(_X)}) AS ex,
5*regexp_matches(tt, {_rx(V.BOARD_TYPES)})::INT + 2*regexp_matches(tt, {_rx(V.LISTING_BRANDS)})::INT + 3*regexp_matches(tt, '\\b[5-9]\\s*(?:''|ft|’)')::INT AS c FROM f0)""", f0=_F0),
    "pf7_guard_catalogue": sql("feed_text", "SELECT listing_id, reason, (reason LIKE 'dimension%' OR reason LIKE 'context%')::INT AS accepted FROM g1", g0=_G0, g1=_G1),
    "pf8_reject_reasons": sql("inventory", f"SELECT inventory_id, {_REASONS} AS reasons FROM reg", reg=_REG),
    "pf9_excluded_product_type": sql("inventory", "SELECT CASE WHEN title LIKE '% used %' THEN 'used_board' END AS excluded_type, count(*) AS rows FROM inventory GROUP BY 1"),
    "pf10_exclude_retailers": sql("inventory", "SELECT retailer_name, count(*) AS rows FROM inventory WHERE country <> 'NATION_3' GROUP BY 1"),
    "pf11_fallback_exclusions": sql("inventory", f"""SELECT reason, count(*) FILTER (i = 1) AS primary_rows, count(*) AS all_rows FROM (SELECT unnest(r) AS reason, generate_subscripts(r, 1) AS i FROM
(SELECT CASE WHEN len(r0) = 0 THEN ['eligible'] ELSE r0 END AS r FROM (SELECT {_ELIG} AS r0 FROM inventory))) GROUP BY reason"""),
    "tx9_normalise_listings": sql("inventory", f"""SELECT inventory_id, l AS length, {_ME.format('w')} AS width_in, {_ME.format('t')} AS thickness_in, CAST(v AS DOUBLE) AS volume,
CASE WHEN title LIKE '% PU' THEN 'pu' ELSE lower(construction) END AS construction, {key('hint')} AS model_key FROM (SELECT *, coalesce(length, regexp_extract(title, '[0-9]+''[0-9]+')) AS l,
coalesce(width, nullif(regexp_extract(title, {_TD}, 2),'')) AS w, coalesce(thickness, nullif(regexp_extract(title, {_TD}, 3),'')) AS t, coalesce(CAST(volume AS VARCHAR), nullif(regexp_extract(title, {_TD}, 4),'')) AS v,
CASE WHEN title LIKE '% Surfboards - %' THEN split_part(title,' - ',2) ELSE trim(regexp_replace(regexp_replace(regexp_replace(title,'^Brand#[0-9]+\\s*',''),'^[0-9]+''[0-9]+\\s*',''),'\\bPU\\b.*$','')) END AS hint FROM inventory)"""),
    "tx10_normalise_regional": sql("inventory", f"""SELECT inventory_id, pa AS price_amount, CASE WHEN av THEN 'In Stock' WHEN NOT av THEN 'Out of Stock' ELSE 'Unknown' END AS stock_text, cu AS currency,
(true_size_id % 23 <> 0 AND true_size_id % 29 <> 0 AND region_code = 'EUROPE' AND product_url IS NOT NULL AND pa IS NOT NULL AND cu = 'EUR' AND av IS NOT NULL)::INT AS importable FROM (SELECT *, CASE WHEN true_size_id % 3 <> 2 THEN price END AS pa,
CASE WHEN true_size_id % 9 = 0 THEN 'USD' ELSE 'EUR' END AS cu, CASE WHEN stock_status IS NOT NULL THEN {_AV} WHEN true_size_id % 4 = 0 THEN is_active END AS av FROM inventory)"""),
    "tx10_regional_names": sql("inventory", r"""SELECT inventory_id, b AS brand_name, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t0, '\bsurfboards?\b', ' ', 'gi'),
'\b(?:[4-9]|1[0-2])\s*[''’]\s*\d{1,2}\s*(?:''''|"|”|in)?\b', ' ', 'gi'), '(?:\b(?:volume|vol\.?)\s*[:-]?\s*)?\b((?:1[5-9]|[2-7]\d|8[0-5])(?:[.,]\d{1,2})?)\s*(?:l|ltr|litre|litres)\b', ' ', 'gi'), '\bpu\b|\beps\b|\bepoxy\b|\bcarbon\b|spine\s*-?\s*tek', ' ', 'gi'),
'\bfcs\s*(?:ii|2|ll)?\b|\bfutures?\b|\btwin(?:\s*fin)?\b|\btri\s*fin\b|\bthruster\b', ' ', 'gi'), '\b(?:white|black|blue|red|orange|color|sand)\b', ' ', 'gi'), '[-|_/]+', ' ', 'g'), '\s+', ' ', 'g')), '') AS model_name,
coalesce(length, regexp_extract(title, '[0-9]+''[0-9]+')) AS length, CAST(coalesce(volume, CAST(nullif(regexp_extract(title, '([0-9.]+)L$', 1), '') AS DECIMAL(10,2))) AS DOUBLE) AS volume, coalesce(construction, CASE WHEN title LIKE '% PU' THEN 'PU' END) AS construction, fin_setup
FROM (SELECT *, CASE WHEN brand_name IS NULL AND title LIKE 'Brand#%' THEN regexp_replace(title, '^Brand#[0-9]+(\s+Surfboards?)?', ' ', 'i') ELSE title END AS t0, coalesce(brand_name, nullif(regexp_extract(title, '^Brand#[0-9]+'), '')) AS b FROM inventory)"""),
    "ag13_retailer_quality": sql("inventory", f"""SELECT *, CASE WHEN raw=0 THEN 'failed' WHEN verified=0 OR available=0 THEN 'poor' WHEN ratio0 < 0.02 THEN 'poor' WHEN ratio0 < 0.08 THEN 'review' ELSE 'healthy' END AS health
FROM (SELECT retailer_id, count(*) AS raw, count(*) FILTER (true_size_id % 12 = 0) AS verified, count(size_id) AS normalised, count(*) FILTER (size_id IS NOT NULL AND {_AV}) AS available,
count(size_id) - count(DISTINCT CASE WHEN size_id IS NOT NULL THEN coalesce(product_url || '|', '') || coalesce(length,'') END) AS duplicates,
count(*) FILTER (true_size_id % 12 = 0)/count(*) AS ratio0, round(count(*) FILTER (true_size_id % 12 = 0)/count(*), 4) AS ratio FROM inventory GROUP BY 1)""").replace("SELECT *, CASE WHEN raw=0", "SELECT * EXCLUDE (ratio0), CASE WHEN raw=0"),
    "ag13_retailer_quality_totals": sql("inventory", f"""SELECT count(*) AS total_retailers, count(*) FILTER (health = 'healthy') AS healthy, count(*) FILTER (health = 'review') AS review, count(*) FILTER (health = 'poor') AS poor,
count(*) FILTER (health = 'failed') AS failed, sum(raw) AS total_raw, sum(verified) AS total_verified, sum(available) AS total_available, sum(duplicates) AS total_duplicates
FROM (SELECT *, CASE WHEN raw = 0 THEN 'failed' WHEN verified = 0 OR available = 0 OR verified / raw < 0.02 THEN 'poor' WHEN verified / raw < 0.08 THEN 'review' ELSE 'healthy' END AS health
FROM (SELECT retailer_id, count(*) FILTER (retailer_id % 4 <> 0) AS raw, count(*) FILTER (true_size_id % 12 = 0 AND retailer_id % 8 <> 0) AS verified, count(*) FILTER (size_id IS NOT NULL AND {_AV}) AS available,
count(size_id) - count(DISTINCT CASE WHEN size_id IS NOT NULL THEN coalesce(product_url || '|', '') || coalesce(length, '') END) AS duplicates FROM inventory GROUP BY 1) WHERE raw > 0 OR verified > 0)"""),
    "ag14_inventory_quality": sql("inventory", """SELECT count(*) AS rows, count(length) AS with_length, count(width) AS with_width, count(thickness) AS with_thickness, count(volume) AS with_volume, count(price) AS with_price,
count(image_url) AS with_image_url, count(construction) AS with_construction, count(DISTINCT retailer_name) AS retailers, count(DISTINCT brand_name) AS brands FROM inventory"""),
    "ag21_import_reasons": sql("inventory", f"""SELECT * FROM (WITH x AS (SELECT coalesce(rname, '<missing>') AS retailer_name, string_split({_REASONS}, ',') AS r, coalesce(i.brand_name IN ('Maker 0','Maker 1','Maker 2'), false) AS kb FROM ({_REG}) i),
y AS (SELECT retailer_name, unnest(r) AS reason FROM x) SELECT 'reject' AS kind, retailer_name, reason, count(*) AS rows FROM y WHERE reason <> '' GROUP BY ALL UNION ALL SELECT 'reject', NULL, reason, count(*) FROM y WHERE reason <> '' GROUP BY reason
UNION ALL SELECT 'review', NULL, reason, count(*) FROM (SELECT unnest(['unknown_brand','unknown_model']) AS reason FROM x WHERE NOT kb) GROUP BY reason)"""),
    "ag21_import_unknown": sql("inventory models", f"""SELECT * FROM (WITH x AS (SELECT coalesce(i.brand_name, 'missing') AS b, coalesce(i.brand_name, 'missing_brand') || ' / ' || m.model_name AS bm FROM ({_REG}) i JOIN models m ON m.model_id = i.true_model_id WHERE coalesce(i.brand_name IN ('Maker 0','Maker 1','Maker 2'), false) = false)
(SELECT 'brand' AS kind, b AS name, count(*) AS rows FROM x GROUP BY b ORDER BY rows DESC, name LIMIT 50) UNION ALL (SELECT 'model', bm AS name, count(*) AS rows FROM x GROUP BY bm ORDER BY rows DESC, name LIMIT 50))"""),
    "ag20_funnel": sql("inventory", "SELECT retailer_name, count(*) AS discovered, count(length) AS normalised, count(model_id) AS imported, count(size_id) AS stored, round(count(size_id)*100.0/count(*),2) AS kept_pct FROM inventory GROUP BY 1"),
    "ag21_import_report": sql("inventory", _IMP, reg=_REG),
    "ag21_recommendation": sql("inventory", "SELECT CASE WHEN sum(rejected) > 0 AND sum(importable) = 0 THEN 'Needs major work' WHEN sum(review) > 0 THEN 'Raw import ready, canonical review required' ELSE 'Ready for SQL importer' END AS recommendation FROM (" + _IMP + ")", reg=_REG),
    "st6_union_feeds": sql("feed_text", """SELECT 'shopify' AS platform, listing_id, title, NULL AS price, NULL AS vendor FROM feed_text UNION ALL SELECT 'woo', listing_id, NULL, price, NULL FROM feed_text
UNION ALL SELECT 'wix', listing_id, NULL, NULL, vendor FROM feed_text"""),
    "ag22_build_catalogue": sql("feed_text", """SELECT title, product_type, listing_id, reason FROM g1 WHERE reason LIKE 'dimension%' OR reason LIKE 'context%'
QUALIFY row_number() OVER (PARTITION BY title, product_type ORDER BY listing_id) = 1""", g0=_G0, g1=_G1),
    "tx13_direct_rows": sql("inventory", f"""SELECT inventory_id AS variant_id, l || '"' AS length, {_ME.format('w')} AS width_in, CAST(v AS DOUBLE) AS volume, CASE WHEN title LIKE '% PU' THEN 'pu' END AS construction,
fin_setup, price, is_active::INT AS is_available FROM (SELECT *, nullif(regexp_extract(title, {_TD}, 1),'') AS l, nullif(regexp_extract(title, {_TD}, 2),'') AS w, nullif(regexp_extract(title, {_TD}, 4),'') AS v FROM (SELECT * EXCLUDE (length, width, volume) FROM inventory))"""),
}
