"""Dedupe and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.functions.status import is_available_status
from stockloom.operators import dedupe as dd
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.plans.q_linkage import key

_K = ["retailer_id", "true_model_id"]
_TERMS, _BRANDS = ("widget", "used board"), ("brand 1", "brand 2")


def wn5(spark, sf):
    return dd.dedupe_first(fx.inventory(spark, sf), _K, ["inventory_id"]).select(*_K, "inventory_id", "title")


def wn6(spark, sf):
    inv = fx.inventory(spark, sf).withColumn("price", F.when(F.col("true_size_id") % 4 != 0, F.col("price")))
    return dd.dedupe_cheapest(inv, _K, "price", ["inventory_id"]).select(*_K, "inventory_id", "price")


def wn7(spark, sf):
    inv = fx.inventory(spark, sf)
    q = dd.row_quality("title", "product_url", "volume", "image_url", _TERMS, _BRANDS)
    return dd.dedupe_best(inv.withColumn("q", q), _K, F.col("q"), ["inventory_id"]).select(*_K, "inventory_id", "q")


def wn8(spark, sf):
    inv = fx.inventory(spark, sf).select(*_K, "inventory_id", "image_url", "stock_status", "normalised_title")
    return dd.dedupe_fill(inv, _K, F.col("inventory_id"), ["image_url", "stock_status", "normalised_title"])


def _dups(spark, sf):
    """Listings with copies: volume, length and url blanked so that rows coincide."""
    inv = fx.inventory(spark, sf)
    return inv.withColumns({"volume": F.lit(None).cast("decimal(10,2)"), "price": F.floor(F.col("price") / 1000).cast("double"), "title": F.concat("brand_name", F.lit(" x")),
                            "product_url": F.substring_index("product_url", "/", 3), "length": F.lit("5'1")})


def _shops(spark, sf):
    return fx.retailers(spark, sf).withColumn("retailer_name", F.concat(F.lit("Shop "), F.col("retailer_id") % 40))


def wn9(spark, sf):
    return dd.duplicate_plan(_dups(spark, sf), _shops(spark, sf)).select("inventory_id", "keep_id", "action")


def wn9s(spark, sf):
    return dd.duplicate_summary(dd.duplicate_plan(_dups(spark, sf), _shops(spark, sf)))


def wn10(spark, sf):
    p = fx.parts(spark, sf).select("brand_id", "model_name", "size_id", "list_price")
    a, b = p.filter(F.col("size_id") % 2 == 0), p.filter(F.col("size_id") % 2 == 1)
    return dd.merge_sources([(b, 1), (a, 2)], ["brand_id", "model_name"], ["size_id"]).select("brand_id", "model_name", "size_id", "preference")


_URLS = ("https://i.x/wp-content/uploads/red-front-1536.jpg", "https://i.x/Board-300x300.png", "https://i.x/fins/widget.svg", "https://i.x/b-main-back.webp?v=1", " ")


def wn11(spark, sf):
    u = F.element_at(F.array(*[F.lit(x) for x in _URLS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    li = fx.table(spark, sf, "lineitem").select("l_partkey", F.concat(u, F.when((F.col("l_orderkey") % 2 == 0) | (F.col("l_linenumber") % 5 == 4), "").otherwise("&z")).alias("url"))
    p = fx.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(" FCS")).alias("title"))
    return dd.rank_images(li.join(p, li.l_partkey == p.p_partkey).withColumnRenamed("l_partkey", "part"), "part", "url", "title").select("part", "url", "image_score")


_G = ["brand_name", "true_model_id", "length"]


def _live(spark, sf):
    return fx.inventory(spark, sf).filter(is_available_status("stock_status"))


def ag1(spark, sf):
    return dd.grouped_index(_live(spark, sf), _G, ["retailer_name", "product_url"], "inventory_id")


def ag1_items(spark, sf):
    return dd.group_items(_live(spark, sf), _G, ["retailer_name", "product_url"], "inventory_id").select(*_G, "inventory_id", "price")


def ag2(spark, sf):
    return dd.brand_index(_live(spark, sf), "Maker 1", ["widget", "red bolt"], _G, ["retailer_name", "product_url"], "inventory_id")


QUERIES = {
    "wn5_dedupe_first": wn5, "wn6_dedupe_cheapest": wn6, "wn7_dedupe_best": wn7, "wn8_dedupe_fill": wn8, "wn9_duplicate_plan": wn9,
    "wn9_duplicate_summary": wn9s, "wn10_merge_sources": wn10, "wn11_rank_images": wn11, "ag1_grouped_index": ag1, "ag1_group_items": ag1_items,
    "ag2_brand_index": ag2,
}

_LIVE = "(stock_status IS NULL OR lower(trim(stock_status)) IN ('in stock','instock','in_stock','available','true'))"
_DUPS = """SELECT inventory_id, region_code, retailer_id, size_id, model_id, image_url, stock_status, brand_name || ' x' AS title0, normalised_title,
'https://www.shop' || retailer_id || '.example.com' AS u0, product_url IS NULL AS nu, floor(floor(price)/1000) AS p FROM inventory"""
_PLAN = f"""SELECT d.inventory_id, d.region_code, d.retailer_id, m.keep_id, CASE WHEN row_number() OVER (PARTITION BY m.keep_id, CASE WHEN nu THEN '' ELSE u0 END, {key("coalesce(title0, normalised_title)")}, p
ORDER BY size_id IS NOT NULL DESC, model_id IS NOT NULL DESC, image_url IS NOT NULL DESC, coalesce(lower(trim(stock_status)) = 'in stock', false) DESC, inventory_id) = 1 THEN 'keep' ELSE 'delete' END AS action
FROM d JOIN (SELECT retailer_id, min(retailer_id) OVER (PARTITION BY retailer_id % 40) AS keep_id FROM retailers) m USING (retailer_id)"""


def _index(where: str) -> str:
    live = f"SELECT * FROM inventory WHERE {where}"
    items = "SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY brand_name, true_model_id, length, retailer_name, product_url ORDER BY price, inventory_id) = 1"
    return sql("inventory", """SELECT i.brand_name, i.true_model_id, i.length, (SELECT count(*) FROM live l WHERE l.brand_name IS NOT DISTINCT FROM i.brand_name AND l.true_model_id = i.true_model_id AND l.length IS NOT DISTINCT FROM i.length) AS raw_count,
count(*) AS available_count, count(DISTINCT retailer_name) AS retailer_count, min(price) AS min_price, max(price) AS max_price,
first(retailer_name ORDER BY price, inventory_id) AS cheapest_retailer, first(product_url ORDER BY price, inventory_id) AS cheapest_url, first(title ORDER BY inventory_id) AS title
FROM items i GROUP BY ALL""", live=live, items=items)


ORACLE = {
    "wn5_dedupe_first": sql("inventory", "SELECT retailer_id, true_model_id, inventory_id, title FROM inventory QUALIFY row_number() OVER (PARTITION BY retailer_id, true_model_id ORDER BY inventory_id) = 1"),
    "wn6_dedupe_cheapest": sql("inventory", """SELECT retailer_id, true_model_id, inventory_id, p AS price FROM (SELECT *, CASE WHEN true_size_id % 4 <> 0 THEN price END AS p FROM inventory)
QUALIFY row_number() OVER (PARTITION BY retailer_id, true_model_id ORDER BY p NULLS LAST, inventory_id) = 1"""),
    "wn7_dedupe_best": sql("inventory", f"""SELECT retailer_id, true_model_id, inventory_id, q FROM (SELECT *, len(regexp_split_to_array(trim(title), '\\s+'))
+ CASE WHEN contains(' '||{key('title')}||' ', ' widget ') OR contains(' '||{key('title')}||' ', ' used board ') THEN 20 ELSE 0 END
+ CASE WHEN contains(' '||{key('title')}||' ', ' brand 1 ') OR contains(' '||{key('title')}||' ', ' brand 2 ') THEN 4 ELSE 0 END
+ CASE WHEN volume IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN image_url IS NOT NULL THEN 2 ELSE 0 END AS q FROM inventory)
QUALIFY row_number() OVER (PARTITION BY retailer_id, true_model_id ORDER BY q DESC, inventory_id) = 1"""),
    "wn8_dedupe_fill": sql("inventory", """SELECT retailer_id, true_model_id, min(inventory_id) AS inventory_id, arg_min(image_url, inventory_id) FILTER (image_url IS NOT NULL) AS image_url,
arg_min(stock_status, inventory_id) FILTER (stock_status IS NOT NULL) AS stock_status, arg_min(normalised_title, inventory_id) FILTER (normalised_title IS NOT NULL) AS normalised_title FROM inventory GROUP BY ALL"""),
    "wn9_duplicate_plan": sql("inventory retailers", "SELECT inventory_id, keep_id, action FROM pl", d=_DUPS, pl=_PLAN),
    "wn9_duplicate_summary": sql("inventory retailers", """SELECT region_code, count(*) AS before, count(*) FILTER (action='delete') AS deleted, count(*) FILTER (action='keep') AS "after",
count(*) FILTER (retailer_id <> keep_id) AS moved FROM pl GROUP BY region_code""", d=_DUPS, pl=_PLAN),
    "wn10_merge_sources": sql("parts", """SELECT brand_id, model_name, size_id, CASE WHEN size_id % 2 = 1 THEN 1 ELSE 2 END AS preference FROM parts
QUALIFY row_number() OVER (PARTITION BY brand_id, model_name ORDER BY size_id % 2 DESC, size_id) = 1"""),
    "wn11_rank_images": f"""SELECT part, url, s AS image_score FROM (SELECT DISTINCT l_partkey AS part, url, CASE WHEN contains(url, 'uploads') THEN 20 + 6 + 5 ELSE 0 END + CASE WHEN contains(url, 'fins') THEN -80 ELSE 0 END + CASE WHEN contains(url, 'Board') THEN 20 - 5 ELSE 0 END
+ CASE WHEN contains(url, 'main') THEN 20 + 8 + 4 ELSE 0 END + 15 * len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 3 AND contains(lower(url), w))) AS s FROM (SELECT *, ({list(_URLS)})[l_linenumber % 5 + 1] || CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE '&z' END AS url FROM lineitem WHERE l_linenumber % 5 <> 4)
JOIN part ON p_partkey = l_partkey) QUALIFY row_number() OVER (PARTITION BY part ORDER BY s DESC, url) = 1""",
    "ag1_grouped_index": _index(_LIVE),
    "ag1_group_items": sql("inventory", f"""SELECT brand_name, true_model_id, length, inventory_id, price FROM inventory WHERE {_LIVE}
QUALIFY row_number() OVER (PARTITION BY brand_name, true_model_id, length, retailer_name, product_url ORDER BY price, inventory_id) = 1"""),
    "ag2_brand_index": _index(_LIVE + f" AND brand_name = 'Maker 1' AND (contains(' '||{key('title')}||' ', ' widget ') OR contains(' '||{key('title')}||' ', ' red bolt '))"),
}
