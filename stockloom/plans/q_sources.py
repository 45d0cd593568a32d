"""Feed, page and load queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.session import shared_folder
from stockloom.sources import feeds as fd
from stockloom.sources import pages as pg
from stockloom.sources import sinks as sk

_ARTICLE_LINK = ("/The", "/la", "ä")


def _pages(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", "url", "html")


def _feed(spark, sf):
    """One feed document per part, in five envelopes, with two variants (none for some)."""
    p = fx.parts(spark, sf)
    k = F.col("size_id")
    attrs = F.create_map(F.lit("attribute_pa_Size"), F.when(k % 2 == 0, "510").otherwise("6-1"), F.lit("Colour"), F.lit("red"))
    v = F.array(*[F.struct(F.concat_ws("-", k, F.lit(i)).alias("id"), F.concat("length", F.lit(f" v{i}")).alias("title"), F.concat(k, F.lit(f".{i}0")).alias("price"),
                           F.lit(None).cast("string").alias("sku"), (k % 3 == i).alias("available"), attrs.alias("attributes")) for i in (1, 2)])
    prod = F.struct(F.concat(F.lit("p"), k).alias("id"), F.col("model_name").alias("title"), F.lit("h").alias("handle"), F.col("brand_name").alias("vendor"), F.lit("board").alias("product_type"),
                    F.array(F.struct(F.concat(F.lit("https://i/"), k).alias("src"))).alias("images"), F.when(k % 7 != 0, v).alias("variants"))
    lst = F.array(prod)
    doc = F.when(k % 5 == 0, F.to_json(lst))
    for i, e in enumerate(fd.ENVELOPES, 1):
        doc = doc.when(k % 5 == i, F.to_json(F.struct(lst.alias(e))))
    return p.select("size_id", doc.alias("doc"))


def sc1(spark, sf):
    return fd.unwrap_feed(_feed(spark, sf), "doc").select("size_id", "id", "title", "vendor", F.coalesce(F.size("variants"), F.lit(0)).alias("n"))


def sc2(spark, sf):
    return fd.flatten_variants(fd.unwrap_feed(_feed(spark, sf), "doc")).select("size_id", "variant_id", "variant_title", "price", F.col("available").cast("int").alias("available"), "image_url")


def sc3(spark, sf):
    return fd.flatten_attribute_variants(fd.unwrap_feed(_feed(spark, sf), "doc")).filter("variant_id IS NOT NULL").select("variant_id", "size", "attribute_text")


def _ld(spark, sf):
    """Pages with JSON-LD made from parts: a node, a list, a graph or an item list."""
    k = F.col("size_id")
    node = F.concat(F.lit('{"@type":"Product","name":"'), "model_name", F.lit('","url":"/p/'), k, F.lit('","sku":"s'), k, F.lit('","offers":'),
                    F.when(k % 2 == 0, F.concat(F.lit('[{"price":"'), k, F.lit('.5","priceCurrency":"EUR","availability":"http://schema.org/InStock"},{"price":"1"}]'))).otherwise(
                        F.concat(F.lit('{"price":"'), k, F.lit('","priceCurrency":"EUR","availability":"http://schema.org/OutOfStock"}'))), F.lit("}"))
    doc = F.when(k % 4 == 0, node).when(k % 4 == 1, F.concat(F.lit("["), node, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"itemListElement":[{"@type":"ListItem","item":'), node, F.lit("}]}")))
    html = F.concat(F.lit('<html><script>var a=1</script><script type="application/ld+json">'), doc, F.lit("</script></html>"))
    return fx.parts(spark, sf).select(F.concat(F.lit("https://shop.example.com/c/"), k).alias("url"), html.alias("html"))


def sc4(spark, sf):
    return pg.extract_jsonld_products(_ld(spark, sf)).select("page_url", "title", "product_url", "sku", F.col("price").cast("double").alias("price"), "currency", F.col("in_stock").cast("int").alias("in_stock"))


def sc5(spark, sf):
    return pg.extract_cards(_pages(spark, sf)).select("url", "title", "product_url", F.col("price").cast("double").alias("price"), F.col("in_stock").cast("int").alias("in_stock"))


def sc6(spark, sf):
    return pg.extract_category_links(_pages(spark, sf), _ARTICLE_LINK)


def _opt(spark, sf):
    k = F.col("size_id")
    o = F.when(k % 3 == 0, F.concat(F.lit('<select><option value="1">'), "length", F.lit('</option><option value="2" disabled>6\'0</option><option>7\'0 - Sold Out</option></select>'))).when(
        k % 3 == 1, "<p>Sold out</p>").otherwise("<p>fine</p>")
    return fx.parts(spark, sf).select(F.concat(F.lit("https://s.example.com/"), k).alias("url"), o.alias("html"))


def sc15(spark, sf):
    return pg.explode_size_options(_opt(spark, sf)).select("url", "size", F.col("in_stock").cast("int").alias("in_stock"))


def pf14(spark, sf):
    return pg.detect_platform(_pages(spark, sf), [("bigcommerce", ["thnt"]), ("shopify", ["und", "ver"]), ("woocommerce", ["enß"])]).select("page_id", "platform", "status")


def pf18(spark, sf):
    return pg.detect_shells(_pages(spark, sf), "blog.").select("page_id", F.col("is_shell").cast("int").alias("is_shell"))


def pf23(spark, sf):
    return pg.candidate_lines(_pages(spark, sf), ["the", "que"])


def _small(spark, sf):
    return fx.inventory(spark, sf).select("inventory_id", "region_code", "retailer_id", "retailer_name", "product_url", "title", "length", "volume", "price", "is_active", "true_size_id")


def sc7(spark, sf):
    """Region replacement as rows: the scoped form of the partition overwrite."""
    i = _small(spark, sf)
    new = i.filter(F.col("region_code") == "ASIA").withColumn("price", F.col("price") + 1)
    return sk.replace_scope(i, new, ["region_code"]).groupBy("region_code").agg(F.count("*").alias("rows"), F.sum("price").alias("total"))


def sc7o(spark, sf):
    """A table partitioned by region in the shared folder, and one region of it loaded anew."""
    i = _small(spark, sf)
    path = f"{shared_folder(spark).rstrip('/')}/stockloom-{uuid.uuid4().hex}"
    i.write.partitionBy("region_code").parquet(path)
    sk.replace_region(i.filter("true_size_id % 2 = 0").withColumn("price", F.col("price") + 1), path, "ASIA")
    return spark.read.parquet(path).groupBy("region_code").agg(F.count("*").alias("rows"), F.sum("price").alias("total"))


def sc8(spark, sf):
    i = _small(spark, sf)
    new = i.filter((F.col("region_code") == "ASIA") & (F.col("true_size_id") % 2 == 0)).withColumn("price", F.col("price") + 1)
    return sk.replace_scope(i, new, ["region_code", "retailer_id"]).groupBy("region_code", "retailer_id").agg(F.count("*").alias("rows"), F.sum("price").alias("total"))


def _stored(spark, sf):
    d = fx.direct(spark, sf).select(F.col("direct_id").alias("inventory_id"), "region_code", "product_url", "length", "volume", "price", F.col("true_size_id").alias("k"))
    return d


def sc9(spark, sf):
    d = _stored(spark, sf)
    old = d.filter("k % 3 <> 0").withColumn("volume", F.when(F.col("k") % 5 != 0, F.col("volume")))
    return sk.upsert_inventory(old, d.withColumn("price", F.col("price") + 1), ["region_code", "product_url", "length"]).select("inventory_id", "product_url", "region_code", "price", "action")


def sc10(spark, sf):
    i = _small(spark, sf)
    return sk.deactivate_then_load(i, i.filter("region_code = 'ASIA' AND true_size_id % 2 = 0").withColumn("inventory_id", F.concat(F.lit("n"), "inventory_id")), "ASIA").groupBy(
        "region_code", F.col("is_active").cast("int").alias("is_active")).agg(F.count("*").alias("rows"))


def _roll(spark, sf):
    d = _stored(spark, sf)
    before = d.filter("k % 3 <> 0")
    after = d.withColumn("price", F.when(F.col("k") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return sk.rollback_plan(before, after, "inventory_id", ["price", "volume"])


def sc11(spark, sf):
    images, inserted = _roll(spark, sf)
    return images.select("inventory_id", "price", F.lit("restore").alias("what")).unionByName(inserted.select("inventory_id", F.lit(None).cast("double").alias("price"), F.lit("delete").alias("what")))


def sc12(spark, sf):
    return sk.report_rows(_small(spark, sf).filter("length IS NULL"), ["inventory_id"], 5000).select("inventory_id", "title")


def sc13(spark, sf):
    i = _small(spark, sf).select(F.concat(F.lit("B"), F.col("true_size_id") % 9).alias("brand"), F.lit("t").alias("title"), F.col("product_url").alias("source_url"), F.lit("low").alias("reason"),
                                 F.col("inventory_id").alias("note"), F.concat("inventory_id", F.lit("")).alias("rejected_at"), F.col("true_size_id").alias("k"))
    return sk.merge_reject_audit(i.filter("k % 2 = 0"), i.filter("k % 2 = 1 OR k % 3 = 0")).groupBy("brand", "source_url").agg(F.max("note").alias("note"), F.count("*").alias("n"))


_SCHEMA = Ty.StructType([Ty.StructField("inventory_id", Ty.StringType()), Ty.StructField("title", Ty.StringType(), True, {"maxLength": 20}), Ty.StructField("price", Ty.DecimalType(18, 2)),
                         Ty.StructField("length", Ty.IntegerType()), Ty.StructField("extra", Ty.StringType())])


def sc14(spark, sf):
    c = fd.conform(_small(spark, sf), _SCHEMA, ("inventory_id", "title"))
    return c.select("inventory_id", "title", F.col("price").cast("double").alias("price"), "length", "extra")


def sc14r(spark, sf):
    return fd.conform_report(_small(spark, sf), _SCHEMA)


QUERIES = {"sc1_unwrap_feed": sc1, "sc2_flatten_variants": sc2, "sc3_attribute_variants": sc3, "sc4_jsonld_products": sc4, "sc5_cards": sc5, "sc6_category_links": sc6, "sc15_size_options": sc15,
           "pf14_detect_platform": pf14, "pf18_detect_shells": pf18, "pf23_candidate_lines": pf23, "sc7_replace_region": sc7, "sc7_region_overwrite": sc7o, "sc8_replace_scope": sc8, "sc9_upsert": sc9, "sc10_deactivate_then_load": sc10,
           "sc11_rollback_plan": sc11, "sc12_report_rows": sc12, "sc13_reject_audit": sc13, "sc14_conform": sc14, "sc14_conform_report": sc14r}

_VIS = "trim(regexp_replace(replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_ST = "SELECT direct_id AS id, region_code, product_url, length, volume, price, true_size_id AS k FROM direct"
ORACLE = {
    "sc1_unwrap_feed": sql("parts", "SELECT size_id, 'p' || size_id AS id, model_name AS title, brand_name AS vendor, CASE WHEN size_id % 7 <> 0 THEN 2 ELSE 0 END AS n FROM parts"),
    "sc2_flatten_variants": sql("parts", """SELECT size_id, size_id || '-' || i AS variant_id, length || ' v' || i AS variant_title, size_id || '.' || i || '0' AS price, (size_id % 3 = i)::INT AS available, 'https://i/' || size_id AS image_url FROM parts, (VALUES (1),(2)) v(i) WHERE size_id % 7 <> 0
UNION ALL SELECT size_id, NULL, NULL, NULL, 0, 'https://i/' || size_id FROM parts WHERE size_id % 7 = 0"""),
    "sc3_attribute_variants": sql("parts", """SELECT size_id || '-' || i AS variant_id, CASE WHEN size_id % 2 = 0 THEN '5''10' ELSE '6''1' END AS size, 'attribute_pa_size=' || CASE WHEN size_id % 2 = 0 THEN '510' ELSE '6-1' END || ';colour=red' AS attribute_text FROM parts, (VALUES (1),(2)) v(i) WHERE size_id % 7 <> 0"""),
    "sc4_jsonld_products": sql("parts", """SELECT 'https://shop.example.com/c/' || size_id AS page_url, model_name AS title, 'https://shop.example.com/p/' || size_id AS product_url, 's' || size_id AS sku,
size_id + CASE WHEN size_id % 2 = 0 THEN 0.5 ELSE 0 END AS price, 'EUR' AS currency, (size_id % 2 = 0)::INT AS in_stock FROM parts"""),
    "sc5_cards": f"""SELECT url, {_VIS.format("regexp_extract(a, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")} AS title, nullif(CASE WHEN l = '' THEN '' WHEN l LIKE 'http%' THEN regexp_replace(l,'#.*$','') ELSE regexp_extract(url,'^(https?://[^/?#]+)',1) || regexp_replace(l,'#.*$','') END,'') AS product_url,
TRY_CAST(replace(regexp_extract({_VIS.format('a')}, '(?:[$€£]\\s*|(?:AUD|EUR|USD)\\s*)([0-9][0-9.,]*)', 1),',','') AS DOUBLE) AS price, (NOT regexp_matches(lower({_VIS.format('a')}), 'sold out|out of stock|unavailable'))::INT AS in_stock
FROM (SELECT url, a, regexp_extract(a, '(?is)<a\\b[^>]*href=["'']([^"'']+)', 1) AS l FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)) AS a FROM pages))""",
    "sc6_category_links": """SELECT DISTINCT url, regexp_extract(url,'^(https?://[^/?#]+)',1) || regexp_replace(h,'#.*$','') AS link FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS h FROM pages)
WHERE h LIKE '/%' AND (contains(lower(regexp_extract(url,'^(https?://[^/?#]+)',1) || h), '/the') OR contains(lower(regexp_extract(url,'^(https?://[^/?#]+)',1) || h), '/la') OR contains(lower(regexp_extract(url,'^(https?://[^/?#]+)',1) || h), 'ä'))""",
    "sc15_size_options": sql("parts", "SELECT 'https://s.example.com/' || size_id AS url, CASE WHEN size_id % 3 = 0 THEN length END AS size, CASE WHEN size_id % 3 = 1 THEN 0 ELSE 1 END AS in_stock FROM parts"),
    "pf14_detect_platform": """SELECT page_id, p AS platform, CASE WHEN p = 'unknown' THEN 'manual_review' ELSE 'ready_' || p END AS status FROM (SELECT page_id, CASE WHEN contains(lower(html),'thnt') THEN 'bigcommerce' WHEN contains(lower(html),'und') OR contains(lower(html),'ver') THEN 'shopify'
WHEN contains(lower(html),'enß') THEN 'woocommerce' ELSE 'unknown' END AS p FROM pages)""",
    "pf18_detect_shells": "SELECT page_id, (contains(lower(html),'blog.') AND NOT contains(regexp_extract(url,'^https?://([^/?#]+)',1),'blog.'))::INT AS is_shell FROM pages",
    "pf23_candidate_lines": """SELECT DISTINCT url, line FROM (SELECT url, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line FROM (SELECT url, unnest(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', E'\\n', 'g'), '(?s)<[^>]+>', E'\\n', 'g'), '[\\r\\n]+')) AS l FROM pages))
WHERE length(line) BETWEEN 4 AND 120 AND regexp_matches(lower(line), 'the|que')""",
    "sc7_replace_region": sql("inventory", "SELECT region_code, count(*) AS rows, sum(price) + CASE WHEN region_code = 'ASIA' THEN count(*) ELSE 0 END AS total FROM inventory GROUP BY 1"),
    "sc7_region_overwrite": sql("inventory", "SELECT region_code, count(*) AS rows, sum(price) + CASE WHEN region_code = 'ASIA' THEN count(*) ELSE 0 END AS total FROM inventory WHERE region_code <> 'ASIA' OR true_size_id % 2 = 0 GROUP BY 1"),
    "sc8_replace_scope": sql("inventory", """SELECT region_code, retailer_id, count(*) AS rows, sum(CASE WHEN region_code='ASIA' THEN price + 1 ELSE price END) AS total FROM inventory i WHERE region_code <> 'ASIA' OR true_size_id % 2 = 0
OR NOT EXISTS (SELECT 1 FROM inventory j WHERE j.region_code = 'ASIA' AND j.retailer_id = i.retailer_id AND j.true_size_id % 2 = 0) GROUP BY ALL"""),
    "sc9_upsert": sql("direct", """SELECT CASE WHEN k % 3 <> 0 THEN id END AS inventory_id, product_url, region_code, price + 1 AS price, CASE WHEN k % 3 <> 0 THEN 'update' ELSE 'insert' END AS action FROM st""", st=_ST),
    "sc10_deactivate_then_load": sql("inventory", """SELECT region_code, is_active, count(*) AS rows FROM (SELECT region_code, CASE WHEN region_code='ASIA' THEN 0 ELSE is_active::INT END AS is_active FROM inventory UNION ALL SELECT region_code, 1 FROM inventory WHERE region_code='ASIA' AND true_size_id % 2 = 0) GROUP BY ALL"""),
    "sc11_rollback_plan": sql("direct", "SELECT id AS inventory_id, price, 'restore' AS what FROM st WHERE k % 3 <> 0 AND k % 4 = 0 UNION ALL SELECT id, NULL, 'delete' FROM st WHERE k % 3 = 0", st=_ST),
    "sc12_report_rows": sql("inventory", "SELECT inventory_id, title FROM inventory WHERE length IS NULL ORDER BY inventory_id LIMIT 5000"),
    "sc13_reject_audit": sql("inventory", "SELECT 'B' || (true_size_id % 9) AS brand, product_url AS source_url, max(inventory_id) AS note, CASE WHEN product_url IS NULL THEN 1 ELSE 1 END AS n FROM inventory WHERE true_size_id % 2 = 0 OR true_size_id % 2 = 1 GROUP BY ALL"),
    "sc14_conform": sql("inventory", "SELECT inventory_id, left(title, 20) AS title, price, CAST(NULL AS INT) AS length, CAST(NULL AS VARCHAR) AS extra FROM inventory"),
    "sc14_conform_report": sql("inventory", "SELECT 0 AS inventory_id_lost, 0 AS inventory_id_cut, 0 AS title_lost, count(*) FILTER (length(title) > 20) AS title_cut, 0 AS price_lost, 0 AS price_cut, count(length) AS length_lost, 0 AS length_cut FROM inventory"),
}
