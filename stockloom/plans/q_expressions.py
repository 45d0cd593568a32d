"""Queries for the column functions: each over all rows of a table, next to plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import dims as D
from stockloom.functions import status as S
from stockloom.functions import text as T
from stockloom.functions.fixed_values import AVAILABLE_STATUSES, FAMILY_SUFFIXES, KEY_COLOURS, MODEL_KEY_ALIASES
from stockloom.operators import health as H
from stockloom.plans import fixtures as fx
from stockloom.plans.fixtures import sql
from stockloom.plans.q_linkage import _TD


def pf3(spark, sf):
    return fx.inventory(spark, sf).select("inventory_id", S.is_available_status("stock_status").alias("available"))


def tx1(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.text_key("text")).alias("text_key"), F.md5(T.clean("text")).alias("clean_text"), F.length(T.text_key("source")).alias("source_length"))


def tx1m(spark, sf):
    return fx.inventory(spark, sf).select("inventory_id", T.model_key(F.concat("title", F.lit(" & ii 2.0 "), "model_id")).alias("model_key"))


def _odd_names(spark, sf):
    k = F.col("model_id")
    n = F.when(k % 5 == 0, F.concat("model_name", F.lit(" Red"))).when(k % 5 == 1, F.concat("model_name", F.lit(" by Some One"))).when(
        k % 5 == 2, F.concat("model_name", F.lit(" abc"), 10000 + k)).when(k % 5 == 3, F.concat(F.lit("The "), "model_name", F.lit(" Squash Tail"))).otherwise(F.lit("Fishbeard"))
    return fx.models(spark, sf).select("model_id", "model_name", n.alias("name"))


def tx2(spark, sf):
    return _odd_names(spark, sf).select("model_id", T.tolerant_model_key("name").alias("key"))


def tx3(spark, sf):
    return _odd_names(spark, sf).select("model_id", T.model_family("name").alias("family"))


def tx4(spark, sf):
    i = fx.inventory(spark, sf).select("inventory_id", "title", F.col("true_model_id").alias("mid"))
    m = fx.models(spark, sf).select(F.col("model_id").alias("mid"), "model_name")
    return i.join(m, "mid").select("inventory_id", T.contains_phrase("title", "model_name").alias("named"), T.contains_phrase("title", F.substring("model_name", 1, 3)).alias("part_named"))


def tx5(spark, sf):
    w = D.parse_measurement("width")
    return fx.sizes(spark, sf).select(
        "size_id", w.cast("double").alias("width"), D.parse_measurement(F.concat(F.regexp_replace(F.col("volume").cast("string"), r"\.", ","), F.lit("L"))).cast("double").alias("volume"),
        D.parse_measurement(F.concat("thickness", F.lit(" wide"))).cast("double").alias("bad"))


def tx6(spark, sf):
    k = F.col("size_id") % 4
    feet, inch = F.floor(F.col("length_inches") / 12).cast("string"), (F.col("length_inches") % 12).cast("string")
    text = F.when(k == 0, F.concat(feet, F.lit("'"), inch)).when(k == 1, F.concat(feet, F.lit("ft"), inch)).when(k == 2, F.concat(feet, F.lit('"'), inch)).otherwise(F.concat(feet, F.lit("'12")))
    return fx.sizes(spark, sf).select("size_id", D.length_inches(text).alias("inches"))


def tx7(spark, sf):
    d = D.title_dimensions("title")
    return fx.inventory(spark, sf).select("inventory_id", *[d[c].alias(f"t_{c}") for c in ("length", "width", "thickness", "volume")])


def tx8(spark, sf):
    dash = lambda c: F.regexp_replace(F.col(c), "[ /']", "-")
    slug = F.concat_ws("-", F.concat(F.lit("a-board"), F.lit("")), F.replace(F.col("length"), F.lit("'"), F.lit("")), dash("width"), dash("thickness"), F.concat(F.replace(F.col("volume").cast("decimal(10,1)").cast("string"), F.lit("."), F.lit("-")), F.lit("l")))
    pipe = F.concat_ws(" | ", "length", "width", "thickness", F.concat(F.col("volume").cast("decimal(10,1)").cast("string"), F.lit("L")))
    d = D.slug_dimensions(F.when(F.col("size_id") % 2 == 0, slug).otherwise(pipe))
    return fx.sizes(spark, sf).select("size_id", *[d[c].alias(c) for c in ("length", "width", "thickness", "volume")])


def tx11(spark, sf):
    i = fx.inventory(spark, sf).withColumn("tkey", T.text_key("title"))
    return i.select("inventory_id", T.construction_key(F.when(F.col("true_size_id") % 3 == 0, "I-Bolic").otherwise(F.col("construction"))).alias("construction_key"), F.array_join(T.construction_tokens("tkey"), "|").alias("tokens"))


def tx12(spark, sf):
    i = fx.inventory(spark, sf)
    return i.select("inventory_id", T.model_hint("title", "brand_name", fx.BRANDS).alias("hint"))


def tx14(spark, sf):
    k = F.col("l_orderkey") % 4
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, part = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.format_number(whole, 0)
    text = F.when(k == 0, F.concat(F.lit("$"), thousands, F.lit("."), part)).when(k == 1, F.concat(F.translate(thousands, ",", "."), F.lit(","), part, F.lit(" €"))).when(k == 2, F.concat(whole.cast("string"), F.lit(","), part)).otherwise(F.lit("POA"))
    return fx.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd")).alias("line"), D.parse_price(text).cast("double").alias("price"))


def tx18(spark, sf):
    g = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n"), F.count("*").alias("d"))
    low = F.when(F.col("l_suppkey") % 2 == 0, D.pct(F.col("n"), F.col("d")))
    return g.select("l_suppkey", D.pct(F.col("n"), F.col("d")).alias("pct"), D.pct(F.col("n"), F.lit(0)).alias("none"), D.clamp_pct(F.col("n") - 20.0).alias("clamped"), D.avg_pct(low, F.lit(50.0), F.lit(50.0)).alias("mean"))


def wn13(spark, sf):
    n = D.neighbour_lengths("length_inches")
    return fx.sizes(spark, sf).select("size_id", *[n[c].alias(c) for c in ("one_down", "one_up", "two_down", "two_up")])


def ob2(spark, sf):
    j = fx.inventory(spark, sf).groupBy("retailer_id").agg(F.max("checked_at").alias("latest"), F.count("*").alias("n"))
    st = H.freshness_status(F.when(F.col("retailer_id") % 9 != 0, F.col("latest")), F.lit(fx.CHECK_NOW).cast("timestamp"), 24 * 1200, F.when(F.col("n") % 3 == 0, "Failed").otherwise("success"), F.col("n") % 4)
    return j.select("retailer_id", st.alias("status"))


def _rates(spark, sf):
    return fx.inventory(spark, sf).groupBy("retailer_id").agg((F.count("model_id") * 250.0 / F.count("*")).alias("m"), (F.count("size_id") * 300.0 / F.count("*")).alias("f"))


def ob3(spark, sf):
    return _rates(spark, sf).select("retailer_id", S.search_health("m", F.when(F.col("retailer_id") % 7 != 0, F.col("f"))).alias("search"), H.coverage_status(F.col("f") - 30, F.col("retailer_id") % 5).alias("coverage"))


def ob4(spark, sf):
    c = [F.element_at(F.array(*[F.lit(x) for x in ("grey", "green", "yellow", "red", "odd")]), (F.col("l_suppkey") * k % 5 + 1).cast("int")) for k in (1, 2, 3)]
    return fx.table(spark, sf, "lineitem").select("l_suppkey").distinct().select("l_suppkey", *[x.alias(f"c{i}") for i, x in enumerate(c)]).select("l_suppkey", S.combine_status("c0", "c1").alias("two"), S.combine_status("c0", "c1", "c2").alias("three"))


QUERIES = {
    "pf3_available": pf3, "tx1_text_keys": tx1, "tx1_model_key": tx1m, "tx2_tolerant_model_key": tx2, "tx3_model_family": tx3,
    "tx4_contains_phrase": tx4, "tx5_parse_measurement": tx5, "tx6_length_inches": tx6, "tx7_title_dimensions": tx7, "tx8_slug_dimensions": tx8, "tx11_construction": tx11,
    "tx12_model_hint": tx12, "tx14_parse_price": tx14, "tx18_percentages": tx18, "wn13_neighbour_lengths": wn13, "ob2_freshness": ob2, "ob3_bands": ob3, "ob4_worst_status": ob4,
}

_MK = "trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(trim({0})), '&', ' and '), '([0-9])\\.0\\b', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g')), '\\bii\\b', '2', 'g'))"
_ODD = """SELECT model_id, CASE model_id % 5 WHEN 0 THEN model_name || ' Red' WHEN 1 THEN model_name || ' by Some One' WHEN 2 THEN model_name || ' abc' || (10000 + model_id) WHEN 3 THEN 'The ' || model_name || ' Squash Tail' ELSE 'Fishbeard' END AS name FROM models"""
_SIXTEENTH = "CASE WHEN contains({0}, '/') THEN CAST(split_part({0}, ' ', 1) AS DOUBLE) + CAST(split_part(split_part({0}, ' ', 2), '/', 1) AS DOUBLE) / CAST(split_part({0}, '/', 2) AS DOUBLE) ELSE CAST({0} AS DOUBLE) END"
_FEET = "(({0}) // 12) || '''' || (({0}) % 12)"
_RANK = "CASE {0} WHEN 'red' THEN 3 WHEN 'yellow' THEN 2 WHEN 'green' THEN 1 WHEN 'grey' THEN 0 ELSE -1 END"
_WORST = "CASE greatest({0}) WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' WHEN 1 THEN 'green' ELSE 'grey' END"
_ALIAS = "coalesce((MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in MODEL_KEY_ALIASES.items()) + "})[k], k)"

ORACLE = {
    "pf3_available": sql("inventory", f"SELECT inventory_id, stock_status IS NULL OR lower(trim(stock_status)) IN {AVAILABLE_STATUSES} AS available FROM inventory"),
    "tx1_text_keys": "SELECT doc_id, md5(trim(regexp_replace(replace(lower(coalesce(text,'')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS text_key, md5(trim(coalesce(text,''))) AS clean_text, length(coalesce(source,'')) AS source_length FROM documents",
    "tx1_model_key": sql("inventory", f"SELECT inventory_id, CASE WHEN model_id IS NULL THEN '' ELSE {_MK.format(chr(40) + 'title || ' + chr(39) + ' & ii 2.0 ' + chr(39) + ' || model_id' + chr(41))} END AS model_key FROM inventory"),
    "tx2_tolerant_model_key": sql("models", f"""SELECT model_id, {_ALIAS} AS key FROM (SELECT model_id, trim(regexp_replace(regexp_replace(regexp_replace({_MK.format('name')}, '\\s+by\\s+[a-z][a-z ]+$', ''), '\\s+(?:{"|".join(KEY_COLOURS)})$', ''), '\\s+[a-z]{{1,4}}[0-9]{{4,}}$', '')) AS k FROM odd)""", odd=_ODD),
    "tx3_model_family": sql("models", f"""SELECT model_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9'']+', ' ', 'g')), '^the ', ''), '(\\S)(?: (?:{"|".join(FAMILY_SUFFIXES)}))+$', '\\1') AS family FROM odd""", odd=_ODD),
    "tx4_contains_phrase": sql("inventory models", """SELECT inventory_id, contains(k, ' ' || mn || ' ') AS named, contains(k, ' ' || trim(mn[1:3]) || ' ') AS part_named FROM (SELECT i.inventory_id, m.model_name AS mn,
' ' || trim(regexp_replace(replace(lower(i.title), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' AS k FROM inventory i JOIN models m ON i.true_model_id = m.model_id)"""),
    "tx5_parse_measurement": sql("sizes", f"SELECT size_id, {_SIXTEENTH.format('width')} AS width, CAST(volume AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS bad FROM sizes"),
    "tx6_length_inches": sql("sizes", "SELECT size_id, CASE WHEN size_id % 4 < 3 THEN length_inches END AS inches FROM sizes"),
    "tx7_title_dimensions": sql("inventory", "SELECT inventory_id, " + ", ".join(f"nullif(regexp_extract(title, {_TD}, {i}), '')" + (" || '\"'" if i == 1 else "") + f" AS t_{c}" for i, c in enumerate(("length", "width", "thickness", "volume"), 1)) + " FROM inventory"),
    "tx8_slug_dimensions": sql("sizes", "SELECT size_id, length, width, thickness, CAST(CAST(volume AS DECIMAL(10,1)) AS VARCHAR) AS volume FROM sizes"),
    "tx11_construction": sql("inventory", """SELECT inventory_id, CASE WHEN true_size_id % 3 = 0 THEN 'ibolic' WHEN construction = 'STANDARD' THEN '' ELSE coalesce(lower(construction), '') END AS construction_key, CASE WHEN title LIKE '% PU' THEN 'pu' ELSE '' END AS tokens FROM inventory"""),
    "tx12_model_hint": sql("inventory", """SELECT inventory_id, CASE WHEN title LIKE '% Surfboards - %' THEN split_part(title, ' - ', 2)
ELSE trim(regexp_replace(regexp_replace(regexp_replace(title, '^Brand#[0-9]+\\s*', ''), '^[0-9]+''[0-9]+\\s*', ''), '\\bPU\\b.*$', '')) END AS hint FROM inventory"""),
    "tx14_parse_price": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) || '-' || strftime(l_shipdate, '%Y%m%d') AS line, CASE WHEN l_orderkey % 4 < 3 THEN floor(l_extendedprice * 100 + 0.5) / 100 END AS price FROM lineitem""",
    "tx18_percentages": """SELECT l_suppkey, p AS pct, 0.0 AS none, greatest(0.0, least(100.0, n - 20.0)) AS clamped, CASE WHEN l_suppkey % 2 = 0 THEN round((CAST(p AS DOUBLE) + 100) / 3, 2) ELSE 50.0 END AS mean FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS n, round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 2) AS p FROM lineitem GROUP BY 1)""",
    "wn13_neighbour_lengths": sql("sizes", "SELECT size_id, " + ", ".join(f"{_FEET.format(f'length_inches {d}')} AS {c}" for d, c in (("- 1", "one_down"), ("+ 1", "one_up"), ("- 2", "two_down"), ("+ 2", "two_up"))) + " FROM sizes"),
    "ob2_freshness": sql("inventory", f"""SELECT retailer_id, CASE WHEN l IS NULL THEN 'High' WHEN n % 3 = 0 AND a <= 28800 AND n % 4 >= 2 THEN 'High' WHEN n % 3 = 0 AND a <= 28800 THEN 'Warning' WHEN a > 28800 THEN 'High' ELSE 'Healthy' END AS status FROM (
SELECT retailer_id, count(*) AS n, CASE WHEN retailer_id % 9 <> 0 THEN max(checked_at) END AS l, (epoch(TIMESTAMP '{fx.CHECK_NOW}') - epoch(max(checked_at))) / 3600 AS a FROM inventory GROUP BY 1)"""),
    "ob3_bands": sql("inventory", """SELECT retailer_id, CASE WHEN retailer_id % 7 = 0 THEN 'yellow' WHEN m >= 85 AND f >= 60 THEN 'green' WHEN m >= 75 AND f >= 40 THEN 'yellow' ELSE 'red' END AS search,
CASE WHEN retailer_id % 5 = 0 THEN 'grey' WHEN f - 30 < 20 THEN 'green' WHEN f - 30 <= 40 THEN 'yellow' ELSE 'red' END AS coverage FROM (SELECT retailer_id, count(model_id) * 250.0 / count(*) AS m, count(size_id) * 300.0 / count(*) AS f FROM inventory GROUP BY 1)"""),
    "ob4_worst_status": f"""SELECT l_suppkey, {_WORST.format(', '.join(_RANK.format(c) for c in ('a', 'b')))} AS two, {_WORST.format(', '.join(_RANK.format(c) for c in ('a', 'b', 'c')))} AS three FROM (SELECT DISTINCT l_suppkey,
(['grey','green','yellow','red','odd'])[l_suppkey % 5 + 1] AS a, (['grey','green','yellow','red','odd'])[l_suppkey * 2 % 5 + 1] AS b, (['grey','green','yellow','red','odd'])[l_suppkey * 3 % 5 + 1] AS c FROM lineitem)""",
}
