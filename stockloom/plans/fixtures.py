"""Views over the driver tables, as DataFrames and as SQL text for the oracle.

The driver tables stand in for a product catalogue: a part is one catalogue size, a
(brand, part name) pair is a model, a supplier is a retailer, a lineitem is a listing.
Each view exists twice, written independently: with DataFrame expressions, and as a SQL
CTE (``CTE``) that DuckDB runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))
SUPPORTED = ("Maker 0", "Maker 1", "Maker 2")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
WIDE_REGIONS = ("ASIA",)
NOW = "2024-01-31 00:00:00"
CHECK_NOW = "2002-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _brand_no(c: str = "p_brand"):
    return F.substring_index(F.col(c), "#", -1).cast("int")


def _sixteenths(whole: int, k):
    """Mixed fraction text in lowest terms."""
    parts = ["", " 1/16", " 1/8", " 3/16", " 1/4", " 5/16", " 3/8", " 7/16", " 1/2", " 9/16", " 5/8",
             " 11/16", " 3/4", " 13/16", " 7/8", " 15/16"]
    return F.concat(F.lit(str(whole)), F.element_at(F.array(*[F.lit(p) for p in parts]), (k + 1).cast("int")))


def aliases(spark, sf) -> DataFrame:
    """alias text → canonical brand."""
    p = table(spark, sf, "part").select("p_brand").distinct()
    n = (_brand_no() % 5).cast("int")
    return p.select(F.col("p_brand").alias("alias"), n.alias("brand_id"), F.concat(F.lit("Maker "), n).alias("brand_name"))


def brands(spark, sf) -> DataFrame:
    return aliases(spark, sf).select("brand_id", "brand_name").distinct()


def parts(spark, sf) -> DataFrame:
    """One row per part with its catalogue attributes; model_id by (brand, name)."""
    p = table(spark, sf, "part")
    n = (_brand_no() % 5).cast("int")
    inches = 60 + F.col("p_size") % 4
    k = F.col("p_partkey") % 16
    return p.select(
        F.col("p_partkey").alias("size_id"), n.alias("brand_id"), F.concat(F.lit("Maker "), n).alias("brand_name"),
        F.col("p_brand").alias("raw_brand"), F.col("p_name").alias("model_name"), inches.cast("int").alias("length_inches"),
        F.concat(F.floor(inches / 12).cast("string"), F.lit("'"), (inches % 12).cast("string")).alias("length"),
        _sixteenths(18, k).alias("width"), _sixteenths(2, k).alias("thickness"),
        (20 + (F.col("p_partkey") % 400).cast("decimal(10,2)") / 10).cast("decimal(10,2)").alias("volume"),
        F.col("p_type").alias("construction"), F.when(F.col("p_partkey") % 2 == 0, "FCS").otherwise("Futures").alias("fin_setup"),
        F.col("p_retailprice").alias("list_price"),
    )


def models(spark, sf) -> DataFrame:
    return parts(spark, sf).groupBy("brand_id", "brand_name", "model_name").agg(F.min("size_id").alias("model_id"))


def sizes(spark, sf) -> DataFrame:
    p = parts(spark, sf).drop("raw_brand", "list_price")
    m = models(spark, sf).select("brand_id", "model_name", "model_id")
    return p.join(m, ["brand_id", "model_name"])


def regions(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region_code"))


def retailers(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.join(regions(spark, sf), s.s_nationkey == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("retailer_id"), F.col("s_name").alias("retailer_name"), "country", "region_code",
        F.concat(F.lit("https://www.shop"), F.col("s_suppkey"), F.lit(".example.com/store")).alias("website"))


def inventory(spark, sf) -> DataFrame:
    """Listings: one row per lineitem."""
    li = table(spark, sf, "lineitem")
    z = sizes(spark, sf).withColumnRenamed("length", "size_length")
    r = retailers(spark, sf)
    raw = table(spark, sf, "part").select("p_partkey", "p_brand")
    j = (li.join(z, li.l_partkey == z.size_id).join(raw, li.l_partkey == raw.p_partkey)
           .join(r, li.l_suppkey == r.retailer_id))
    k = (F.col("l_orderkey") + F.col("l_linenumber")).cast("long")
    volume = (F.col("volume") + (((F.col("l_linenumber") + F.col("l_quantity")) % 5).cast("int") * 5 / 100).cast("decimal(10,2)")).cast("decimal(10,2)")
    shape = k % 4
    dims = F.concat_ws(" x ", F.concat(F.col("size_length"), F.lit('"')), F.concat(F.col("width"), F.lit('"')), F.concat(F.col("thickness"), F.lit('"')))
    title = (
        F.when(shape == 0, F.concat_ws(" ", "p_brand", "model_name", "size_length"))
        .when(shape == 1, F.concat(F.col("p_brand"), F.lit(" Surfboards - "), F.col("model_name"), F.lit(" - "), dims, F.lit(" - "), volume.cast("string"), F.lit("L")))
        .when(shape == 2, F.concat(F.col("p_brand"), F.lit(" "), F.initcap("model_name"), F.lit(" By Someone "), F.col("size_length"), F.lit(" PU")))
        .otherwise(F.concat(F.col("size_length"), F.lit(" "), F.col("model_name"), F.lit(" used board")))
    )
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd")).alias("inventory_id"),
        "retailer_id", "retailer_name", "country", "region_code",
        F.when(k % 7 != 0, F.col("brand_id")).alias("brand_id"),
        F.when(k % 7 != 0, F.col("brand_name")).alias("brand_name"),
        F.when(k % 3 == 0, F.col("model_id")).alias("model_id"),
        F.when(k % 6 == 0, F.col("size_id")).alias("size_id"),
        F.col("size_id").alias("true_size_id"), F.col("model_id").alias("true_model_id"),
        title.alias("title"), F.when(k % 5 == 0, F.col("model_name")).alias("normalised_title"),
        F.when(k % 11 != 0, F.concat(F.lit("https://www.shop"), F.col("retailer_id"), F.lit(".example.com/p/"), F.col("l_partkey"))).alias("product_url"),
        F.when(k % 3 != 1, F.concat(F.lit("https://img.example.com/"), F.col("l_partkey"), F.lit(".jpg"))).alias("image_url"),
        price.alias("price"),
        F.when(F.col("l_returnflag") == "R", "sold_out").when(F.col("l_returnflag") == "A", " In Stock ").alias("stock_status"),
        F.when(k % 4 != 3, F.col("size_length")).alias("length"),
        F.when(k % 5 != 1, F.col("width")).alias("width"), F.when(k % 5 != 1, F.col("thickness")).alias("thickness"),
        F.when(k % 8 != 5, volume).alias("volume"),
        F.when(k % 2 == 0, F.col("construction")).alias("construction"), "fin_setup",
        F.col("l_shipdate").alias("checked_at"), (F.col("l_linestatus") == "F").alias("is_active"),
    )


def direct(spark, sf) -> DataFrame:
    """Manufacturer-direct rows: one per (part, region) that was ever shipped."""
    li = table(spark, sf, "lineitem")
    s = table(spark, sf, "supplier").join(regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "region_code")
    g = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_partkey", "region_code").agg(
        F.count("*").alias("n"), F.max("l_shipdate").alias("scraped_at"), F.max("l_returnflag").alias("flag"),
        F.min(F.floor(F.col("l_extendedprice") / F.col("l_quantity"))).cast("double").alias("price"))
    z = sizes(spark, sf).withColumnRenamed("size_id", "true_size_id").withColumnRenamed("model_id", "true_model_id")
    k = F.col("true_size_id")
    return g.join(z, g.l_partkey == z.true_size_id).select(
        F.concat_ws("-", "true_size_id", "region_code").alias("direct_id"), "region_code", "brand_id", "brand_name", "model_name",
        F.when(k % 5 != 0, F.col("true_model_id")).alias("model_id"), F.when(k % 3 != 0, k).alias("size_id"), "true_size_id",
        F.when(k % 13 != 0, F.col("length")).alias("length"), "width", "thickness",
        (F.col("volume") + (F.col("n") % 3).cast("decimal(10,2)") * 5 / 100).cast("decimal(10,2)").alias("volume"),
        F.when(k % 7 != 0, F.col("construction")).alias("construction"), "fin_setup", "price", (F.col("flag") != "R").alias("is_available"),
        F.lit(True).alias("is_active"), "scraped_at", F.concat(F.lit("https://maker.example.com/p/"), k).alias("product_url"))


def targets(spark, sf) -> DataFrame:
    """Search requests: every catalogue size in every region."""
    return sizes(spark, sf).select(
        "*", F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region_code")
    ).withColumn("target_id", F.concat_ws("@", "size_id", "region_code"))


def snapshots(spark, sf) -> DataFrame:
    """Available listings by quarter, with the keys of the movement job."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "R")
    p = parts(spark, sf).select("size_id", "raw_brand", "brand_name", "model_name", "length_inches", "volume")
    s = table(spark, sf, "supplier").join(regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("l_partkey") % 3
    return (
        li.join(p, li.l_partkey == p.size_id).join(s, li.l_suppkey == F.col("s_suppkey"))
        .select(
            F.trunc("l_shipdate", "quarter").alias("snapshot_date"), "region_code",
            F.col("country").alias("retailer_name"), F.col("raw_brand").alias("product_url"),
            F.when(k == 1, "").when(k == 2, "5'2").alias("length"), "brand_name", "model_name",
            F.col("l_partkey").alias("inventory_id"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
            F.when(F.col("l_returnflag") == "A", " In Stock ").alias("stock_status"),
        )
    )


def job_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(
        "event_id", "ts", "user_id", region.alias("region"), F.col("event_type").alias("event"),
        F.concat(F.lit("svc"), F.col("user_id") % 4).alias("service"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("rows"), F.col("props").alias("payload"),
    )


def feed_text(spark, sf) -> DataFrame:
    """Raw listings made from document texts with price and size words appended."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    words = ["surfboard", "pyzel shortboard", "board bag", "surf lesson", "fins", "used fish", "epoxy", "fcs ii"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (i % 8 + 1).cast("int"))
    size = F.when(i % 5 == 0, "6'2 x 19 1/2 x 2 1/2 31.5L").when(i % 5 == 1, "5'11").when(i % 5 == 2, "28.5 litres").otherwise("")
    return d.select(
        i.alias("listing_id"), F.concat_ws(" ", word, size).alias("title"), F.col("text").alias("description"),
        F.when(i % 3 == 0, "surfboards").when(i % 3 == 1, "fins").alias("product_type"),
        F.concat(F.lit("https://shop.example.com/"), F.when(i % 4 == 0, "surfboards/").otherwise("p/"), i).alias("url"),
        F.when(i % 10 == 9, "POA").otherwise(F.concat(F.lit("$"), (100 + (i * 37) % 6000).cast("string"), F.lit(".50"))).alias("price"),
        F.when(i % 4 == 0, "6'2").alias("length"), F.when(i % 4 < 2, "19 1/2").alias("width"),
        F.lit(None).cast("string").alias("thickness"), F.when(i % 6 == 0, "31.5").alias("volume_litres"),
        F.col("source").alias("vendor"), "lang",
    )


_FRACTIONS = "['',' 1/16',' 1/8',' 3/16',' 1/4',' 5/16',' 3/8',' 7/16',' 1/2',' 9/16',' 5/8',' 11/16',' 3/4',' 13/16',' 7/8',' 15/16']"

#: name → (CTE body, names it needs)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "aliases": (
        "SELECT DISTINCT p_brand AS alias, CAST(split_part(p_brand,'#',2) AS INT) % 5 AS brand_id, "
        "'Maker ' || (CAST(split_part(p_brand,'#',2) AS INT) % 5) AS brand_name FROM part", ()),
    "brands": ("SELECT DISTINCT brand_id, brand_name FROM aliases", ("aliases",)),
    "parts": (
        "SELECT p_partkey AS size_id, CAST(split_part(p_brand,'#',2) AS INT) % 5 AS brand_id, "
        "'Maker ' || (CAST(split_part(p_brand,'#',2) AS INT) % 5) AS brand_name, p_brand AS raw_brand, "
        "p_name AS model_name, 60 + p_size % 4 AS length_inches, "
        "((60 + p_size % 4) // 12) || '''' || ((60 + p_size % 4) % 12) AS length, "
        f"'18' || ({_FRACTIONS})[p_partkey % 16 + 1] AS width, '2' || ({_FRACTIONS})[p_partkey % 16 + 1] AS thickness, "
        "CAST(20 + CAST(p_partkey % 400 AS DECIMAL(10,2)) / 10 AS DECIMAL(10,2)) AS volume, p_type AS construction, "
        "CASE WHEN p_partkey % 2 = 0 THEN 'FCS' ELSE 'Futures' END AS fin_setup, p_retailprice AS list_price FROM part", ()),
    "models": ("SELECT brand_id, brand_name, model_name, min(size_id) AS model_id FROM parts GROUP BY ALL", ("parts",)),
    "sizes": (
        "SELECT p.* EXCLUDE (raw_brand, list_price), m.model_id FROM parts p JOIN models m "
        "ON p.brand_id = m.brand_id AND p.model_name = m.model_name", ("parts", "models")),
    "regions": (
        "SELECT n_nationkey, n_name AS country, r_name AS region_code FROM nation JOIN region ON n_regionkey = r_regionkey", ()),
    "retailers": (
        "SELECT s_suppkey AS retailer_id, s_name AS retailer_name, country, region_code, "
        "'https://www.shop' || s_suppkey || '.example.com/store' AS website FROM supplier JOIN regions ON s_nationkey = n_nationkey",
        ("regions",)),
    "inv0": (
        "SELECT l.*, l_orderkey + l_linenumber AS k, z.*, r.*, p.p_brand, "
        "CAST(z.volume + CAST(CAST(l_linenumber + l_quantity AS INT) % 5 * 5 AS DECIMAL(10,2)) / 100 AS DECIMAL(10,2)) AS v "
        "FROM lineitem l JOIN sizes z ON l_partkey = z.size_id JOIN part p ON l_partkey = p.p_partkey "
        "JOIN retailers r ON l_suppkey = r.retailer_id", ("sizes", "retailers")),
    "inventory": (
        "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) || '-' || strftime(l_shipdate, '%Y%m%d') AS inventory_id, "
        "retailer_id, retailer_name, country, region_code, CASE WHEN k % 7 <> 0 THEN brand_id END AS brand_id, "
        "CASE WHEN k % 7 <> 0 THEN brand_name END AS brand_name, CASE WHEN k % 3 = 0 THEN model_id END AS model_id, "
        "CASE WHEN k % 6 = 0 THEN size_id END AS size_id, size_id AS true_size_id, model_id AS true_model_id, "
        "CASE k % 4 WHEN 0 THEN p_brand || ' ' || model_name || ' ' || length "
        "WHEN 1 THEN p_brand || ' Surfboards - ' || model_name || ' - ' || length || '\" x ' || width || '\" x ' || thickness || '\" - ' || v || 'L' "
        "WHEN 2 THEN p_brand || ' ' || list_aggregate(list_transform(string_split(model_name,' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' By Someone ' || length || ' PU' "
        "ELSE length || ' ' || model_name || ' used board' END AS title, "
        "CASE WHEN k % 5 = 0 THEN model_name END AS normalised_title, "
        "CASE WHEN k % 11 <> 0 THEN 'https://www.shop' || retailer_id || '.example.com/p/' || l_partkey END AS product_url, "
        "CASE WHEN k % 3 <> 1 THEN 'https://img.example.com/' || l_partkey || '.jpg' END AS image_url, "
        "floor(l_extendedprice / l_quantity) AS price, "
        "CASE l_returnflag WHEN 'R' THEN 'sold_out' WHEN 'A' THEN ' In Stock ' END AS stock_status, "
        "CASE WHEN k % 4 <> 3 THEN length END AS length, CASE WHEN k % 5 <> 1 THEN width END AS width, "
        "CASE WHEN k % 5 <> 1 THEN thickness END AS thickness, CASE WHEN k % 8 <> 5 THEN v END AS volume, "
        "CASE WHEN k % 2 = 0 THEN construction END AS construction, fin_setup, l_shipdate AS checked_at, "
        "l_linestatus = 'F' AS is_active FROM inv0", ("inv0",)),
    "snapshots": (
        "SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snapshot_date, region_code, country AS retailer_name, "
        "raw_brand AS product_url, CASE l_partkey % 3 WHEN 1 THEN '' WHEN 2 THEN '5''2' END AS length, brand_name, model_name, "
        "l_partkey AS inventory_id, floor(l_extendedprice / l_quantity) AS price, "
        "CASE WHEN l_returnflag = 'A' THEN ' In Stock ' END AS stock_status "
        "FROM lineitem JOIN parts ON l_partkey = size_id JOIN supplier ON l_suppkey = s_suppkey JOIN regions ON s_nationkey = n_nationkey "
        "WHERE l_returnflag <> 'R'", ("parts", "regions")),
    "direct": (
        "SELECT true_size_id || '-' || region_code AS direct_id, region_code, brand_id, brand_name, model_name, CASE WHEN true_size_id % 5 <> 0 THEN true_model_id END AS model_id, "
        "CASE WHEN true_size_id % 3 <> 0 THEN true_size_id END AS size_id, true_size_id, CASE WHEN true_size_id % 13 <> 0 THEN length END AS length, width, thickness, "
        "CAST(volume + CAST(n % 3 AS DECIMAL(10,2)) * 5 / 100 AS DECIMAL(10,2)) AS volume, CASE WHEN true_size_id % 7 <> 0 THEN construction END AS construction, fin_setup, price, "
        "flag <> 'R' AS is_available, true AS is_active, scraped_at, 'https://maker.example.com/p/' || true_size_id AS product_url FROM "
        "(SELECT l_partkey, region_code, count(*) AS n, max(l_shipdate) AS scraped_at, max(l_returnflag) AS flag, min(floor(l_extendedprice / l_quantity)) AS price "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN regions ON s_nationkey = n_nationkey GROUP BY ALL) "
        "JOIN (SELECT * EXCLUDE (size_id, model_id), size_id AS true_size_id, model_id AS true_model_id FROM sizes) ON l_partkey = true_size_id", ("sizes", "regions")),
    "targets": ("SELECT z.*, r_name AS region_code, size_id || '@' || r_name AS target_id FROM sizes z, region", ("sizes",)),
    "job_events": (
        "SELECT event_id, ts, user_id, (['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'])[user_id % 5 + 1] AS region, "
        "event_type AS event, 'svc' || (user_id % 4) AS service, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, "
        "value AS rows, props AS payload FROM events", ()),
    "feed_text": (
        "SELECT doc_id AS listing_id, "
        "(['surfboard','pyzel shortboard','board bag','surf lesson','fins','used fish','epoxy','fcs ii'])[doc_id % 8 + 1] || ' ' || "
        "CASE doc_id % 5 WHEN 0 THEN '6''2 x 19 1/2 x 2 1/2 31.5L' WHEN 1 THEN '5''11' WHEN 2 THEN '28.5 litres' ELSE '' END AS title, "
        "text AS description, CASE doc_id % 3 WHEN 0 THEN 'surfboards' WHEN 1 THEN 'fins' END AS product_type, "
        "'https://shop.example.com/' || CASE WHEN doc_id % 4 = 0 THEN 'surfboards/' ELSE 'p/' END || doc_id AS url, "
        "CASE WHEN doc_id % 10 = 9 THEN 'POA' ELSE '$' || (100 + (doc_id * 37) % 6000) || '.50' END AS price, "
        "CASE WHEN doc_id % 4 = 0 THEN '6''2' END AS length, CASE WHEN doc_id % 4 < 2 THEN '19 1/2' END AS width, "
        "CAST(NULL AS VARCHAR) AS thickness, CASE WHEN doc_id % 6 = 0 THEN '31.5' END AS volume_litres, "
        "source AS vendor, lang FROM documents", ()),
}


def sql(needs: str, body: str, **extra: str) -> str:
    """``WITH`` the named views (and what they need), then extra CTEs, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTE[name][1]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    ctes = [f"{n} AS ({CTE[n][0]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
