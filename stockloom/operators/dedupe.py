"""Duplicate removal and the grouped inventory index.

Keeping one row per key is ``row_number() = 1``: Spark plans a group limit before the
shuffle, so every task sends one row per key at most and a key that holds a third of all
rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.functions.fixed_values import IMAGE_PREFERRED_TERMS, IMAGE_REJECT_TERMS, IMAGE_TITLE_STOPS
from stockloom.functions.status import is_available_status


def _keep(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedupe_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order."""
    return _keep(df, keys, [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])


def dedupe_cheapest(df: DataFrame, keys: Sequence[Column | str], price: str, order: Sequence[str]) -> DataFrame:
    """Cheapest row per key; a priced row beats an unpriced one."""
    return _keep(df, keys, [F.col(price).asc_nulls_last(), *[F.col(o).asc_nulls_last() for o in order]])


def dedupe_best(df: DataFrame, keys: Sequence[Column | str], score: Column, order: Sequence[str]) -> DataFrame:
    """Highest score per key; the earlier row wins a tie."""
    return _keep(df, keys, [score.desc_nulls_last(), *[F.col(o).asc_nulls_last() for o in order]])


def row_quality(title: str, url: str, price: str, image: str, terms: Sequence[str], brands: Sequence[str]) -> Column:
    """Words in the title, plus points for board terms, brands, price and image."""
    words = F.size(F.filter(F.split(T.clean(title), r"\s+"), lambda w: w != ""))
    key = T.text_key(title)
    all_text = T.text_key(F.concat_ws(" ", F.col(title), F.col(url)))
    term = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: T.contains_key(key, t))
    brand = F.exists(F.array(*[F.lit(t) for t in brands]), lambda t: T.contains_key(all_text, t))
    return (
        words + F.when(term, 20).otherwise(0) + F.when(brand, 4).otherwise(0)
        + F.when(F.col(price).isNotNull(), 3).otherwise(0) + F.when(~T.blank(image), 2).otherwise(0)
    )


def dedupe_fill(df: DataFrame, keys: Sequence[str], order: Column, fill: Sequence[str]) -> DataFrame:
    """First row per key, its empty ``fill`` columns taken from the earliest row that has them."""
    rest = [c for c in df.columns if c not in (*keys, *fill)]
    first = [F.min_by(F.struct(*rest), order).alias("_first")]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fill]
    out = df.groupBy(*keys).agg(*first, *filled)
    return out.select(*keys, "_first.*", *fill)


def retailer_merges(retailers: DataFrame) -> DataFrame:
    """(retailer_id, keep_id) for every retailer, by equal name key; the smallest id is kept."""
    k = retailers.select("retailer_id", T.text_key("retailer_name").alias("_name"))
    keep = k.filter("_name <> ''").groupBy("_name").agg(F.min("retailer_id").alias("keep_id"))
    return k.join(keep, "_name", "left").select("retailer_id", F.coalesce("keep_id", "retailer_id").alias("keep_id"))


def duplicate_plan(inventory: DataFrame, retailers: DataFrame) -> DataFrame:
    """Every listing with its kept retailer and ``action`` keep or delete.

    Duplicates share retailer (after merging), url, title, length, volume and price.  A
    linked size, a linked model, an image and stock are preferred, in that order; then the
    smallest id.
    """
    inv = inventory.join(retailer_merges(retailers), "retailer_id", "left").withColumn("keep_id", F.coalesce("keep_id", "retailer_id"))
    title = F.when(T.blank("title"), F.col("normalised_title")).otherwise(F.col("title"))
    keys = {
        "_url": T.text_key("product_url"), "_title": T.text_key(title), "_len": T.text_key("length"),
        "_vol": F.coalesce(F.col("volume").cast("string"), F.lit("")), "_price": F.coalesce(F.col("price").cast("decimal(18,2)").cast("string"), F.lit("")),
    }
    inv = inv.withColumns(keys)
    stock = F.coalesce(F.col("stock_status").isNotNull() & is_available_status("stock_status"), F.lit(False))
    preference = [
        F.col("size_id").isNotNull().desc(), F.col("model_id").isNotNull().desc(), (~T.blank("image_url")).desc(), stock.desc(),
        F.col("inventory_id").asc(),
    ]
    keep = _keep(inv, ["keep_id", *keys], preference).select(F.col("inventory_id").alias("_k"))
    out = inv.join(keep, inv.inventory_id == keep._k, "left")
    return out.withColumn("action", F.when(F.col("_k").isNotNull(), "keep").otherwise("delete")).drop("_k", *keys)


def duplicate_summary(plan: DataFrame) -> DataFrame:
    """Per region: rows before, to delete, after, and rows moved to another retailer."""
    gone = F.sum((F.col("action") == "delete").cast("long"))
    return plan.groupBy("region_code").agg(
        F.count("*").alias("before"), gone.alias("deleted"), (F.count("*") - gone).alias("after"),
        F.sum((F.col("retailer_id") != F.col("keep_id")).cast("long")).alias("moved"),
    )


def merge_sources(sources: Sequence[tuple[DataFrame, int]], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of sources with a preference number each; the preferred source's row is kept."""
    out = None
    for df, preference in sources:
        part = df.withColumn("preference", F.lit(preference))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return dedupe_first(out, keys, ["preference", *order])


def title_tokens(title: Column | str) -> Column:
    """Words of three or more letters that tell a product's images apart."""
    words = F.split(F.regexp_replace(F.lower(T.clean(title)), "[^a-z0-9]+", "-"), "-")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*IMAGE_TITLE_STOPS))


def image_score(url: Column | str, title: Column | str) -> Column:
    """Uploads, the title's words, front and back views and large files above accessories and thumbnails."""
    u = F.lower(T.col(url))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: u.contains(w))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        pts(u.contains("/wp-content/uploads/"), 20) - pts(any_of(IMAGE_REJECT_TERMS), 80) + pts(any_of(IMAGE_PREFERRED_TERMS), 20)
        + 15 * F.size(F.filter(title_tokens(title), lambda w: u.contains(w))) + pts(u.contains("main"), 8) + pts(u.contains("front"), 6) + pts(u.contains("back"), 4)
        - pts(u.contains("346x461") | u.contains("300x300"), 5) + pts(u.contains("1536") | u.contains("2048"), 5))
    return F.when(T.blank(url), -1000).otherwise(score)


def rank_images(df: DataFrame, key: str, url: str, title: str, n: int = 1) -> DataFrame:
    """The ``n`` best image urls per key by score, then alphabetical."""
    scored = df.select(key, url, image_score(url, title).alias("image_score")).filter(~T.blank(url)).groupBy(key, url).agg(F.max("image_score").alias("image_score"))
    w = Window.partitionBy(key).orderBy(F.desc("image_score"), F.col(url))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def grouped_index(listings: DataFrame, keys: Sequence[str], listing_keys: Sequence[str], order: str) -> DataFrame:
    """One row per group: counts, price range, the cheapest listing and a sample.

    Listings are first reduced to their cheapest duplicate.  Members of a group are not
    nested into one row, since a group may hold any share of the table; ``group_items``
    returns them as rows with the same keys.
    """
    raw = listings.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.count("*").alias("raw_count"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    items = group_items(listings, keys, listing_keys, order)
    g = items.groupBy(*keys).agg(
        F.count("*").alias("available_count"), F.countDistinct("retailer_name").alias("retailer_count"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min(F.when(F.col("price").isNotNull(), F.struct("price", order, "retailer_name", "product_url"))).alias("_c"),
        F.min(F.struct(order, "title", "image_url")).alias("_s"),
    )
    return g.join(raw, same).select(
        *keys, "raw_count", "available_count", "retailer_count", "min_price", "max_price",
        F.col("_c.retailer_name").alias("cheapest_retailer"), F.col("_c.product_url").alias("cheapest_url"), F.col("_s.title").alias("title"),
    )


def group_items(listings: DataFrame, keys: Sequence[str], listing_keys: Sequence[str], order: str) -> DataFrame:
    return dedupe_cheapest(listings, [*keys, *listing_keys], "price", [order])


def brand_index(listings: DataFrame, brand: str, terms: Sequence[str], keys: Sequence[str], listing_keys: Sequence[str], order: str) -> DataFrame:
    """Grouped index of one brand's listings whose title names one of the model terms."""
    t = T.text_key("title")
    wanted = F.lit(False)
    for term in terms:
        wanted = wanted | T.contains_key(t, F.lit(term))
    return grouped_index(listings.filter((F.col("brand_name") == brand) & wanted), keys, listing_keys, order)
