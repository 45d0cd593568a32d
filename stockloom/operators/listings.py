"""Listing feeds: classify, validate, normalise, report.

A verdict is built from columns that are computed once (``withColumn`` stages), never from
nested copies of the same expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from stockloom.functions import dims as D
from stockloom.functions import fixed_values as V
from stockloom.functions import text as T
from stockloom.functions.status import is_available_status
from stockloom.operators.dedupe import dedupe_first


def has_term(text: Column | str, terms: Sequence[str]) -> Column:
    """Any term in lower-case text, at letter and digit boundaries: one pass over the text."""
    return T.col(text).rlike("(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in terms) + ")(?![a-z0-9])")


def first_term(text: Column | str, terms: Sequence[str]) -> Column:
    """The first term of the list that occurs, else NULL."""
    return F.coalesce(*[F.when(has_term(text, [t]), F.lit(t)) for t in terms])


def _blob(*names: str) -> Column:
    parts = [F.lower(F.trim(F.col(n).cast("string"))) for n in names]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def feed_price(c: Column | str) -> Column:
    """Number of a feed price such as ``$1,234.50``; NULL when it is not one."""
    t = F.translate(F.trim(T.col(c).cast("string")), "$,", "")
    return F.when(t.rlike(r"^\d+(?:\.\d{1,2})?$"), t.try_cast("double"))


def price_check(price: Column) -> Column:
    return (
        F.when(price.isNull(), "missing_or_unparsed_price").when(price < 250, "price_too_low")
        .when(price > 5000, "price_too_high").otherwise("price_ok")
    )


_TEXT_FIELDS = ("title", "variant_title", "variant", "vendor", "product_type", "categories", "tags", "description", "short_description", "sku", "handle", "url", "product_url",
                "length", "width", "thickness", "volume_litres")
_TITLE_FIELDS = ("title", "variant_title", "variant", "handle", "product_url", "url")


def _words_of(c: Column, kind: DataType) -> Column:
    """Text of a column, of a list's items or of a structure's values; NULL when blank."""
    if isinstance(kind, MapType):
        c, kind = F.map_values(c), ArrayType(kind.valueType)
    if isinstance(kind, ArrayType):
        text = F.concat_ws(" ", F.transform(c, lambda x: _words_of(x, kind.elementType)))
    elif isinstance(kind, StructType):
        text = F.concat_ws(" ", *[_words_of(c[f.name], f.dataType) for f in kind])
    else:
        text = F.lower(F.trim(c.cast("string")))
    return F.when(text != "", text)


def _feed_blob(df: DataFrame, *names: str) -> Column:
    """Text of the named columns; a feed may lack some of them."""
    return F.concat_ws(" ", *[_words_of(F.col(n), df.schema[n].dataType) for n in names if n in df.columns])


def score_listings(df: DataFrame) -> DataFrame:
    """Add ``confidence``, ``is_board``, ``reasons`` and ``reject_reason``.

    Five rejections apply in order; then weighted evidence must reach 6 and one strong
    combination must hold.  Text columns that the feed lacks count as empty.
    """
    d = df.withColumn("_text", _feed_blob(df, *_TEXT_FIELDS)).withColumn("_title", _feed_blob(df, *_TITLE_FIELDS))
    d = d.withColumn("_cat", _feed_blob(df, "product_type", "categories")).withColumn("_price", feed_price("price"))
    url = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("url", "product_url") if c in df.columns], F.lit(""))
    d = d.withColumn("_filled", sum(((~T.blank(c)).cast("int") for c in ("length", "width", "thickness", "volume_litres")), F.lit(0)))
    flags = {
        "full_dimensions": F.col("_text").rlike(V.FULL_DIMENSION_RX), "length": F.col("_text").rlike(V.LENGTH_RX),
        "decimal_length": F.col("_text").rlike(V.DECIMAL_LENGTH_RX), "compact_length": F.col("_text").rlike(V.COMPACT_LENGTH_RX),
        "litres": F.col("_text").rlike(V.LITRE_RX), "structured_dimensions": F.col("_filled") >= 2,
        "board_type": has_term("_text", V.BOARD_TYPES), "category_board_signal": has_term("_cat", V.BOARD_CATEGORIES),
        "brand": has_term("_text", V.LISTING_BRANDS), "construction": has_term("_text", V.CONSTRUCTION_TERMS),
        "fin_system": has_term("_text", V.FIN_SYSTEMS), "url_board_hint": url.rlike(V.BOARD_URL_RX),
        "used": has_term("_text", V.USED_TERMS),
    }
    d = d.withColumns({f"_f_{k}": v for k, v in flags.items()})
    f = {k: F.col(f"_f_{k}") for k in flags}
    dear = F.coalesce(F.col("_price") >= 400, F.lit(False))
    any_length = f["length"] | f["decimal_length"] | f["compact_length"]
    used = f["used"] & dear & (f["brand"] | f["board_type"] | f["category_board_signal"]) & (any_length | f["full_dimensions"] | f["structured_dimensions"])
    d = d.withColumn("_f_used_board_listing", used)
    f["used_board_listing"] = F.col("_f_used_board_listing")
    # fixed values: evidence weights
    weights = {"full_dimensions": 4, "length": 2, "decimal_length": 2, "compact_length": 1, "litres": 3, "structured_dimensions": 4, "board_type": 3,
               "category_board_signal": 6, "brand": 3, "construction": 1, "fin_system": 1, "url_board_hint": 1, "used_board_listing": 2}
    board = f["board_type"] | f["category_board_signal"]
    strong = (
        (f["brand"] & (board | f["full_dimensions"] | f["litres"] | f["structured_dimensions"]))
        | ((f["full_dimensions"] | f["structured_dimensions"]) & (f["litres"] | board | f["brand"] | f["url_board_hint"]))
        | ((board | f["url_board_hint"]) & (any_length | f["litres"] | f["structured_dimensions"] | f["brand"] | f["construction"]))
        | (f["category_board_signal"] & dear)
        | (f["structured_dimensions"] & (f["fin_system"] | f["construction"] | f["url_board_hint"] | f["brand"]))
        | f["used_board_listing"]
    )
    accessory = (has_term("_title", V.FIN_ACCESSORY_TERMS) | has_term("_cat", V.FIN_ACCESSORY_TERMS)) & ~f["category_board_signal"]
    service = has_term("_title", V.SERVICE_TERMS) | has_term("_cat", V.SERVICE_TERMS)
    d = d.withColumn("_pc", price_check(F.col("_price"))).withColumn("_early", (
        F.when(F.col("_text") == "", "missing_text").when(has_term("_title", V.HARD_EXCLUDE_TERMS), "hard_excluded_product_type")
        .when(accessory, "fin_accessory_not_board").when(service, "service_or_rental_listing")
        .when(F.col("_pc").isin("price_too_low", "price_too_high"), F.col("_pc"))))
    total = sum((F.when(f[k], w).otherwise(0) for k, w in weights.items()), F.lit(0))
    live = F.col("_early").isNull()
    d = d.withColumn("confidence", F.when(live, total).otherwise(0)).withColumn("is_board", live & (F.col("confidence") >= 6) & strong)
    d = d.withColumn("reasons", F.when(live, F.array_compact(F.array(F.col("_pc"), *[F.when(f[k], F.lit(k)) for k in weights]))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("reject_reason", F.when(~live, F.col("_early")).when(~F.col("is_board"), "low_confidence_or_missing_board_identity"))
    return d.select(*df.columns, "confidence", "is_board", "reasons", "reject_reason")


def classify_candidates(df: DataFrame, terms: Sequence[str], brands: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Light classifier: terms 5, brand 2, length 3; accepted from 5 on."""
    d = df.withColumn("_text", _blob("title", "url"))
    d = d.withColumn("_x", has_term("_text", exclude)).withColumn("_t", has_term("_text", terms)).withColumn("_b", has_term("_text", brands))
    d = d.withColumn("_l", F.col("_text").rlike(r"\b[5-9]\s*(?:'|ft|’)\s*\d{0,2}"))
    score = F.when(F.col("_t"), 5).otherwise(0) + F.when(F.col("_b"), 2).otherwise(0) + F.when(F.col("_l"), 3).otherwise(0)
    d = d.withColumn("confidence", F.when(F.col("_x"), 0).otherwise(score)).withColumn("accepted", ~F.col("_x") & (F.col("confidence") >= 5))
    return d.drop("_text", "_x", "_t", "_b", "_l")


def guard_catalogue(df: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``reason``: hard negative, dimensions, context, soft negative, none."""
    d = df.withColumn("_all", _blob("title", "product_type", "url", "description")).withColumn("_ctx", _blob("product_type", "description"))
    d = d.withColumn("_dim_text", _blob("description", "title"))
    d = d.withColumn("_hard", first_term("_all", V.GUARD_HARD_NEGATIVE)).withColumn("_soft", first_term("_all", V.GUARD_SOFT_NEGATIVE))
    d = d.withColumn("_pos", first_term("_ctx", V.GUARD_POSITIVE)).withColumn("_url", first_term(F.lower(F.coalesce("url", F.lit(""))), V.GUARD_URL_POSITIVE))
    fields = ~T.blank("length") & (~T.blank("width") | ~T.blank("thickness") | ~T.blank("volume_litres"))
    context = F.col("_dim_text").rlike(V.GUARD_DIMENSION_RX) | (F.col("_dim_text").rlike(V.GUARD_LENGTH_RX) & F.col("_dim_text").rlike(V.GUARD_VOLUME_RX))
    signal = F.coalesce("_pos", "_url")
    reason = (
        F.when(F.col("_hard").isNotNull(), F.concat(F.lit("negative_term:"), "_hard")).when(fields | context, "dimension_signal")
        .when(signal.isNotNull(), F.concat(F.lit("context_signal:"), signal)).when(F.col("_soft").isNotNull(), F.concat(F.lit("negative_term:"), "_soft"))
        .otherwise("missing_surfboard_evidence"))
    d = d.withColumn("reason", reason).withColumn("accepted", F.col("reason").startswith("dimension") | F.col("reason").startswith("context"))
    return d.drop("_all", "_ctx", "_dim_text", "_hard", "_soft", "_pos", "_url")


def reject_reasons(df: DataFrame, region: str, currency: str) -> DataFrame:
    """Add ``reject_reasons``: every validation rule a regional row fails."""
    rules = [
        (T.blank("retailer_slug"), "missing_retailer_slug"), (T.blank("retailer_name"), "missing_retailer_name"),
        (T.clean("region_code") != region, "wrong_region"), (T.clean("currency") != currency, "wrong_currency"), (T.blank("title"), "missing_title"),
        (T.blank("product_url"), "missing_url"), (T.blank("price"), "missing_price"),
        (F.col("is_available").isNull() & T.blank("stock_status"), "missing_stock_status"),
        (T.blank("length") & T.blank("volume"), "missing_all_dimensions"),
    ]
    return df.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])))


def excluded_product_type(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    d = df.withColumn("_t", F.concat_ws(" ", *[F.col(f) for f in fields]))
    return d.withColumn("excluded_type", F.coalesce(*[F.when(F.col("_t").rlike("(?i)" + rx), F.lit(n)) for n, rx in V.EXCLUDED_PRODUCTS])).drop("_t")


def exclude_retailers(df: DataFrame, names: DataFrame, column: str = "retailer_name") -> DataFrame:
    """Rows whose retailer is not in ``names`` (column name), compared trimmed and lower-cased."""
    banned = names.select(F.lower(F.trim("name")).alias("_n")).distinct()
    return df.withColumn("_n", F.lower(T.clean(column))).join(banned, "_n", "left_anti").drop("_n")


def fallback_exclusions(inv: DataFrame) -> DataFrame:
    """Listings by primary reason and by every reason that keeps them out of the fallback."""
    r = F.array_compact(F.array(
        F.when(~F.coalesce("is_active", F.lit(False)), "inactive"), F.when(T.blank("product_url"), "missing_product_url"),
        F.when(~is_available_status("stock_status"), "unsupported_stock_status"), F.when(F.col("brand_id").isNull(), "missing_brand_id")))
    d = inv.select(r.alias("_r")).select(F.when(F.size("_r") == 0, F.array(F.lit("eligible"))).otherwise(F.col("_r")).alias("r"))
    e = d.select(F.posexplode_outer("r").alias("i", "reason"))
    return e.groupBy("reason").agg(F.sum((F.col("i") == 0).cast("long")).alias("primary_rows"), F.count("*").alias("all_rows"))


def _valid(c: Column, low: int, high: int) -> Column:
    return T.once(c, lambda x: F.when((x >= low) & (x <= high), x))


def fin_setup(text: Column | str) -> Column:
    t = T.text_key(text)
    # fixed values: fin words and their setup, first match decides
    pairs = (("futures", "Futures"), ("fcs", "FCS"), ("thruster", "Thruster"), ("quad", "Quad"), ("twin", "Twin"), ("single fin", "Single"))
    return F.coalesce(*[F.when(T.contains_key(t, F.lit(w)), F.lit(n)) for w, n in pairs])


def normalise_listings(df: DataFrame, aliases: Sequence[str]) -> DataFrame:
    """Typed listing: dimensions from fields when valid, else from the title; model key; fins.

    A stated width counts from 10 to 30 inches, a thickness from 1 to 5, and inches up to
    12 are allowed in a length.
    """
    d = df.withColumn("_td", D.title_dimensions("title"))
    ok = lambda x: x.rlike(r"^(?:[4-9]|1[0-2])'[0-9]{1,2}$") & (F.substring_index(x, "'", -1).try_cast("int") <= 12)
    flen = T.once(D.clean_dimension(F.regexp_replace("length", '"', "")), lambda x: F.when(ok(x), x))
    tlen = T.once(F.regexp_extract(D.clean_dimension("title"), r"(?:^|\s)((?:[4-9]|1[0-2])'\d{1,2})(?!\d)", 1), lambda x: F.when(x != "", x))
    d = d.withColumn("length", F.coalesce(flen, F.replace(F.replace(F.col("_td.length"), F.lit('"'), F.lit("")), F.lit(" "), F.lit("")), tlen))
    d = d.withColumn("width_in", F.coalesce(_valid(D.parse_measurement("width"), 10, 30), _valid(D.parse_measurement("_td.width"), 10, 30)))
    d = d.withColumn("thickness_in", F.coalesce(_valid(D.parse_measurement("thickness"), 1, 5), _valid(D.parse_measurement("_td.thickness"), 1, 5)))
    d = d.withColumn("volume", F.coalesce(D.parse_measurement("volume"), D.parse_measurement("_td.volume")))
    d = d.withColumn("_key", T.text_key("title"))
    brand = F.col("brand_name") if "brand_name" in df.columns else F.lit(None).cast("string")
    d = d.withColumn("construction", F.coalesce(F.try_element_at(T.construction_tokens("_key"), F.lit(1)), F.lower(F.trim("construction"))))
    return d.withColumn("model_key", T.tolerant_model_key(T.model_hint("title", brand, aliases))).drop("_td", "_key")


def _spaced(c: Column) -> Column:
    """Single spaces, NULL when nothing is left."""
    return T.once(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")), lambda x: F.when(x != "", x))


def regional_brand(stated: Column, title: Column, brands: Sequence[str]) -> Column:
    """The stated brand without "surfboards", else the longest known brand that the title names."""
    own = _spaced(F.regexp_replace(stated, r"(?i)\bsurfboards?\b", ""))
    named = lambda low: F.coalesce(*[F.when(low.rlike(rf"(?<![a-z0-9]){re.escape(b.lower())}(?![a-z0-9])"), F.lit(b)) for b in sorted(brands, key=lambda b: (-len(b), b))])
    return F.coalesce(own, T.once(F.lower(title), named)) if brands else own


def regional_model(title: Column, brand: Column) -> Column:
    """What is left of a title without brand, length, volume, construction, fins and colour."""
    quoted = F.concat(F.lit("\\Q"), brand, F.lit("\\E"))
    left = F.when(brand.isNull(), title).otherwise(F.regexp_replace(title, F.concat(F.lit("(?i)(?<![a-z0-9])"), quoted, F.lit(r"(?:\s+Surfboards?)?(?![a-z0-9])")), F.lit(" ")))
    for rx in V.REGIONAL_RESIDUE_RX:
        left = F.regexp_replace(left, rx, " ")
    return _spaced(F.regexp_replace(left, r"[-|_/]+", " "))


def _first_length(text: Column) -> Column:
    """Feet and inches of the first pattern whose first match lies between 4 and 12 feet, up to 12 inches."""
    found = []
    for rx in V.REGIONAL_LENGTH_RX:
        both = F.struct(*[F.regexp_extract(text, rx, i).try_cast("int").alias(name) for i, name in ((1, "feet"), (2, "inches"))])
        found.append(T.once(both, lambda x: F.when(x["feet"].between(4, 12) & x["inches"].between(0, 12), F.concat(x["feet"].cast("string"), F.lit("'"), x["inches"].cast("string")))))
    return F.coalesce(*found)


def _first_named(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(rx), F.lit(name)) for name, rx in patterns])


def normalise_regional(df: DataFrame, region: str, currency: str, brands: Sequence[str] = ()) -> DataFrame:
    """Regional rows: decimal price, currency as stated (else the region's), brand and model, dimensions
    from the texts where none are stated, stock text, availability and the importable flag.

    A row is importable with retailer slug and name, the region, title, url, price, the region's
    currency, a stock statement and a length or volume.  Columns that are absent count as empty.
    """
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    stated = lambda c: _spaced(col(c))
    title = F.coalesce(stated("title"), F.lit(""))
    text = F.concat_ws(" ", *[stated(c) for c in ("title", "brand_name", "vendor", "sku", "snippet")])
    brand = regional_brand(F.coalesce(stated("brand_name"), stated("vendor")), title, brands)
    flag = col("is_available").cast("boolean")
    known = F.coalesce(F.when(~T.blank("stock_status"), is_available_status("stock_status")), flag)
    d = df.withColumn("_text", text).withColumn("_title", title).withColumn("_brand", brand).withColumn("_known", known)
    d = d.withColumns({
        "price_amount": D.parse_price("price"), "currency": F.coalesce(stated("currency"), F.lit(currency)), "model_name": regional_model(F.col("_title"), F.col("_brand")),
        "length": F.coalesce(stated("length"), _first_length(F.col("_text"))),
        "volume": F.coalesce(D.parse_measurement("volume"), F.replace(F.nullif(F.regexp_extract("_text", V.REGIONAL_VOLUME_RX, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast(D.DEC)),
        "construction": F.coalesce(stated("construction"), _first_named(F.col("_text"), V.REGIONAL_CONSTRUCTION_RX)),
        "fin_setup": F.coalesce(stated("fin_setup"), _first_named(F.col("_text"), V.REGIONAL_FIN_RX)),
        "stock_text": F.when(F.col("_known"), "In Stock").when(~F.col("_known"), "Out of Stock").otherwise("Unknown"),
    }).withColumn("brand_name", F.col("_brand")).withColumn("is_available", F.col("_known"))
    needs = F.col("_known").isNotNull()
    for c in ("retailer_slug", "retailer_name", "title", "product_url"):
        needs = needs & stated(c).isNotNull()
    needs = needs & (F.col("region_code") == region) & F.col("price_amount").isNotNull() & (F.col("currency") == currency) & (F.col("length").isNotNull() | F.col("volume").isNotNull())
    return d.withColumn("importable", F.coalesce(needs, F.lit(False))).drop("_text", "_title", "_brand", "_known")


def assert_region(df: DataFrame, region: str) -> None:
    """Fail when any row belongs to another region."""
    other = df.filter(~F.col("region_code").eqNullSafe(F.lit(region))).groupBy("region_code").agg(F.count("*").alias("rows")).limit(5).collect()
    if other:
        raise ValueError(f"rows outside {region}: {[r.asDict() for r in other]}")


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """All platform feeds with a ``platform`` column; absent columns become NULL."""
    out = None
    for name, df in feeds.items():
        part = df.withColumn("platform", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def retailer_quality(raw: DataFrame, verified: DataFrame, normalised: DataFrame, key: str = "retailer_id") -> DataFrame:
    """Raw, verified, normalised, available and duplicate counts per retailer, with a band.

    A retailer of the verified feed that has no raw rows counts with raw 0; one that only the
    normalised feed has is no scraped retailer and is left out.
    """
    dup = normalised.groupBy(key, "_dup").agg(F.count("*").alias("n"), F.sum("available").alias("a"))
    n = dup.groupBy(key).agg(F.sum("n").alias("normalised"), F.sum("a").alias("available"), F.sum(F.col("n") - 1).alias("duplicates"))
    v = verified.filter(~T.blank(key)).groupBy(key).agg(F.count("*").alias("verified"))
    j = raw.groupBy(key).agg(F.count("*").alias("raw")).join(v, key, "full").join(n, key, "left")
    z = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("raw", "verified", "normalised", "available", "duplicates")}
    ratio = F.when(z["raw"] > 0, z["verified"] / z["raw"]).otherwise(F.lit(0.0))
    band = (
        F.when(z["raw"] == 0, "failed").when((z["verified"] == 0) | (z["available"] == 0), "poor").when(ratio < 0.02, "poor")
        .when(ratio < 0.08, "review").otherwise("healthy"))
    return j.select(key, *[c.alias(k) for k, c in z.items()], F.round(ratio, 4).alias("ratio"), band.alias("health"))


def retailer_quality_totals(report: DataFrame) -> DataFrame:
    """One row: retailers, retailers by band, and summed counts of ``retailer_quality``."""
    bands = [F.count_if(F.col("health") == b).alias(b) for b in ("healthy", "review", "poor", "failed")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("raw", "verified", "available", "duplicates")]
    return report.agg(F.count("*").alias("total_retailers"), *bands, *sums)


def inventory_quality(df: DataFrame) -> DataFrame:
    filled = lambda c: F.sum((~T.blank(c)).cast("long")).alias(f"with_{c}")
    return df.agg(F.count("*").alias("rows"), *[filled(c) for c in ("length", "width", "thickness", "volume", "price", "image_url", "construction")],
                  F.countDistinct("retailer_name").alias("retailers"), F.countDistinct("brand_name").alias("brands"))


def canonical_match(df: DataFrame, known_models: DataFrame) -> DataFrame:
    """Add ``brand_matched``, ``model_matched``, ``review_reasons`` and ``importable`` to rows with ``reject_reasons``."""
    m = known_models.select("brand_name", T.text_key("model_name").alias("_mk")).distinct()
    b = known_models.select(F.col("brand_name").alias("_b")).distinct()
    d = df.withColumn("_mk", T.text_key("model_name")).join(m.withColumn("_m", F.lit(True)), ["brand_name", "_mk"], "left")
    d = d.join(b, F.col("brand_name") == F.col("_b"), "left")
    d = d.withColumn("brand_matched", F.col("_b").isNotNull()).withColumn("model_matched", F.coalesce("_m", F.lit(False)))
    reasons = F.array_compact(F.array(F.when(~F.col("brand_matched"), "unknown_brand"), F.when(~F.col("model_matched"), "unknown_model")))
    return d.withColumn("review_reasons", reasons).withColumn("importable", F.size("reject_reasons") == 0).drop("_mk", "_m", "_b")


def import_report(df: DataFrame, known_models: DataFrame) -> DataFrame:
    """Counts per retailer of importable, matched and review rows; expects ``reject_reasons``."""
    d = canonical_match(df, known_models)
    ok, brand, model = F.col("importable"), F.col("brand_matched"), F.col("model_matched")
    n = lambda c, a: F.sum(c.cast("long")).alias(a)
    name = F.coalesce("retailer_name", F.lit("<missing>")).alias("retailer_name")
    return d.groupBy(name).agg(F.count("*").alias("rows"), n(ok, "importable"), n(~ok, "rejected"), n(ok & brand & model, "matched"),
                                          n(ok & ~(brand & model), "review"), n(~brand, "unknown_brand"), n(~model, "unknown_model"))


def import_reasons(df: DataFrame, known_models: DataFrame) -> DataFrame:
    """kind (reject or review), retailer_name, reason, rows: reject reasons per retailer and in all, review reasons in all (retailer NULL)."""
    d = canonical_match(df, known_models).withColumn("retailer_name", F.coalesce("retailer_name", F.lit("<missing>")))
    reject = d.select("retailer_name", F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    by_retailer = d.select("retailer_name", F.explode("reject_reasons").alias("reason")).groupBy("retailer_name", "reason").agg(F.count("*").alias("rows"))
    review = d.select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    nobody = F.lit(None).cast("string").alias("retailer_name")
    out = by_retailer.select(F.lit("reject").alias("kind"), "retailer_name", "reason", "rows")
    return out.unionByName(reject.select(F.lit("reject").alias("kind"), nobody, "reason", "rows")).unionByName(review.select(F.lit("review").alias("kind"), nobody, "reason", "rows"))


def import_unknown(df: DataFrame, known_models: DataFrame, n: int = 50) -> DataFrame:
    """kind (brand or model), name, rows: the ``n`` most frequent brands and models that the catalogue lacks."""
    d = canonical_match(df, known_models)
    said = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    brand = d.filter(~F.col("brand_matched")).groupBy(said("brand_name", "missing").alias("name")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "name").limit(n)
    both = F.concat_ws(" / ", said("brand_name", "missing_brand"), said("model_name", "missing_model"))
    model = d.filter(~F.col("model_matched")).groupBy(both.alias("name")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "name").limit(n)
    return brand.select(F.lit("brand").alias("kind"), "name", "rows").unionByName(model.select(F.lit("model").alias("kind"), "name", "rows"))


def recommendation(report: DataFrame) -> DataFrame:
    s = report.agg(F.sum("importable").alias("i"), F.sum("rejected").alias("r"), F.sum("review").alias("v"))
    return s.select(F.when((F.col("r") > 0) & (F.col("i") == 0), "Needs major work").when(F.col("v") > 0, "Raw import ready, canonical review required")
                    .otherwise("Ready for SQL importer").alias("recommendation"))


def funnel(discovered: DataFrame, normalised: DataFrame, imported: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows per retailer at every stage of the import."""
    out = None
    for name, df in (("discovered", discovered), ("normalised", normalised), ("imported", imported), ("stored", stored)):
        part = df.groupBy(key).agg(F.count("*").alias(name))
        out = part if out is None else out.join(part, key, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(key, *[z(c).alias(c) for c in ("discovered", "normalised", "imported", "stored")],
                      D.pct(z("stored"), z("discovered")).alias("kept_pct"))


def direct_rows(variants: DataFrame) -> DataFrame:
    """Manufacturer variants → dimensions, construction, fins, price and stock flag."""
    d = variants.withColumn("_td", D.title_dimensions("variant_title")).withColumn("_k", T.text_key(F.concat_ws(" ", "title", "variant_title")))
    d = d.withColumn("_tokens", T.construction_tokens("_k"))
    return d.select(
        "product_id", "variant_id", "title", F.col("_td.length").alias("length"), D.parse_measurement("_td.width").alias("width_in"),
        D.parse_measurement("_td.thickness").alias("thickness_in"), D.parse_measurement("_td.volume").alias("volume"),
        F.try_element_at("_tokens", F.lit(1)).alias("construction"), fin_setup("_k").alias("fin_setup"), D.parse_price("price").alias("price"),
        F.coalesce("available", F.lit(False)).alias("is_available"))


def build_catalogue(variants: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Catalogue rows from variants that pass the guard, one per composite key."""
    return dedupe_first(guard_catalogue(variants).filter("accepted"), list(keys), [order])
