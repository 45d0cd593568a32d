"""Product feeds: envelopes, variants, conforming to a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

ENVELOPES = ("products", "items", "data", "results")

PRODUCT = (
    "id STRING, title STRING, handle STRING, vendor STRING, product_type STRING, "
    "images ARRAY<STRUCT<src: STRING>>, "
    "variants ARRAY<STRUCT<id: STRING, title: STRING, price: STRING, sku: STRING, available: BOOLEAN, attributes: MAP<STRING, STRING>>>"
)


def unwrap_feed(df: DataFrame, column: str, product: str = PRODUCT) -> DataFrame:
    """Feed documents (one JSON text per row) → one row per product.

    A document is a bare list or an object with one of the known list fields.
    """
    bare = F.from_json(column, f"array<struct<{product}>>")
    wrapped = F.from_json(column, ", ".join(f"{e} ARRAY<STRUCT<{product}>>" for e in ENVELOPES))
    keep = [c for c in df.columns if c != column]
    rows = df.withColumn("_w", wrapped).withColumn(
        "_p", F.when(F.ltrim(F.col(column)).startswith("["), bare).otherwise(F.coalesce(*[F.col(f"_w.{e}") for e in ENVELOPES])))
    return rows.select(*keep, F.explode("_p").alias("_p")).select(*keep, "_p.*")


def read_feed(spark: SparkSession, path: str, product: str = PRODUCT) -> DataFrame:
    """Feed files, one JSON document each, with the source file name.

    Each file is read whole by one task; a feed of many files spreads over the cluster.
    """
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    return unwrap_feed(docs, "value", product)


def flatten_variants(products: DataFrame) -> DataFrame:
    """One row per variant (a product without any keeps one row) with its first image."""
    keep = [c for c in products.columns if c not in ("images", "variants")]
    return products.select(*keep, F.try_element_at("images.src", F.lit(1)).alias("image_url"), F.explode_outer("variants").alias("v")).select(
        *keep, "image_url", F.col("v.id").alias("variant_id"), F.col("v.title").alias("variant_title"), F.col("v.price").alias("price"),
        F.col("v.sku").alias("sku"), F.coalesce("v.available", F.lit(False)).alias("available"), F.col("v.attributes").alias("attributes"))


def size_token(c: Column) -> Column:
    """``510`` or ``5-10`` → ``5'10``; other text stays."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[4-9][-_ ]?\d{1,2}$"), F.regexp_replace(t, r"^([4-9])[-_ ]?(\d{1,2})$", "$1'$2")).otherwise(t)


def flatten_attribute_variants(products: DataFrame) -> DataFrame:
    """Variants described by an attribute map → size, and the attributes as sorted text."""
    v = flatten_variants(products)
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", F.lower(e["key"]), e["value"])))
    lower = F.transform_keys("attributes", lambda k, _: F.lower(F.regexp_replace(k, "^(attribute_)?(pa_)?", "")))
    return v.withColumn("attribute_text", F.array_join(pairs, ";")).withColumn("size", size_token(F.element_at(lower, "size"))).drop("attributes")


def conform(df: DataFrame, schema: Ty.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the columns of ``schema``: cast, text cut to ``maxLength`` metadata, absent ones NULL.

    A missing required column fails before anything runs.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    out = []
    for f in schema.fields:
        c = F.lit(None).cast(f.dataType) if f.name not in df.columns else F.col(f.name).try_cast(f.dataType)
        if "maxLength" in f.metadata and f.name in df.columns:
            c = F.substring(c, 1, int(f.metadata["maxLength"]))
        out.append(c.alias(f.name))
    return df.select(*out)


def conform_report(df: DataFrame, schema: Ty.StructType) -> DataFrame:
    """One row: per column how many values were cut or could not be cast."""
    aggs = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        lost = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        cut = F.length(F.col(f.name).cast("string")) > int(f.metadata["maxLength"]) if "maxLength" in f.metadata else F.lit(False)
        aggs += [F.sum(lost.cast("long")).alias(f"{f.name}_lost"), F.coalesce(F.sum(cut.cast("long")), F.lit(0)).alias(f"{f.name}_cut")]
    return df.agg(*aggs)
