"""Page tables (url, html) → products, cards, links, lines; expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.functions.dims import parse_price

_OFFER = "price STRING, priceCurrency STRING, availability STRING"
_NODE = "`@type` STRING, name STRING, url STRING, sku STRING, image STRING, offers STRING, item STRING"
_DOC = f"`@graph` ARRAY<STRUCT<{_NODE}>>, itemListElement ARRAY<STRUCT<{_NODE}>>, {_NODE}"


def visible_text(c: Column) -> Column:
    """Html without scripts, styles and tags, white space collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "&amp;", "&"), "&nbsp;|&#160;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def extract_jsonld_products(pages: DataFrame) -> DataFrame:
    """Product and ListItem nodes of every JSON-LD block: lists, ``@graph`` and item lists too."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    b = pages.select("url", F.posexplode(blocks).alias("block", "json"))
    text = F.trim("json")
    docs = F.when(text.startswith("["), F.from_json(text, f"array<struct<{_DOC}>>")).otherwise(F.array(F.from_json(text, _DOC)))
    d = b.select("url", "block", F.explode(docs).alias("d"))
    own = F.struct(*[F.col(f"d.`{n}`").alias(n) for n in ("@type", "name", "url", "sku", "image", "offers", "item")])
    empty = F.array().cast(f"array<struct<{_NODE}>>")
    nodes = F.concat(F.array(own), F.coalesce("d.`@graph`", empty), F.coalesce("d.itemListElement", empty))
    n = d.select(F.col("url").alias("page_url"), "block", F.posexplode(nodes).alias("pos", "n"))
    inner = F.from_json("n.item", _NODE)
    n = n.withColumn("p", F.when(F.col("n.`@type`") == "ListItem", F.coalesce(inner, F.col("n"))).otherwise(F.col("n")))
    n = n.filter(F.col("n.`@type`").isin("Product", "ListItem") & F.col("p.name").isNotNull())
    raw = F.col("p.offers")
    offer = F.when(F.ltrim(raw).startswith("["), F.try_element_at(F.from_json(raw, f"array<struct<{_OFFER}>>"), F.lit(1))).otherwise(F.from_json(raw, _OFFER))
    n = n.withColumn("o", offer)
    stock = F.lower("o.availability")
    return n.select(
        "page_url", "block", "pos", F.col("p.name").alias("title"), absolute_url(F.col("page_url"), F.col("p.url")).alias("product_url"), F.col("p.sku").alias("sku"),
        parse_price("o.price").alias("price"), F.col("o.priceCurrency").alias("currency"), F.when(stock.isNotNull(), stock.contains("instock")).alias("in_stock"))


def absolute_url(base: Column, href: Column) -> Column:
    """Relative link → absolute, without fragment."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return (
        F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h)).when(h == "", F.lit(None)).otherwise(F.concat_ws("/", folder, h)))


def extract_cards(pages: DataFrame) -> DataFrame:
    """Product cards: title, link, image, price and stock of every ``<article>`` block."""
    a = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), F.lit(1))).alias("pos", "card"))
    a = a.withColumn("text", visible_text(F.col("card")))
    some = lambda rx: F.regexp_extract("card", rx, 1)
    title = visible_text(some(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"))
    link, image = some(r"(?is)<a\b[^>]*href=[\"']([^\"']+)"), some(r"(?is)<img\b[^>]*src=[\"']([^\"']+)")
    price = F.regexp_extract("text", r"(?:[$€£]\s*|(?:AUD|EUR|USD)\s*)(\d[\d.,]*)", 1)
    sold = F.lower("text").rlike(r"sold out|out of stock|unavailable")
    return a.select("url", "pos", title.alias("title"), F.when(link != "", absolute_url(F.col("url"), link)).alias("product_url"), F.when(image != "", image).alias("image_url"),
                    parse_price(price).alias("price"), (~sold).alias("in_stock"), F.length("text").alias("text_length"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Every absolute link of a page, with its page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    return pages.select("url", F.explode(hrefs).alias("h")).select("url", absolute_url(F.col("url"), F.col("h")).alias("link")).filter("link IS NOT NULL")


def extract_category_links(pages: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Distinct links whose text holds one of the path markers."""
    low, hit = F.lower("link"), F.lit(False)
    for m in markers:
        hit = hit | low.contains(m.lower())
    return extract_links(pages).filter(hit).distinct()


def explode_size_options(pages: DataFrame) -> DataFrame:
    """One row per size option that is not sold out; a page without options keeps one row."""
    opts = F.regexp_extract_all("html", F.lit(r"(?is)<option\b([^>]*>[^<]*)</option>"), F.lit(1))
    live = F.filter(opts, lambda o: ~F.lower(o).rlike(r"disabled|sold out|out of stock"))
    names = F.transform(live, lambda o: F.trim(F.regexp_replace(o, r"^[^>]*>", "")))
    page_stock = ~F.lower("html").rlike(r"sold out|out of stock")
    p = pages.select("url", F.size(opts).alias("options"), names.alias("_n"), page_stock.alias("_s"))
    return p.select("url", "options", "_s", F.explode_outer("_n").alias("size")).select(
        "url", "size", F.when(F.col("options") > 0, F.col("size").isNotNull()).otherwise(F.col("_s")).alias("in_stock"))


def detect_platform(pages: DataFrame, markers: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Shop platform by marker strings; the order of ``markers`` is the precedence."""
    d = pages.withColumn("_h", F.lower("html"))
    out = F.lit("unknown")
    for name, words in reversed(list(markers)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.col("_h").contains(w)
        out = F.when(hit, name).otherwise(out)
    return d.withColumn("platform", out).withColumn("status", F.when(F.col("platform") == "unknown", "manual_review").otherwise(F.concat(F.lit("ready_"), "platform"))).drop("_h")


def detect_shells(pages: DataFrame, host: str) -> DataFrame:
    """Pages of other hosts that mention ``host`` or link to it."""
    own = F.lower(F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")))
    return pages.withColumn("is_shell", F.lower("html").contains(host) & ~own.contains(host))


def candidate_lines(pages: DataFrame, terms: Sequence[str], least: int = 4, most: int = 120) -> DataFrame:
    """Distinct text lines per page, 4 to 120 characters, that hold one of the terms."""
    t = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "\n")
    rows = pages.select("url", F.explode(F.split(t, r"[\r\n]+")).alias("_l")).select("url", F.trim(F.regexp_replace("_l", r"\s+", " ")).alias("line"))
    hit = F.lower("line").rlike("|".join(terms))
    return rows.filter(F.length("line").between(least, most) & hit).distinct()
