"""Retailers and dealers: keys, regions, matching, merging, scores, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text as T
from stockloom.operators.dedupe import dedupe_first
from stockloom.session import checkpointed

# fixed values: countries counted as one region
EU_COUNTRIES = (
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Ireland",
    "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden",
)
# fixed values: country names and their region
COUNTRY_REGIONS = (
    ("AU", ("Australia",)), ("ID", ("Indonesia",)), ("US", ("United States", "USA", "United States of America")), ("CA", ("Canada",)),
    ("UK", ("United Kingdom", "UK", "England", "Scotland", "Wales")), ("JP", ("Japan",)), ("NZ", ("New Zealand",)), ("BR", ("Brazil",)),
    ("ZA", ("South Africa",)), ("MX", ("Mexico",)), ("EU", EU_COUNTRIES),
)


def site_key(c: Column | str) -> Column:
    """Host without ``www.``; NULL when there is none."""
    raw = T.clean(c)
    url = F.when(raw.rlike("(?i)^https?://"), raw)
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.when(host != "", host)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(T.clean(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dealer_key(c: Column | str) -> Column:
    k = F.regexp_replace(T.text_key(c), r"\b(surfboards|surfboard|surf shop|surfshop|board store|boardstore)\b", " ")
    return F.trim(F.regexp_replace(k, r"\s+", " "))


def infer_region(country: Column | str, state: Column | str) -> Column:
    c, both = T.clean(country), F.lower(F.concat_ws(" ", T.clean(country), T.clean(state)))
    out = F.when(both.contains("puerto rico"), "PR").when(both.rlike("hawaii|o'ahu|maui|kauai"), "HI")
    for region, names in COUNTRY_REGIONS:
        out = out.when(c.isin(*names), region)
    return out.when(both.contains("europe"), "EU").otherwise("OTHER")


def dealer_rows(features: DataFrame, column: str = "feature") -> DataFrame:
    """GeoJSON features → dealer rows with coordinates."""
    f = F.from_json(column, "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<name: STRING, website: STRING, city: STRING, country: STRING, state: STRING>")
    d = features.withColumn("_f", f)
    return d.select(*[c for c in features.columns if c != column], F.trim("_f.properties.name").alias("dealer_name"), "_f.properties.website", "_f.properties.city", "_f.properties.country",
                    F.try_element_at("_f.geometry.coordinates", F.lit(1)).alias("lon"), F.try_element_at("_f.geometry.coordinates", F.lit(2)).alias("lat"),
                    infer_region("_f.properties.country", "_f.properties.state").alias("region_code")).filter(~T.blank("dealer_name"))


def match_retailer(dealers: DataFrame, retailers: DataFrame) -> DataFrame:
    """Known retailer of a dealer: by site, else by name key."""
    by_site = retailers.select(site_key("website").alias("_site"), "retailer_id").filter("_site IS NOT NULL").groupBy("_site").agg(F.min("retailer_id").alias("_a"))
    by_name = retailers.select(dealer_key("retailer_name").alias("_name"), "retailer_id").filter("_name <> ''").groupBy("_name").agg(F.min("retailer_id").alias("_b"))
    d = dealers.withColumn("_site", site_key("website")).withColumn("_name", dealer_key("dealer_name"))
    return d.join(by_site, "_site", "left").join(by_name, "_name", "left").withColumn("retailer_id", F.coalesce("_a", "_b")).drop("_site", "_name", "_a", "_b")


def _dealer_group() -> Column:
    return F.coalesce(F.concat(F.lit("site:"), site_key("website")), F.concat_ws("|", F.lit("name:"), dealer_key("dealer_name"), T.text_key("city"), T.text_key("country")))


def merge_dealers(dealers: DataFrame, order: str) -> DataFrame:
    """One dealer per site, or per name, city and country; first non-empty values, number of
    manufacturers.  The manufacturers themselves are rows of ``dealer_manufacturers``."""
    first = lambda c: F.min_by(c, F.when(~T.blank(c), F.col(order))).alias(c)
    return dealers.withColumn("dealer_group", _dealer_group()).groupBy("dealer_group").agg(
        *[first(c) for c in ("dealer_name", "website", "city", "country", "region_code")], F.countDistinct("manufacturer").alias("manufacturers"), F.count("*").alias("sources"))


def dealer_manufacturers(dealers: DataFrame) -> DataFrame:
    return dealers.select(_dealer_group().alias("dealer_group"), "manufacturer").filter("manufacturer IS NOT NULL").distinct()


def score_dealers(dealers: DataFrame, high: Sequence[str], future: Sequence[str]) -> DataFrame:
    """Status of a merged dealer (columns known, blocked, running, configured, enabled) and score 1–5.

    ``known`` tells whether a retailer matches; the other flags are that retailer's.  A dealer
    that no retailer matches is a candidate when it has a site, else left to manual review.
    """
    status = (
        F.when(F.col("blocked"), "Blocked").when(F.col("running"), "Already running").when(F.col("configured") & F.col("enabled"), "Configured but inactive")
        .when(F.col("configured"), "Known but disabled").when(~F.col("known") & ~T.blank("website"), "Candidate").otherwise("Manual review"))
    hi = F.coalesce(F.col("region_code").isin(*high), F.lit(False))
    fu = F.coalesce(F.col("region_code").isin(*future), F.lit(False))
    base = (
        F.lit(1) + F.when(hi, 2).when(fu, 1).otherwise(0) + (F.col("manufacturers") >= 2).cast("int") + (~T.blank("website")).cast("int")
        - F.coalesce((F.col("dealer_type") == "distributor").cast("int"), F.lit(0)))
    d = dealers.withColumn("status", status)
    s = F.col("status")
    return d.withColumn("score", F.when(s == "Blocked", 1).when(s == "Already running", 5).when(s == "Known but disabled", F.when(hi, 4).otherwise(3))
                        .when(s == "Configured but inactive", 4).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), base))))


def dealer_summary(dealers: DataFrame, links: DataFrame, top: int = 5) -> DataFrame:
    """Dealers per region with the ``top`` manufacturers by dealers, one row per (region, rank)."""
    per = dealers.select("dealer_group", "region_code").join(links, "dealer_group").groupBy("region_code", "manufacturer").agg(F.count("*").alias("dealers"))
    w = Window.partitionBy("region_code").orderBy(F.desc("dealers"), "manufacturer")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# fixed values: priority of a coverage status before the candidate's own priority is taken off
COVERAGE_PRIORITIES = {
    "ready_bigcommerce": 88, "ready_shopify": 70, "ready_woocommerce": 66, "ready_neto_maropost": 63, "ready_opencart": 58, "ready_custom_high_value": 74,
    "duplicate_shell": 0, "manual_review": 40, "blocked": 15, "catalogue_only": 10, "no_online_boards": 8, "shaper_only": 5, "distributor_only": 5,
    "closed_or_redirected": 0, "unsupported": 0,
}
OPEN_STATUSES = ("Candidate", "Known but disabled", "Configured but inactive")


def dealer_status_counts(scored: DataFrame, regions: Sequence[str], high: int = 4) -> DataFrame:
    """One row per listed region: dealers, and those running, candidates, open ones of a high score, for manual review.

    ``scored`` comes from ``score_dealers``; a region without dealers has zeros.
    """
    s = F.col("status")
    counts = scored.groupBy("region_code").agg(
        F.count("*").alias("total_discovered"), F.count_if(s == "Already running").alias("already_running"), F.count_if(s == "Candidate").alias("candidates"),
        F.count_if(s.isin(*OPEN_STATUSES) & (F.col("score") >= high)).alias("high_priority"), F.count_if(s == "Manual review").alias("manual_review"))
    listed = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in regions])).alias("region_code"))
    return listed.join(counts, "region_code", "left").fillna(0)


def top_candidates(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per region the ``n`` best open dealers: by score, manufacturers, name."""
    w = Window.partitionBy("region_code").orderBy(F.desc("score"), F.desc("manufacturers"), "dealer_name", "dealer_group")
    return scored.filter(F.col("status").isin(*OPEN_STATUSES)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def manufacturer_regions(dealers: DataFrame, links: DataFrame) -> DataFrame:
    """Dealers of every manufacturer by region, and its total."""
    per = dealers.select("dealer_group", "region_code").join(links, "dealer_group").groupBy("manufacturer", "region_code").agg(F.count("*").alias("dealers"))
    total = per.groupBy("manufacturer").agg(F.sum("dealers").alias("dealer_count"))
    return per.join(total, "manufacturer")


def _default_status() -> Column:
    """Status of a candidate that neither an override nor a discovery result decides; first rule wins."""
    said = lambda *words: F.coalesce(*[F.when(F.col("_why").contains(w), True) for w in words], F.lit(False))
    typed = lambda *names: F.coalesce(F.exists("retailer_types", lambda t: F.lower(t).isin(*names)), F.lit(False))
    p, g, d = F.col("_found_platform"), F.col("_governance"), F.col("_detection")
    return (
        F.when(F.col("_running"), "already_running").when(typed("shaper_direct", "brand_retail"), "shaper_only").when(typed("distributor"), "distributor_only")
        .when(said("domain unavailable", "domain for sale"), "closed_or_redirected").when(said("no online surfboard inventory"), "no_online_boards")
        .when(said("distributor"), "distributor_only").when(said("shaper"), "shaper_only")
        .when(said("clothing", "accessory", "not suitable", "does not sell hardboard", "not a surfboard retailer"), "unsupported")
        .when(g == "stock_status_review", "manual_review").when(d == "blocked", "blocked").when(p == "shopify", "ready_shopify").when(p == "woocommerce", "ready_woocommerce")
        .when(p == "bigcommerce", "ready_bigcommerce").when(p == "neto_maropost", "ready_neto_maropost").when(p.isin("opencart", "ecwid"), "ready_opencart")
        .when(p.isin("magento", "squarespace"), "ready_custom_high_value").when(d.isin("failed", "needs_review") | g.isin("endpoint_review", "parser_review"), "manual_review").otherwise("unsupported"))


def coverage_candidates(candidates: DataFrame, overrides: DataFrame, discovery: DataFrame, running: DataFrame, detection: DataFrame) -> DataFrame:
    """Status, platform and priority (0 to 99) per candidate: override, else discovery result, else a ladder
    over what runs, its governance and what was detected.

    All tables meet by site and have one row a site.  ``candidates``: website, priority (1 is best),
    retailer_types; ``overrides``: status, platform, running, priority_score; ``discovery``: status,
    platform, priority_score; ``running``: enabled, governance_reason, governance_status, platform,
    available; ``detection``: platform, status.
    """
    def side(df: DataFrame, **columns: str) -> DataFrame:
        return df.select(site_key("website").alias("_s"), *[F.col(c).alias(name) for name, c in columns.items()]).filter("_s IS NOT NULL")

    low = lambda c: F.lower(T.clean(c))
    said = lambda c: F.when(~T.blank(c), F.trim(F.col(c)))
    j = candidates.withColumn("_s", site_key("website"))
    j = j.join(side(overrides, _o="status", _op="platform", _or="running", _os="priority_score"), "_s", "left")
    j = j.join(side(discovery, _d="status", _dp="platform", _ds="priority_score"), "_s", "left")
    j = j.join(side(running, _on="enabled", _r="governance_reason", _g="governance_status", _rp="platform", _n="available"), "_s", "left")
    j = j.join(side(detection, _tp="platform", _t="status"), "_s", "left")
    j = j.withColumns({"_running": F.coalesce("_on", F.lit(False)), "_why": low("_r"), "_governance": low("_g"), "_detection": low("_t"), "_found_platform": F.lower(F.coalesce(said("_tp"), said("_rp"), F.lit("")))})
    j = j.withColumn("status", F.coalesce(said("_o"), said("_d"), _default_status()))
    platform = F.lower(F.coalesce(said("_op"), said("_dp"), said("_tp"), said("_rp"), F.lit("unknown")))
    j = j.withColumn("platform", F.when(platform == "ecwid", "opencart").otherwise(platform)).withColumn("already_running", F.coalesce("_or", "_running"))
    base = F.create_map(*[F.lit(x) for kv in COVERAGE_PRIORITIES.items() for x in kv])
    own = F.greatest(F.lit(0), F.coalesce(F.element_at(base, F.col("status")), F.lit(0)) - (F.coalesce("priority", F.lit(3)) - 1) * 3)
    default = (
        F.when(F.col("status") == "already_running", F.least(F.lit(99), F.lit(40) + F.floor(F.coalesce("_n", F.lit(0)) / 80)))
        .when(F.col("status") == "parked_live", 18).when(F.col("status") == "parked_manual", 5).otherwise(own))
    score = F.coalesce("_os", F.when(F.col("_ds") != 0, F.col("_ds")), default).cast("int")
    decided = F.when(said("_o").isNotNull(), "override").when(said("_d").isNotNull(), "discovery").otherwise("default")
    return j.withColumn("priority_score", score).withColumn("decided_by", decided).drop(*[c for c in j.columns if c.startswith("_")])


def activation_status(df: DataFrame, country: str, supported: Sequence[str]) -> DataFrame:
    """Six ordered rules; ``status`` and ``reason``."""
    p = F.lower(T.clean("platform"))
    foreign = ~T.blank("country") & (F.lower(T.clean("country")) != country.lower())
    reason = (
        F.when(foreign, "foreign_country").when(F.coalesce("is_manufacturer", F.lit(False)), "manufacturer_or_brand").when(F.col("hardboards") == F.lit(False), "not_hardboard_retailer")
        .when(p == "", "platform_unknown").when(~p.isin(*supported), F.concat(F.lit("unsupported_platform_"), p)).when(T.blank("website"), "missing_website").otherwise("supported_retailer"))
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "supported_retailer", "active").otherwise("excluded"))


def build_targets(retailers: DataFrame, detections: DataFrame, approved: DataFrame) -> DataFrame:
    """Active scrape targets by site: platform, locations, or the reason a record is left out.

    An approved site stays a target whatever its platform.
    """
    r = retailers.withColumn("site", site_key("website"))
    d = detections.filter("site IS NOT NULL").groupBy("site").agg(F.min("platform").alias("platform"))
    a = approved.select("site").distinct().withColumn("approved", F.lit(True))
    j = r.join(d, "site", "left").join(a, "site", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))
    reason = F.when(F.col("site").isNull(), "missing_website").when(F.col("approved"), None).when(F.col("platform").isNull(), "platform_unknown").when(F.col("platform") == "unknown", "unsupported_platform")
    return j.withColumn("excluded", reason)


def target_sites(targets: DataFrame) -> DataFrame:
    live = targets.filter("excluded IS NULL")
    return live.groupBy("site").agg(F.min("retailer_id").alias("first_retailer"), F.countDistinct("country").alias("locations"), F.max("platform").alias("platform"), F.max("approved").alias("approved"))


def site_locations(targets: DataFrame) -> DataFrame:
    """The shops of every active site, one row each: a site may have many."""
    return targets.filter("excluded IS NULL").select("site", "retailer_id", "country").distinct()


def merge_targets(sites: DataFrame, existing: DataFrame, approved: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Generated sites together with the targets that were there before.

    ``existing``: website, platform, status, priority, one row a site.  A site of both keeps what only
    the old target has and takes the rest anew.  An old target that was not generated is preserved
    if it is active (or says nothing), has a known platform, and so would not be left out.  A new
    site is only activated when approved, unless there were no targets at all.
    """
    e = existing.select(site_key("website").alias("site"), F.col("platform").alias("_p"), F.lower(T.clean("status")).alias("_s"), F.col("priority").alias("_r")).filter("site IS NOT NULL").withColumn("_old", F.lit(True))
    a = approved.select("site").distinct().withColumn("_approved", F.lit(True))
    first = e.limit(1).count() == 0
    j = sites.withColumn("_new", F.lit(True)).join(e, "site", "full").join(a, "site", "left")
    new, old = F.coalesce("_new", F.lit(False)), F.coalesce("_old", F.lit(False))
    fit = F.col("_s").isin("", "active") & (F.lower(T.clean("_p")).isin(*platforms) | F.coalesce("_approved", F.lit(False)))
    action = F.when(new & old, "merged").when(new, "new").when(old & fit, "preserved")
    active = F.when(F.col("action") == "new", F.coalesce("_approved", F.lit(False)) | F.lit(first)).otherwise(True)
    j = j.withColumn("action", action).filter("action IS NOT NULL").withColumn("active", active)
    return j.withColumn("platform", F.coalesce("platform", "_p")).withColumn("priority", F.col("_r")).drop("_p", "_s", "_r", "_old", "_new", "_approved")


def score_location(df: DataFrame, text: str, signals: Sequence[str], antisignals: Sequence[str]) -> DataFrame:
    """Signals for and against a place in a text; likely, mixed or unknown."""
    padded = F.concat(F.lit(" "), F.lower(T.clean(text)), F.lit(" "))
    d = df.withColumn("_p", padded)
    count = lambda words: sum((F.col("_p").contains(w).cast("int") for w in words), F.lit(0))
    d = d.withColumn("signals", count(signals)).withColumn("antisignals", count(antisignals)).drop("_p")
    return d.withColumn("location_status", F.when((F.col("signals") > 0) & (F.col("antisignals") == 0), "likely").when(F.col("signals") > 0, "mixed").otherwise("unknown"))


def filter_candidate_names(df: DataFrame, name: str, banned: Sequence[str], banned_parts: Sequence[str], required: Sequence[str], places: Sequence[str], least: int = 4, most: int = 60) -> DataFrame:
    """Plausible shop names: not banned, of sane length, with a shop or place word; once each."""
    k = T.text_key(name)
    d = df.withColumn("_k", k)
    rx = lambda words: "|".join(words)
    ok = ~F.col("_k").isin(*banned) & ~F.col("_k").rlike(rx(banned_parts)) & F.length(F.trim(name)).between(least, most) & (F.col("_k").rlike(rx(required)) | F.col("_k").rlike(rx(places)))
    return dedupe_first(d.filter(ok), ["_k"], [name]).drop("_k")


def classify_discovery(results: DataFrame) -> DataFrame:
    """Recommended status, reason, confidence and priority of a discovery result.

    ``results``: urls (category and product examples), platform, approx_count, price_visible,
    stock_visible, current_status, review_reason, priority.  A catalogue under ``/us/`` goes to
    review; one platform is ready when enough boards, prices and stock show; the rest keep
    what they had.
    """
    off = F.coalesce(F.exists("urls", lambda u: F.lower(u).contains("/us/")), F.lit(False))
    count = F.coalesce("approx_count", F.lit(0))
    ready = F.coalesce((F.col("platform") == "bigcommerce") & (count >= 10) & F.col("price_visible") & F.col("stock_visible"), F.lit(False))
    had = F.coalesce("priority", F.lit(0))
    pick = lambda a, b, c: F.when(off, a).when(ready, b).otherwise(c)
    return results.withColumns({
        "status": pick("manual_review", "ready_bigcommerce", F.when(T.blank("current_status"), "manual_review").otherwise(F.col("current_status"))),
        "reason": pick("non_au_catalogue_surface", "", F.coalesce("review_reason", F.lit(""))),
        "confidence": pick("medium", "high", F.when(count != 0, "medium").otherwise("low")),
        "priority": pick(F.least(had, F.lit(30)), F.greatest(had, F.lit(65)), had)})


def group_entities(df: DataFrame, name: str = "name", brand: str = "brand") -> DataFrame:
    """One entity per lower-cased name with its number of source brands."""
    return df.filter(~T.blank(name)).groupBy(F.lower(F.trim(name)).alias("entity")).agg(F.min(name).alias("name"), F.countDistinct(brand).alias("brand_count"), F.count("*").alias("mentions"))


def review_entities(df: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Names that are no address, no e-mail, no brand and not all capitals; once each."""
    n = F.trim("name")
    address = n.rlike(r"(?i)\b(street|st|road|rd|avenue|ave|drive|lane|highway|hwy)\b\.?$") | n.rlike(r"^\d+\s")
    shout = (n == F.upper(n)) & (F.length(n) > 12)
    ok = ~T.blank("name") & ~address & ~n.contains("@") & ~T.text_key("name").isin(*brands) & ~shout
    return dedupe_first(df.filter(ok).withColumn("_k", T.text_key("name")), ["_k"], ["name"]).drop("_k")


def clean_seed(df: DataFrame, kinds: Sequence[str], exceptions: Sequence[str]) -> DataFrame:
    """Records of the wanted types, plus named exceptions."""
    return df.filter(F.lower(T.clean("record_type")).isin(*kinds) | T.text_key("name").isin(*exceptions))


def group_by_site(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct values per site and field, one row each, with the site's best priority.

    The long form keeps every value whatever a site's size.
    """
    r = records.withColumn("site", site_key("website")).filter("site IS NOT NULL")
    pri = r.groupBy("site").agg(F.min("priority").alias("priority"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])
    long = r.select("site", F.explode(each).alias("e")).select("site", "e.field", "e.value").filter("value <> ''").distinct()
    return long.join(pri, "site")


# fixed values: health words of a retailer, worst first, and the states with their reasons
HEALTH_LADDER = ("failed", "poor", "warning", "fair", "missing")
GOVERNANCE_REASONS = {
    "production": "Producing available surfboard inventory",
    "stock_status_review": "Surfboards identified but no available inventory",
    "parser_review": "Products scraped but surfboard filter did not identify boards",
    "endpoint_review": "No raw products returned from scrape output",
    "technical_review": "Unhealthy scrape result",
    "review": "Needs manual review",
}


def governance(health: DataFrame, active: DataFrame, disabled: dict[str, str]) -> DataFrame:
    """Per retailer slug: sums over its source rows, its health, and its state with the reason.

    ``health``: slug, platform, raw, verified, available, normalised, duplicates, health.
    ``active``: slug, platform of the active targets; one without health rows counts as missing.
    ``disabled``: slug → reason, a decision of the business that comes before all others.
    """
    sums = ("raw", "verified", "available", "normalised", "duplicates")
    word = lambda w: F.max((F.col("health") == w).cast("int")).alias(f"_{w}")
    platform = F.when(T.blank("platform"), "unknown").otherwise(F.trim("platform"))
    g = health.groupBy("slug").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in sums], F.count("*").alias("source_rows"), *[word(w) for w in HEALTH_LADDER],
        F.array_join(F.array_sort(F.collect_set(platform)), ", ").alias("platform"))
    a = active.groupBy("slug").agg(F.min(platform).alias("_own"))
    j = g.join(a, "slug", "full").withColumn("active_target", F.col("_own").isNotNull()).withColumn("platform", F.coalesce("platform", "_own")).withColumn(
        "_missing", F.when(F.col("source_rows").isNull(), 1).otherwise(F.col("_missing"))).fillna(0, [*sums, "source_rows"])
    ladder = F.when(F.col("available") > 0, "good")
    for w in HEALTH_LADDER:
        ladder = ladder.when(F.col(f"_{w}") == 1, w)
    j = j.withColumn("health", ladder.otherwise("unknown"))
    state = (
        F.when(F.col("slug").isin(*disabled), "business_disabled").when((F.col("available") > 0) & (F.col("verified") > 0), "production")
        .when((F.col("verified") > 0) & (F.col("available") == 0), "stock_status_review").when((F.col("raw") > 0) & (F.col("verified") == 0), "parser_review")
        .when(F.col("raw") == 0, "endpoint_review").when(F.col("health").isin("failed", "poor"), "technical_review").otherwise("review"))
    reasons = F.create_map(*[F.lit(x) for kv in GOVERNANCE_REASONS.items() for x in kv])
    own = F.create_map(*[F.lit(x) for kv in disabled.items() for x in kv]) if disabled else F.lit(None).cast("map<string,string>")
    return j.withColumn("state", state).withColumn("reason", F.coalesce(F.element_at(own, F.col("slug")), F.element_at(reasons, F.col("state")))).drop(
        "_own", *[f"_{w}" for w in HEALTH_LADDER])


def expand_categories(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Root categories and all their descendants, however deep.

    ``edges``: category_id, parent_id; a category may have several parents.  Path doubling: in round
    k every category that is not known yet points to its ancestors 2^k levels up, and is known
    as soon as one of them is.  So the rounds are logarithmic in the depth; a cycle that
    reaches no root ends after as many rounds as would span all categories.
    """
    known = checkpointed(roots.select("category_id").distinct())
    up = edges.select("category_id", F.col("parent_id").alias("up")).filter("up IS NOT NULL").distinct()
    up = checkpointed(up.join(known, "category_id", "left_anti"))
    span, most = 1, 2 * up.count()
    while span <= most and not up.isEmpty():
        found = up.join(known.select(F.col("category_id").alias("up")), "up", "left_semi").select("category_id").distinct()
        known = checkpointed(known.unionByName(found))
        above = up.select(F.col("category_id").alias("up"), F.col("up").alias("_next"))
        up = checkpointed(up.join(above, "up").select("category_id", F.col("_next").alias("up")).distinct().join(known, "category_id", "left_anti"))
        span *= 2
    return known
