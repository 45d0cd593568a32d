"""Invariants, hot keys, loads, streams and plans."""

import datetime

import pytest
from pyspark.sql import functions as F

from stockloom.operators import dedupe as dd
from stockloom.operators import events as ev
from stockloom.operators import health as H
from stockloom.operators import linkage as L
from stockloom.operators import movement as mv
from stockloom.operators import search as se
from stockloom.plans import fixtures as fx
from stockloom.sources import feeds as fd
from stockloom.sources import sinks as sk
from stockloom.streaming import events as se_ev
from stockloom.streaming import movement as sm


def ids(df, c):
    return sorted(r[0] for r in df.select(c).collect())


@pytest.fixture(scope="module")
def snaps(spark, sf):
    """Two thirds of the rows moved onto one key."""
    s = fx.snapshots(spark, sf)
    hot = F.col("inventory_id") % 3 != 0
    return s.withColumn("retailer_name", F.when(hot, "HOT").otherwise(F.col("retailer_name"))).withColumn("product_url", F.when(hot, "u").otherwise(F.col("product_url")))


def test_movement_with_hot_key(snaps):
    got = {(r["event_date"], r["event_type"]): r["n"] for r in mv.all_deltas(snaps).groupBy("event_date", "event_type").agg(F.count("*").alias("n")).collect()}
    data = snaps.collect()
    key = lambda r: (r["retailer_name"] or "", r["product_url"] or "", r["length"] or "")
    dates = sorted({r["snapshot_date"] for r in data})
    by = {d: [key(r) for r in data if r["snapshot_date"] == d] for d in dates}
    want = {}
    for p, c in zip(dates, dates[1:]):
        for kind, a, b in (("SOLD_OUT", by[p], by[c]), ("NEW_STOCK", by[c], by[p])):
            n = sum(1 for k in a if k not in set(b))
            if n:
                want[(c, kind)] = n
    assert got == want


def test_dedupe_is_idempotent_and_partition_free(spark, sf):
    inv = fx.inventory(spark, sf).withColumn("g", F.when(F.col("true_size_id") % 3 == 0, -1).otherwise(F.col("true_size_id")))
    one = dd.dedupe_first(inv, ["g"], ["inventory_id"])
    assert ids(dd.dedupe_first(one, ["g"], ["inventory_id"]), "inventory_id") == ids(one, "inventory_id")
    assert ids(dd.dedupe_first(inv.repartition(3), ["g"], ["inventory_id"]), "inventory_id") == ids(one, "inventory_id")


def test_links_never_overwrite(spark, sf):
    inv = fx.inventory(spark, sf)
    p = L.project_links(inv, fx.aliases(spark, sf), fx.BRANDS, fx.models(spark, sf), fx.sizes(spark, sf))
    out = L.apply_links(inv.select("inventory_id", "brand_id", "model_id", "size_id"), p.select("inventory_id", "new_brand_id", "new_model_id", "new_size_id"))
    j = inv.select("inventory_id", F.col("model_id").alias("m"), F.col("size_id").alias("s")).join(out, "inventory_id")
    assert j.count() == inv.count()
    assert j.filter("(m IS NOT NULL AND m <> model_id) OR (s IS NOT NULL AND s <> size_id)").count() == 0


def test_linkage_plans_have_no_nested_loops_or_python(spark, sf):
    inv = fx.inventory(spark, sf)
    p = L.project_links(inv, fx.aliases(spark, sf), fx.BRANDS, fx.models(spark, sf), fx.sizes(spark, sf))
    e = se.search_exact(fx.targets(spark, sf), inv, fx.models(spark, sf))
    for df in (p, L.linkage_report(p), e, se.search_close(fx.targets(spark, sf), inv, fx.models(spark, sf), e)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan


def test_deactivated_guards_raise(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    mins = spark.createDataFrame([("a", 2), ("b", 2)], "k string, minimum int")
    with pytest.raises(ValueError):
        H.assert_minimums(df, mins, "k")
    with pytest.raises(ValueError):
        fd.conform(df, df.schema, ("missing",))


def test_region_replace_keeps_other_regions(spark, tmp_path):
    path = str(tmp_path / "inv")
    base = spark.createDataFrame([(1, "AU"), (2, "EU"), (3, "EU")], "id int, region_code string")
    sk.replace_region(base.filter("region_code = 'AU'"), path, "AU")
    sk.replace_region(base, path, "EU")
    sk.replace_region(spark.createDataFrame([(9, "EU")], "id int, region_code string"), path, "EU")
    assert ids(spark.read.parquet(path), "id") == [1, 9]


def test_read_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "x"}]')
    (tmp_path / "b.json").write_text('{"items": [{"id": "2"}, {"id": "3"}]}')
    assert ids(fd.read_feed(spark, str(tmp_path)), "id") == ["1", "2", "3"]


def test_report_files(spark, tmp_path):
    df = spark.range(10)
    sk.write_report(df, df, str(tmp_path / "r"), ["id"], cap=3, fmt="json")
    assert spark.read.json(str(tmp_path / "r/accepted")).count() == 10
    assert spark.read.json(str(tmp_path / "r/rejected")).count() == 10
    assert spark.read.json(str(tmp_path / "r/rejected_sample")).count() == 3


def test_upsert_uses_bare_rows_once(spark):
    schema = "inventory_id string, url string, volume double, price double"
    old = spark.createDataFrame([("s1", "u", 28.0, 1.0), ("s2", "u", None, 1.0), ("s3", None, None, 1.0), ("s4", "x", 5.0, 1.0)], schema)
    new = spark.createDataFrame([(None, "u", 28.0, 2.0), (None, "u", 30.0, 2.0), (None, "u", 31.0, 2.0), (None, "u", 28.0, 3.0), (None, None, 9.0, 2.0), (None, "y", None, 2.0)], schema)
    got = {(r.inventory_id, r.url, r.volume, r.price, r.action) for r in sk.upsert_inventory(old, new, ["url"]).collect()}
    assert got == {("s1", "u", 28.0, 2.0, "update"), ("s2", "u", 30.0, 2.0, "update"), (None, "u", 31.0, 2.0, "insert"), ("s3", None, 9.0, 2.0, "update"), (None, "y", None, 2.0, "insert"), ("s4", "x", 5.0, 1.0, "keep")}


def test_close_search_without_a_target_volume(spark, sf):
    t = fx.targets(spark, sf).filter("region_code = 'EUROPE'").withColumn("volume", F.lit(None).cast("decimal(10,2)"))
    none = fx.inventory(spark, sf).filter("false")
    e = none.select(F.lit("").alias("target_id"), "inventory_id")
    found = se.search_close(t, fx.inventory(spark, sf), fx.models(spark, sf), e)
    assert found.count() > 0 and found.filter("volume IS NOT NULL").count() == 0


def _direct_case(spark):
    """Targets of a generic and of a strict brand, and direct rows with every kind of model id and name."""
    t = spark.createDataFrame(
        [("g", "EU", 3, "Maker 3", 30, "Happy Everyday", 300), ("s", "EU", 0, "Maker 0", 10, "Happy Everyday", 100)],
        "target_id string, region_code string, brand_id int, brand_name string, model_id int, model_name string, size_id int").selectExpr(
        "*", """"5'10" AS length""", "70 AS length_inches", "'19' AS width", "'2' AS thickness", "CAST(30 AS DECIMAL(10,2)) AS volume", "'PU' AS construction", "'FCS' AS fin_setup")
    rows = [("same_model", 30, "x", "5'10", 30.0, "EU"), ("null_model", None, " happy everyday ", "5'10", 30.5, "EU"), ("other_model", 77, "Happy Everyday Round", "5'10", None, "EU"),
            ("inside", None, "Happy", "5'10", 30.0, "EU"), ("part_of_a_word", None, "Every", "5'10", 30.0, "EU"), ("across_words", None, "py Ev", "5'10", 30.0, "EU"),
            ("own_size", 77, "Happy Everyday", "5'11", 30.0, "EU"), ("no_name", None, None, "5'10", 30.0, "EU"), ("other_name", None, "Happy Everyyear", "5'10", 30.0, "EU"),
            ("other_length", None, "Happy", "5'11", 30.0, "EU"), ("too_big", None, "Happy", "5'10", 31.0, "EU"), ("other_region", None, "Happy", "5'10", 30.0, "AU")]
    d = [(f"{b}-{i}", r, b, f"Maker {b}", m, n, 300 if i == "own_size" and b == 3 else None, ln, v, 1.0, True, True) for b in (3, 0) for i, m, n, ln, v, r in rows]
    d = spark.createDataFrame(d, "direct_id string, region_code string, brand_id int, brand_name string, model_id int, model_name string, size_id int, length string, volume double, price double, is_available boolean, is_active boolean").selectExpr(
        "* EXCEPT (volume)", "CAST(volume AS DECIMAL(10,2)) AS volume", "'18' AS width", "'2' AS thickness", "'PU' AS construction", "'FCS' AS fin_setup", "'u' AS product_url")
    return t, d


def test_direct_rows_of_generic_brands_by_name(spark):
    from stockloom.plans.q_search import _policy

    t, d = _direct_case(spark)
    got = {(r.target_id, r.direct_id): r.match_rank for r in se.search_direct(t, d, _policy(spark)).collect()}
    assert got == {("g", "3-same_model"): 1, ("g", "3-own_size"): 0} | {("g", f"3-{n}"): 3 for n in ("null_model", "other_model", "inside", "part_of_a_word", "across_words")}


def test_direct_by_name_against_sql_of_the_reference(spark, duck, sf):
    """Every generic row of the query by the rule of the reference, written as a condition over all pairs of a brand."""
    from stockloom.plans.q_search import QUERIES, s as search_sql

    body = """SELECT t.target_id, d.direct_id FROM targets t JOIN pol USING (brand_name) JOIN direct d ON d.region_code = t.region_code AND d.brand_id = t.brand_id WHERE mode = 'generic' AND direct_enabled AND (d.size_id = t.size_id OR (d.length = t.length
    AND (d.model_id = t.model_id AND (abs(d.volume - t.volume) <= 0.75 OR (d.width = t.width AND d.thickness = t.thickness)) OR (d.model_id = t.model_id OR contains(lower(trim(d.model_name)), lower(trim(t.model_name)))
    OR contains(lower(trim(t.model_name)), lower(trim(d.model_name)))) AND (d.volume IS NULL OR t.volume IS NULL OR abs(d.volume - t.volume) <= 0.75))))"""
    want = set(duck.execute(search_sql(body)).fetchall())
    df = QUERIES["lk11_search_direct"](spark, sf)
    generic = fx.targets(spark, sf).filter("brand_name = 'Maker 3'").select("target_id")
    got = {(r.target_id, r.direct_id) for r in df.join(generic, "target_id").collect()}
    assert got == want and want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_listing_evidence_in_any_text_column(spark):
    """Each row has its evidence in one column that is neither title, vendor, description nor product_type."""
    from stockloom.operators import listings as ls

    cases = {
        "plain": ({}, ("low_confidence_or_missing_board_identity", "price_ok")),
        "category": ({"categories": ["Sale", "Surfboards"]}, (None, "price_ok,board_type,category_board_signal")),
        "accessory_category": ({"categories": ["Fins"], "vendor": "pyzel surfboard"}, ("fin_accessory_not_board", "")),
        "lesson_category": ({"categories": ["Surf Lessons"], "vendor": "pyzel surfboard"}, ("service_or_rental_listing", "")),
        "tags": ({"tags": [{"name": "Pyzel"}, {"name": "Shortboard"}]}, (None, "price_ok,board_type,brand")),
        "variant_title": ({"variant_title": "6'0 x 19 x 2.5 Pyzel"}, (None, "price_ok,full_dimensions,length,brand")),
        "variant": ({"variant": "Pyzel longboard"}, (None, "price_ok,board_type,brand")),
        "short_description": ({"short_description": "pyzel shortboard"}, (None, "price_ok,board_type,brand")),
        "sku": ({"sku": "PYZEL-SHORTBOARD"}, (None, "price_ok,board_type,brand")),
        "handle": ({"handle": "dakine-leash", "vendor": "pyzel surfboard"}, ("hard_excluded_product_type", "")),
        "product_url": ({"product_url": "https://x.example/pyzel-surfboards/1"}, (None, "price_ok,board_type,brand,url_board_hint")),
        "excluded_url": ({"product_url": "https://x.example/wetsuit/1", "vendor": "pyzel surfboard"}, ("hard_excluded_product_type", "")),
    }
    schema = ("id string, title string, vendor string, product_type string, description string, url string, length string, width string, thickness string, volume_litres string, price string, "
              "variant_title string, variant string, categories array<string>, tags array<struct<name string>>, short_description string, sku string, handle string, product_url string")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple(({"id": k, "title": "Ghost", "price": "$900"} | given).get(n) for n in names) for k, (given, _) in cases.items()]
    got = {r.id: (r.reject_reason, ",".join(r.reasons), r.is_board) for r in ls.score_listings(spark.createDataFrame(
        [tuple([(x["name"],) for x in v] if n == "tags" and v else v for n, v in zip(names, row)) for row in rows], schema)).collect()}
    assert got == {k: (*want, want[0] is None) for k, (_, want) in cases.items()}


def test_retailers_without_raw_rows_are_reported(spark):
    from stockloom.operators import listings as ls

    feed = lambda *names: spark.createDataFrame([(n,) for n in names], "retailer_id string")
    n = spark.createDataFrame([("a", "u", 1), ("a", "u", 1), ("b", "u", 1), ("c", "u", 1)], "retailer_id string, _dup string, available long")
    report = ls.retailer_quality(feed("a", "a", "d"), feed("a", "b", "b", None, " "), n)
    got = {r.retailer_id: (r.raw, r.verified, r.normalised, r.available, r.duplicates, r.health) for r in report.collect()}
    assert got == {"a": (2, 1, 2, 2, 1, "healthy"), "b": (0, 2, 1, 1, 0, "failed"), "d": (1, 0, 0, 0, 0, "poor")}
    total = ls.retailer_quality_totals(report).first()
    assert tuple(total) == (3, 1, 0, 1, 1, 3, 3, 3, 1)


def test_three_word_names_are_found(spark):
    m = spark.createDataFrame([(1, 7, "hypto krypto twin"), (1, 8, "hypto krypto")], "brand_id int, model_id int, model_name string")
    i = spark.createDataFrame([("a", 1, "B hypto krypto twin 5'6", None), ("b", 1, "B hypto krypto 5'6", None)], "inventory_id string, brand_id int, title string, normalised_title string")
    assert sorted((r.inventory_id, r.model_id) for r in se.title_models(i, m).collect()) == [("a", 7), ("a", 8), ("b", 8)]


def test_categories_of_any_depth(spark):
    from stockloom.operators import network as nw

    edges = spark.range(1, 31).select("id", (F.col("id") - 1).alias("p")).toDF("category_id", "parent_id")
    assert nw.expand_categories(edges, edges.filter("category_id = 1").select("category_id")).count() == 30


def test_movement_stream_equals_batch_and_survives_replay(spark, snaps, tmp_path):
    dates = [r[0] for r in snaps.select("snapshot_date").distinct().orderBy("snapshot_date").limit(4).collect()]
    some = snaps.filter(F.col("snapshot_date").isin(dates))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for d in dates:
        some.filter(F.col("snapshot_date") == d).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sm.stream_movement(stream, out, str(tmp_path / "ck")).awaitTermination()
    want = sorted(map(str, mv.all_deltas(some).groupBy("event_date", "event_type").count().collect()))
    got = lambda: sorted(map(str, sm.read_movement(spark, out).groupBy("event_date", "event_type").count().collect()))
    assert got() == want
    sm.process_batch(spark.read.parquet(f"{out}/snapshots").filter("batch_id = 1").drop("batch_id").select(*some.columns), 1, out)
    assert got() == want


def test_event_streams_equal_batch(spark, sf, tmp_path):
    e = fx.job_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    e.repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    se_ev.last_seen(stream(), str(tmp_path / "seen"), str(tmp_path / "c1")).awaitTermination()
    got = se_ev.current_rows(spark.read.parquet(str(tmp_path / "seen")), ["event", "region"])
    want = ev.freshness_issues(e, F.lit(datetime.datetime(2024, 2, 1))).select("event", "region", "last_seen")
    assert got.select("event", "region", "last_seen").exceptAll(want).count() == 0 and got.count() == want.count()
    se_ev.latest_execution(stream(), str(tmp_path / "run"), str(tmp_path / "c2")).awaitTermination()
    runs = se_ev.current_rows(spark.read.parquet(str(tmp_path / "run")), ["service", "region"])
    assert runs.select("service", "region", "event_id").exceptAll(ev.latest_execution(e).select("service", "region", "event_id")).count() == 0


def test_intake_splits_events(spark, tmp_path):
    raw = spark.createDataFrame([("1", None, "a"), (None, "x", " "), (None, " ", "b")], "user_id string, anonymous_id string, event_type string")
    raw.write.parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "src"))
    se_ev.intake(s, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "good")), "event_type") == ["UnknownEvent", "a"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
