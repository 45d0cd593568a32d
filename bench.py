"""Headline queries, timed once each after a warm-up; prints one JSON line.

The driver's tables are one file with one row group, hence one scan task, whatever the
number of cores.  Large tables have many files; so the large ones are laid out in one file per
core first, outside the timing.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from stockloom.plans import registry
from stockloom.session import local_session

HEADLINE = (
    "tk2_movement_by_retailer", "ev3_all_deltas", "lk8_linkage_report", "lk6_select_size", "lk9_apply_links", "wn5_dedupe_first", "ag1_grouped_index",
    "pf4_score_listings", "ag5_link_health", "ob6_region_readiness", "lk13_search_exact", "ag24_user_activity", "sc5_cards",
    "lk1_classify_exact", "lk15_search_close", "lk18_search_batch", "lk24_quality_report", "jn13_match_catalogue", "ob9_alerts",
)
LARGE = ("lineitem", "orders", "documents", "pages", "events")


def laid_out(spark, sf_dir: str, cores: int) -> str:
    """A folder like ``sf_dir`` whose large tables have several files."""
    out = tempfile.mkdtemp(prefix="bench-")
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        if name in LARGE:
            spark.read.parquet(f"{sf_dir}/{file}").repartition(cores).write.parquet(f"{out}/{file}")
        else:
            os.symlink(f"{sf_dir}/{file}", f"{out}/{file}")
    return out


def main() -> None:
    sf_dir, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    queries, times = registry.queries(), {}
    folder = laid_out(spark, sf_dir, int(cores))
    run = lambda name: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("wn5_dedupe_first")
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
