"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from uptake.plans.catalog import QUERIES  # noqa: E402
from uptake.plans.stages import clear_stages  # noqa: E402

HEADLINE = [
    "a09_symbol_usage", "a10_parent_rows_top3", "a12_merge_languages", "a16_hotspots",
    "a14_inference_counts", "a19_evidence_and_class", "a20_suggestions",
    "j01_parent_scope", "j17_unused_components", "j18_symbol_delta", "q04_token_fk", "q07_inference_1to1",
    "x04_symbol_calls", "x05_token_substring_refs", "x07_containment_dedupe",
    "x11_compose_calls", "x12_swift_calls", "x10_jsx_usages", "j10_classify_compose",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("uptake-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="uptake-wh-"))
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    QUERIES["a01_raw_invocations"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "lineitem_rows": rows,
        "rows_per_sec": {k: round(rows / v) for k, v in seconds.items() if v},
    }))
    clear_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
