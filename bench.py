"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tamperscope.queries import QUERIES

# Query -> the sheets it reads are built inside the first query that needs them.
HEADLINES = [
    "terminal_digit", "benford_first", "benford_second", "decimal_precision", "value_collisions", "duplicate_rows",
    "sequential_duplication", "block_copies", "pair_autocorrelation", "windowed_autocorrelation", "runs_test",
    "noise_scaling", "selective_noise", "regional_noise", "loess_cusum", "replicate_correlation", "mahalanobis_rows",
    "blocked_mahalanobis", "rank_correlation", "condition_consistency", "missing_pattern", "excess_kurtosis_verdict",
    "blocked_mahalanobis_verdict", "value_spike_verdict",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
