"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from lexiscope.plans.registry import REGISTRY

HEADLINE = (
    "row_sample_20pct",
    "profile_documents",
    "profile_with_nulls",
    "category_word_stats",
    "stats_before_after",
    "summary_equals_body",
    "category_text_digest",
    "top_terms_by_category",
    "split_sizes",
    "language_distribution",
    "language_rows",
    "minority_language_sample",
    "language_change_split",
    "combined_bodies",
    "vocabulary",
    "tfidf_terms",
    "nb_metrics",
    "nb_accuracy_by_part",
    "nb_confusion_matrix",
    "lr_metrics",
    "score_new_text_nb",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="lexiscope-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexiscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        # the tables are small for so many cores
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["category_counts"].run(spark, sf_dir).collect()  # start the session up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        result = REGISTRY[name].run(spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
