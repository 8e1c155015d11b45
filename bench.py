"""Headline queries at one scale factor; prints one JSON line.

Each query runs twice in one session and writes every row to the no-op sink:
``queries`` holds the second (warm) time, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mailgrain.plans import views  # noqa: E402
from mailgrain.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "html_to_text", "keyword_counts", "suspicious_patterns", "rule_score", "spam_gate", "extract_urls",
    "url_structure", "url_phishing", "message_url_summary", "message_url_summary_joined", "redirect_flags",
    "url_risk", "unsubscribe_plan", "recent_batch", "upsert_history", "message_attempts", "history_stats",
    "stratified_split", "normalise_text", "tfidf_idf", "weighted_vote", "classification_report", "ingest_eml",
    "process_batch", "train_naive_bayes",
)


def run(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("mailgrain-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    views.SPREAD = int(cpus)  # the tables here are single files of one row group
    cold = {name: run(spark, name, folder) for name in names}
    warm = {name: run(spark, name, folder) for name in names}
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": Path(folder).name, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
