"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "s3_reject_accounting",
    "r5_validation_split",
    "r1_encode_labels",
    "l1_unigram_counts",
    "l2_bigram_counts",
    "l3_trigram_counts",
    "l5_sequence_scores",
    "l8_best_correction",
    "e6_by_word_length",
    "k2_summary_report",
    "b2_reading_order",
    "b3_merge_neighbours",
    "c1_greedy_decode",
    "c2_beam_decode",
    "d2_connected_components",
    "d7_d9_detected_boxes",
    "a4_grid_resample",
    "g4_rotation_warp",
    "h2_best_so_far",
    "h5_trainer_schedule",
    "m1_nearest_neighbours",
    "s6_image_read",
    "g2_loader_jitter",
]


def calibration() -> float:
    """Seconds of a fixed amount of work outside Spark, to tell a slow machine from a slow query."""
    import hashlib

    start = time.perf_counter()
    block = bytes(range(256)) * 4096
    for _ in range(200):
        block = hashlib.sha256(block).digest() * 32_768
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from quillframe.plans import catalog
    from quillframe.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{sf}/region.parquet").count()  # the first job starts the session
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "calibration": calibration(),
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
