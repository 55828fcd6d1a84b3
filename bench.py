"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8), forcing full execution with the ``noop``
sink, and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``BENCH_QUERIES=all`` runs every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s2_article_snapshot",   # ingest: W1 F1 F2 F3 A1 over full texts
    "j3_similar_pairs",      # exact Jaccard self-join (prefix filtered)
    "g2_story_groups",       # J3 + connected components + anchors
    "o1_top_stories",        # flagship: ingest -> group -> score -> top 8
    "s5_insert_if_absent",   # anti joins against the store
    "w3_approval_fold",      # review decisions fold
    "j12_apply_decisions",   # decisions -> drafts update join
    "j8_review_rows",        # explode ids + join + distinct concat
    "j10_best_media",        # keyword -> media/photo match
    "m7_url_type",           # domain suffix rules
    "x9_extract_main_text",  # HTML main-text extraction (mapInPandas)
    "x11_digest_text",       # digest sections
    "x3_parse_model_json",   # model answers -> drafts
    "t1_stream_ingest",      # structured streaming ingest
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidewire.plans.queries import REGISTRY
    from tidewire.session import get_spark

    spark = get_spark("tidewire-bench", cpus=cpus)
    names = list(REGISTRY) if os.environ.get("BENCH_QUERIES") == "all" else \
        [n for n in HEADLINE if n in REGISTRY]
    # warm-up of the JVM and the generated-code cache on the smallest tables
    # (a different data folder: nothing measured below is cached by it)
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        REGISTRY["s2_article_snapshot"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
