"""Benchmark the headline queries.

Runs each on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Every query is forced end to end through the ``noop`` sink (all rows
computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text",
    "word_counts",
    "vocab_rank",
    "stratified_split",
    "doc_matrix",
    "prepare_hierarchical",
    "seq_encode",
    "classification_report",
    "top_sentences",
    "attention_pool",
    "train_text_classifier",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from glossa.session import build_session, shuffle_partitions_for

    scratch = tempfile.mkdtemp(prefix="glossa-bench-")
    text_bytes = os.path.getsize(os.path.join(sf_dir, "documents.parquet"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=shuffle_partitions_for(text_bytes, cpus),
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.local.dir": os.path.join(scratch, "local")})
    from glossa.catalog import queries

    qs = queries()
    spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
