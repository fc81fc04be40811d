"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillspark.queries import QUERIES
from quillspark.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["term_freq", "bm25_topk", "rrf_fuse_topk", "cosine_topk", "recursive_chunks", "html_blocks", "route_turns", "session_memory_8", "eval_by_theme", "run_state"]


def main() -> None:
    spark = session("bench", **{"spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/documents.parquet").count()  # start the executors before the clock
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
