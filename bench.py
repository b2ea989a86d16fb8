"""Headline queries on local cores; prints one JSON line.

Every query writes its complete result to the ``noop`` sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import time

from palisade.plans.queries import QUERIES
from tools.session import local_session

HEADLINE = (
    "scan_files", "scan_result", "scan_diff", "scan_result_diff", "findings_by_file",
    "custom_rule_generic_token", "rule_ais_001", "rule_sec_001", "suppressions", "diff_lines",
    "budget_diff", "detector_metrics", "join_verdicts", "top_comments", "sarif_report",
    "markdown_report", "match_positions", "stream_scan_diffs",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    for name in ("scan_files", "scan_diff") * 2:  # start workers, let the JIT settle
        run(spark, name, folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    texts = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "scan_ms_per_text": round(seconds["scan_files"] * 1000 / texts, 4),
            }
        )
    )


if __name__ == "__main__":
    main()
