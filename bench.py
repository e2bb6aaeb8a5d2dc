"""Times the headline queries and prints one JSON line.

Every query runs in full into Spark's noop sink. One untimed query warms up the JVM first; each query
then runs once and its planning is part of its time. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from ribeira.session import build_session
from workload import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "census_origins", "expectations", "origins_audit", "dissolve_sectors", "dissolve_parts", "attribute_conflicts",
    "multipart_stats", "duplicate_keys", "keyed_profile", "row_identity", "completeness_audit", "status_label",
    "csv_scan", "content_digest", "file_digest", "normalize_text", "slug", "clean_code", "localized_number",
    "extract_links", "resolve_links", "link_score", "topk_links", "rank_links", "safe_filename", "allowlist_semi",
    "landed_file_check", "archive_inventory", "landing_accept", "error_log", "checksum_join", "source_status",
    "json_flatten", "manifest_flatten", "payload_normalize", "origins_sink", "scenario_expand", "door_to_door",
    "min_time", "cumulative_access", "weighted_summary", "coverage", "keyword_join",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session("ribeira-bench", cpus=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "duplicate_keys")
    seconds = {name: run(spark, name) for name in HEADLINE}
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
