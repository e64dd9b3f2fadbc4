"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run from its files to the end of a sink that keeps nothing: one
warm-up, then the median of three runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "distinct_records",
    "shred",
    "extract_records",
    "extract_paragraphs",
    "extract_links",
    "extract_tables",
    "dedupe_in_page",
    "dedupe_records",
    "records_by_type",
    "page_records",
    "export_view",
    "keyword_search_documents",
    "clean_cell",
    "resolve_url",
    "validate_url",
    "decode_body",
    "robots_verdict",
    "redirect_chain",
    "dashboard_totals",
    "rate_audit",
    "spacing_audit",
    "spacing_schedule",
    "cache_hits",
    "latest_status",
)


def main() -> None:
    from pagemill.plans.queries import QUERIES
    from pagemill.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(3)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
