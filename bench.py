"""Headline queries at one scale: prints one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query is planned and run to the end, rows discarded; one run before the timed one warms it up.
"""

from __future__ import annotations

import json
import os
import time

from pagemill.catalog import QUERIES
from pagemill.session import build_session

HEADLINES = (
    "host_pages", "html_to_text", "normalize_content", "extract_links", "replace_apply", "text_search", "merge_books",
    "merge_book_members", "switch_candidates", "merge_newest", "bookmark_report", "export_bookmarks_md", "source_health",
    "login_throttle", "source_summary", "rule_corpus_profile", "json_select", "page_chain", "html_nodes", "select_css",
    "extract_book_list", "content_by_kind",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
