"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from atlasloom.session import build_session  # noqa: E402
import workload  # noqa: E402

HEADLINE = [
    "chunk_words", "hash_embed", "topk_chunks", "topk_chunks_ann", "text_retrieval", "context_by_file", "assembled_prompts",
    "pair_turns_strict", "pair_turns_adjacent", "history_text", "research_state", "research_stages", "request_validation",
    "doc_columns", "filter_exclude", "filter_rules", "embedding_stats", "modal_dimension_filter", "batch_assignment", "latest_events",
    "wiki_pages_from_xml", "cluster_titles", "section_tree", "related_pages", "attached_content", "wiki_completeness",
    "markdown_export", "json_export", "context_pack", "slide_plan", "slide_page", "workshop", "sse_accumulate",
    "file_tree", "repositories", "project_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers outside the timed part
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
