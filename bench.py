"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Every query is
written in full to the no-op sink. The corpus tables that queries share are built first and
timed on their own, under ``build``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.functions.session import build_session  # noqa: E402
from lectern.plans.corpus_tables import arabic_words, corpus_words  # noqa: E402
from workload import MODULES  # noqa: E402

HEADLINES = (
    "word_index",
    "postings",
    "locate_passage",
    "search_verses",
    "page_info",
    "chapter_catalogue",
    "normalize_corpus",
    "phoneme_table",
    "similar_words",
    "match_chunk",
    "distribute_word_times",
    "verse_times",
    "repair_overlaps",
    "check_coverage",
    "validation_report",
    "ritual_progress",
    "consolidate_chunks",
    "study_statistics",
    "next_chapter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, partitions=int(cpus) * 2, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: q for module in MODULES for name, q in module.QUERIES.items()}
    built: dict[str, float] = {}
    for name, make in (("corpus_words", corpus_words), ("arabic_words", arabic_words)):
        begin = time.time()
        make(spark, sf_dir)
        built[name] = round(time.time() - begin, 3)
        print(name, built[name], file=sys.stderr, flush=True)
    times: dict[str, float] = {}
    for name in HEADLINES:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": built,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
