"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ngram_topk",                   # misspelt words against all headwords, ten best
    "sco7_cosine",                  # passages against all documents
    "fil9_all_quoted_terms",        # documents holding every word of a passage
    "idx2_ngram_frequency",         # gram frequencies of the headwords
    "idx9_term_vectors",            # tf-idf vectors and norms of all documents
    "ret6_wildcards",               # wildcard queries through their rarest anchored gram
    "ret7_kanji_reading",           # kanji + reading keys
    "sug1_prefix_suggestions",      # autocomplete, thirty best
    "qry9_target_and_page",         # annotating the whole query log
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from kotonoha import catalog
    from kotonoha.session import local_session

    spark = local_session(cpus, 4 * int(cpus) if cpus.isdigit() else 32, "16g")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
