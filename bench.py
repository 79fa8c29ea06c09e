"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from glossa.registry import QUERIES
from glossa.session import session

HEADLINE = (
    "knn_cosine_top10 refine_lowdim_top10 ivf_probe_top10 gsq_scan_top10 recall_at_k codec_q4k codec_q4k_m codec_gsq6 codec_svdlm_4 codec_polar_4 codec_pq "
    "kv_line_parse key_text_filter asm_text_filter ref_join_last_wins cache_lookup_hit_rate vocab_anti merge_update_coalesce writeback_first_wins word_lookup "
    "dict_sparse dict_merge_union ordered_distinct balanced_batches greedy_batches prefix_budget sliding_60s_requests_tokens session_windows prompt_build response_parse alpaca_export"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    took: dict[str, float] = {}
    known = [n for n in HEADLINE if n in QUERIES]
    QUERIES[known[0]](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's workers
    for name in known:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
