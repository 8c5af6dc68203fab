"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from supportlake.plans.catalog import QUERIES
from supportlake.session import local_session, remove_run_dirs

HEADLINE = (
    "ret_flagship_report", "ret_dense_topk", "ret_posting_blocks", "ret_bm25_topk", "ret_retrieve_hybrid", "chk_chunk_documents", "chk_split_sentences",
    "txt_fingerprint", "txt_redact_pii", "cnv_pair_turns", "cnv_advance_cursor", "cnv_exact_dedup", "ctx_layer1", "ctx_summary_batch",
    "mrg_upsert_drafts", "mrg_sync_plan", "grd_guard_answers", "rte_accept_refunds", "log_audit_loop_limits", "evl_grouped_report",
    "evl_paired_comparisons",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors once
    seconds = {}
    for name in names:
        began = time.perf_counter()
        # Full result, nothing collected: every column of every row is computed.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    remove_run_dirs(spark)
    print(json.dumps({
        "metric": "support_knowledge_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cores, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
