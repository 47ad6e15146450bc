"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import all_queries  # noqa: E402
from tidemark.session import get_session  # noqa: E402

HEADLINE = (
    "agg_hourly_union_rollup", "agg_reconcile_totals", "agg_hist_percentile", "agg_multi_scope", "agg_percentile_cont", "agg_weekly_trend",
    "jn_full_reconcile", "jn_asof_next", "jn_asof_attribute", "jn_left_chain", "jn_fallback_chain", "jn_lateral_top1",
    "win_chain_verify", "win_trailing_12m", "win_distinct_on", "top_knn_cosine", "op_lag_report",
    "txt_near_dup_classify", "txt_containment", "txt_pii_scrub", "txt_fts_bm25", "ev_hash_split_3way", "ev_auc",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", app="bench")
    run = all_queries()
    run[HEADLINE[0]](spark, sf).count()  # the JVM warms up
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
