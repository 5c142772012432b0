"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkledger.plans import registry  # noqa: E402
from sparkledger.session import build_session  # noqa: E402

HEADLINE = (
    "tax_totals", "trusted_history", "dedupe_history", "seller_profiles", "project_profiles", "buyer_profiles", "draft_totals", "match_rules", "suggest_taxonomy",
    "code_lines", "apply_history", "validate_sheets", "repair_report", "diff_drafts", "case_summary", "workflow_steps", "rule_candidates", "match_requests",
    "extract_lines", "extract_buyers", "table_to_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    registry.load_all()
    spark = build_session(
        "sparkledger-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start-up is not timed
    seconds = {}
    for name in names:
        started = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
