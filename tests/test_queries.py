"""Queries next to their statements on the smallest tables. All of them: ``python tests/oracle_check.py``."""

import pytest
from oracle_check import compare, connect

from sparkledger.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"
CHECKED = (
    "standardize_lines canonical_rates sheet_rates tax_id_quality chinese_amounts classify_documents invoice_profile trusted_history review_filter publishable_rules valid_records "
    "seller_profiles buyer_profiles dedupe_history dominant_line code_hierarchy suggest_taxonomy match_rules coding_states case_summary case_timeline latest_rules "
    "classify_failures failure_summary exact_history fill_buyers find_parent_batch bundle_sellers extract_notes split_amounts nearby_values ingest_counts pending_events "
    "last_observations case_states publish_rules golden_checks attachment_summary draft_events reissue_lines rule_candidates"
).split()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equal(spark, con, name):
    problem, rows, _ = compare(spark, con, SF, name)
    assert problem is None, problem
    assert rows > 0


def test_no_cartesian_plans(spark):
    for name in ("match_rules", "suggest_taxonomy", "search_taxonomy", "fuzzy_history", "resolve_buyers", "match_subjects", "code_hierarchy"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
