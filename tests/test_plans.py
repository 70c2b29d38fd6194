"""Plans that must hold at scale: no joins of every row with every row, filters at the scan, limits before shuffles."""

import re

import pytest

from matchframe.plans import all_queries

QUERIES = all_queries()
PLANNED = [
    "rankings_asof", "values_asof", "clubs_asof", "active_spells", "eligible_players", "partial_links", "all_links", "cascade_links",
    "fixture_links", "group_countries", "prior_careers", "match_form", "with_opponent", "attached_side_features", "goal_likelihood",
    "outcome_probs", "goal_predictions", "ensemble_weight_scores", "three_way_scores", "calibration_three_way", "matchup_grid",
    "resolved_slots", "pair_lookups", "stage_probabilities",
]


def plan(spark, name, sf_dir):
    return QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops(name, spark, sf_dir):
    text = plan(spark, name, sf_dir)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, "scan_columns", sf_dir)
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_extendedprice" not in text


@pytest.mark.parametrize("name", ["squad_features", "last_matches", "best_thirds", "preferred_clubs"])
def test_top_rows_are_cut_before_the_shuffle(name, spark, sf_dir):
    assert plan(spark, name, sf_dir).count("WindowGroupLimit") >= 2


def test_outcome_probabilities_need_no_shuffle(spark, sf_dir):
    text = plan(spark, "outcome_probs", sf_dir)
    assert "Exchange hashpartitioning" not in text and "Generate" not in text and "Python" not in text


def test_ratings_are_folded_once(spark, sf_dir):
    assert plan(spark, "current_ratings", sf_dir).count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["matchup_grid", "pair_lookups"])
def test_entrants_are_numbered_without_one_task(name, spark, sf_dir):
    """No window sees all rows: every one has a partition."""
    text = plan(spark, name, sf_dir)
    assert "windowspecdefinition(" in text and not re.search(r"windowspecdefinition\(\w+#\w+ (ASC|DESC)", text)


@pytest.mark.parametrize("name", ["ensemble_weight_scores", "ensemble_weight_search"])
def test_weights_copy_no_rows(name, spark, sf_dir):
    made = re.findall(r"Generate explode\(([^)]*)", plan(spark, name, sf_dir))
    assert set(made) <= {"[1,2,3]"}  # the three models of the view
