"""Plan-shape guards: the physical plans keep the properties the scale design
relies on (README "Scale design")."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from prefspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
JOINS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
USER_FUNCTIONS = {"score_with_udf", "judge_with", "judge_with_failures", "judge_failures", "tokenize_with", "tokenize_subword",
                  "truncate_lines_subword", "fit_reward_model", "reward_model_scores",
                  "metric_rollup_stream", "metric_rollup_append"}


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["round_robin_tournament", "winrate_vs_baseline", "best_of_n_winrate",
                                  "best_of_n_curve", "cycle_stats", "bt_probability_mean", "preference_graph",
                                  "model_pair_theta_join", "player_cross", "disagreement_labels"])
def test_no_join(spark, name):
    p = plan(spark, name)
    assert not any(j in p for j in JOINS), p


@pytest.mark.parametrize("name,max_exchanges", [("round_robin_tournament", 2), ("cycle_stats", 2),
                                                ("best_of_n_winrate", 2), ("winrate_vs_baseline", 2)])
def test_exchange_count(spark, name, max_exchanges):
    p = plan(spark, name)
    physical = p.split("\n\n(")[0]
    assert physical.count("Exchange hashpartitioning") + physical.count("Exchange SinglePartition") <= max_exchanges, p


def test_scans_are_pruned(spark):
    p = plan(spark, "round_robin_tournament")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    p = plan(spark, "head_n")
    assert "ReadSchema: struct<doc_id:bigint>" in p            # text never read for a key-only query


def test_top_k_is_pushed_below_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "head_n")


def test_no_python_outside_user_functions(spark):
    for name in QUERIES:
        if name in USER_FUNCTIONS:
            continue
        p = plan(spark, name)
        assert not any(x in p for x in PYTHON), name


def _scans(spark, name):
    p = plan(spark, name).split("\n\n(")[0]
    return p.count("Scan parquet")


@pytest.mark.parametrize("name,most", [("round_robin_tournament", 1), ("best_of_n_winrate", 1), ("multi_attribute_vote", 1),
                                       ("rloo_advantage", 2), ("normalize_reward", 2), ("source_annotated_summaries", 3)])
def test_scan_count(spark, name, most):
    assert _scans(spark, name) <= most, plan(spark, name)


def test_no_text_in_the_shuffle_rank(spark):
    """The seeded shuffle of the annotated summaries ranks ids alone."""
    p = plan(spark, "source_annotated_summaries")
    windows = [b for b in p.split("\n\n") if "Window" in b.split("\n")[0] and "Input" in b]
    assert windows and not any("chosen" in b for b in windows)
