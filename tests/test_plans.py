"""Physical plans: what is read, shuffled, sent to Python or joined."""

import re

import pytest

from gradeloom.plans import fixtures as D, queries as Q
from gradeloom.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def plan_of(spark, sf_dir):
    def plan(name):
        return REGISTRY[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    return plan


PYTHON = {
    "generate_rows",
    "generate_batches",
    "generate_routed",
    "generate_with_retry",
    "generate_with_settings",
    "rewrite_fields",
    "meld_distance_edit",
    "meld_distance_ratio",
    "meld_summary",
    "meld_rate",
    "meld_results",
    "meld_recompute",
    "meld_distance_turns",
}


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_cross_joins_and_python_only_where_needed(plan_of, name):
    plan = plan_of(name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "name,columns",
    [
        ("exact_match", {"l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"}),
        ("label_histogram", {"l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"}),
        ("shuffle_rows", {"text"}),
        ("first_line", {"doc_id", "text"}),
        ("route_models", {"c_custkey", "c_name", "c_mktsegment"}),
    ],
)
def test_scans_read_only_what_is_used(plan_of, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(name))
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",") if field}
    assert read and read <= columns


def test_rewriting_does_not_shuffle_more_than_its_input(spark, sf_dir):
    t = Q.Tables(spark, sf_dir)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(Q.rewrite_fields(t)) == count(Q.D.mcq(t))


def test_scores_combine_before_the_shuffle(plan_of):
    assert re.search(r"partial_avg", plan_of("exact_match"))
    assert re.search(r"partial_count", plan_of("classification_report"))


def test_join_side_follows_its_size(spark, sf_dir):
    """Beyond the size limit references are no longer broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = REGISTRY["join_predictions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_generations_part_into_runs_after_the_join(spark, sf_dir):
    """The join sorts a row for each order, not one for each run."""
    plan = D.generations(D.Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")
