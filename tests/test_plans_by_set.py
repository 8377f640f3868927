"""Plans made in one pass by set, against the tables of the separate results."""

from veridoc.operators import audit as au
from veridoc.plans import runner
from veridoc.plans.audit import Inputs
from veridoc.session import Tables

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_plans_of_one_pass_are_those_of_the_joined_results(spark):
    i = Inputs(Tables(spark, DATA))
    assert rows(i.plans()) == rows(au.plan_rows(i.totals(), i.gaps(), i.missing(), i.items()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_credited_courses_are_shuffled_once_for_a_plan(spark):
    plan = runner("plan_assembly")(spark, DATA)
    assert plan._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    assert exchanges(plan) <= 30  # 58 before, most of them for the small rule definition


def test_required_courses_of_a_pair_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(1, "r"), (2, "r"), (None, "r"), (3, "other")], "set_id long, rule_set_id string")
    resolved = spark.createDataFrame([(1, "a", "passed"), (1, "b", "failed"), (2, "b", "in_progress"), (2, "z", "passed"), (None, "a", "passed")], "set_id long, course_code string, state string")
    required = spark.createDataFrame([("r", 0, "x", 0, "a"), ("r", 0, "x", 1, "b"), ("r", 1, "y", 0, "b"), ("r", 1, "y", 1, None)], "rule_set_id string, ordinal int, category string, position int, course_code string")
    catalog = spark.createDataFrame([("r", "a", "Algebra", 2.0, "k"), ("r", "q", "Other", 1.0, "k")], "rule_set_id string, course_code string, course_name string, credits double, category string")
    found = au.missing_required(pairs, resolved, required, catalog)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.set_id or 0, r.ordinal, r.position, r.course_code or "", r.course_name or "", r.category, r.unknown) for r in found.collect())
    b1, b2, null = (0, 1, "b", "b", "x", True), (1, 0, "b", "b", "y", True), (1, 1, "", "", "y", True)
    a = (0, 0, "a", "Algebra", "k", False)
    assert got == sorted([(0, *a), (0, *b1), (0, *b2), (0, *null), (1, *b1), (1, *b2), (1, *null), (2, *a), (2, *null)])
    assert "LeftAnti" not in plan and plan.count("SortMergeJoin") == 1  # of pairs and what their sets took
