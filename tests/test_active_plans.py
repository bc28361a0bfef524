"""Active plans are listed with or without subscribers; the README names their fixed input."""

import os

from support import ROOT
from mealops.operators import subs


def test_active_plans_need_no_subscribers(spark):
    plans = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "never sold", True)],
                                  "plan_id int, name string, is_active boolean")
    assert sorted(map(tuple, subs.active_plans(plans).collect())) == [(1, "a"), (3, "never sold")]


def test_readme_lists_the_fixed_input():
    text = open(os.path.join(ROOT, "README.md"), encoding="utf-8").read()
    assert "`active_plans` (#22) has a fixed input" in text
