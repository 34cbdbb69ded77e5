"""Facts are dealt out by how many they are, and what is ranked at rows gives what moving rows gives."""

import os

import pytest

from peerlens.plans import definitions, fixture

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_tasks_hold_so_many_lines_whatever_the_size(spark, monkeypatch):
    for totals in (fixture.stats, definitions.line_stats):
        plain = sorted(map(repr, totals(spark, DATA).collect()))
        with monkeypatch.context() as m:
            m.setattr(fixture, "TASK_LINES", 500)
            many = totals(spark, DATA)
            exchanges = [x for x in many._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
            assert exchanges and all(", REPARTITION_BY_NUM" in x and "12), REPARTITION" in x for x in exchanges)
            assert sorted(map(repr, many.collect())) == plain and plain
