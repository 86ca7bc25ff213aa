"""The star over the driver's tables: how its rows are dealt out."""

from __future__ import annotations

import pytest

from evalframe.operators import items, outcomes
from evalframe.sources import star

DATA = "/root/testdata/sf0.001"


def test_tasks_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(star, "ROWS", 300)
    n = star.table(spark, DATA, "lineitem").count()
    sizes = star.latest_lines(spark, DATA).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= n / 300 > 8 and max(sizes) <= 600


@pytest.mark.parametrize("rows, least, most", [(300, 20, 30), (10, 200, 200), (2, 600, 700)])
def test_tasks_are_no_more_than_are_written_unsorted_until_they_are_full(spark, monkeypatch, rows, least, most):
    """Of more than 200 partitions Spark sorts what it writes, so a task would hold all rows of its split."""
    monkeypatch.setattr(star, "ROWS", rows)
    lines = star.latest_lines(spark, DATA)
    assert least <= lines.rdd.getNumPartitions() <= most
    assert lines.count() == star.table(spark, DATA, "lineitem").selectExpr("l_suppkey % 2", "l_orderkey", "(l_linenumber - 1) % 3").distinct().count()


@pytest.mark.parametrize("what", [lambda r, i: items.votes(r), items.by_item, items.by_item_voted, outcomes.item_outcomes])
def test_line_items_are_shuffled_once(spark, what):
    """What follows by item goes on where the rows lie; the items, which are few here, are broadcast."""
    plan = what(star.responses(spark, DATA), star.items(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
