"""Percentiles by counts of order bits, against numpy."""

from __future__ import annotations

import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from evalframe.operators import sampling

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@settings(max_examples=30, deadline=None)
@given(s.lists(s.floats(allow_nan=False), min_size=1, max_size=60))
def test_order_bits_are_those_of_the_doubles(spark, values):
    got = [r.b for r in spark.createDataFrame([(x,) for x in values], "v double").select(sampling.order_bits(F.col("v")).alias("b")).collect()]
    size = [struct.unpack("<q", struct.pack("<d", abs(x)))[0] for x in values]
    assert got == [-b if x < 0 else b for x, b in zip(values, size, strict=True)]


def _check(spark, rows, **more):
    got = {r.k: r for r in sampling.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", SHARES).collect()}
    own = {}
    for k, v in rows:
        if v is not None and v == v:
            own.setdefault(k, []).append(v)
    assert set(got) == set(own)
    for k, values in own.items():
        assert got[k].n == len(values)
        for name, q in SHARES.items():
            assert got[k][name] == pytest.approx(float(np.percentile(values, q * 100)), rel=1e-12, abs=1e-300), (k, name)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_as_numpy_counts_them(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sampling, "BROADCAST", broadcast)
    rng = np.random.default_rng(3)
    wild = (rng.normal(size=800) * 10.0 ** rng.integers(-200, 200, 800)).tolist()
    close = (1.0 + rng.integers(0, 50, 500) * 2.0**-52).tolist()  # told apart by the last bits alone
    rows = [("wild", x) for x in wild] + [("close", x) for x in close] + [("one", 7.0)] * 2000 + [("few", float(x)) for x in (3, 1, 2)] + [(None, x) for x in (-0.0, 0.0, 5e-324, -5e-324, -1.5)] + [("none", None), ("nan", float("nan")), ("few", None)]
    _check(spark, rows)


def test_empty(spark):
    assert sampling.percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", SHARES).collect() == []


def test_nothing_but_counts_is_sorted(spark, monkeypatch):
    plans = []
    real = sampling.materialise

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(sampling, "materialise", keep)
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.sqrt(F.col("id").cast("double")) * 1e3).alias("v"))
    last = sampling.percentiles(rows, ["k"], "v", SHARES)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 5 and not any("rangepartitioning" in p for p in plans)
    sorts = [x for p in plans for x in re.findall(r"\bSort \[(.*?)\]", p)]
    assert sorts and not any("__v" in x or "__bits" in x for x in sorts)
