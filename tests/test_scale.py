"""The ways for large tables give the same as the ways for small ones and as brute force."""

import random as rnd

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions.select import kth
from bitloom.operators import update
from bitloom.plans import core as core_plan
from bitloom.plans import random
from tests.test_factorize import DIMS, brute_core, case, tables, tensor_of


@pytest.mark.parametrize("values", [[7], [5, 5, 5, 9], [-(1 << 63), (1 << 63) - 1, 0, -1, 1], [k * k - 40_000 for k in range(300)] * 2])
def test_kth(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in {1, len(values) // 2 + 1, len(values)}:
        found = sorted(values)[k - 1]
        assert kth(df, "v", k) == (found, sum(v < found for v in values))


def test_capped_breaks_ties_by_row(spark):
    rows = [(k, 0, [3, 3, 0, 8][k % 4], 0) for k in range(40)] + [(40, 1, -2, 1)]
    df = spark.createDataFrame(rows, "idx long, m long, d long, bit int")
    for most in (1.0, 0.5, 0.0):
        zeros = sorted((d, i) for i, _, d, b in rows if not b)
        turned = {i for _, i in zeros[: max(0, len(zeros) - int(41 * most))]}
        assert {r.idx: r.bit for r in update.capped(df, 41, most).collect()} == {i: int(b or i in turned) for i, _, d, b in rows}


@pytest.mark.parametrize("rank", [5, 13, 63])
def test_disjoint_sums(spark, rank):
    draw = rnd.Random(rank)
    mask = lambda: sum(1 << draw.randrange(rank) for _ in range(1)) | 1 << draw.randrange(rank)
    kinds, weights = {0, *(mask() for _ in range(60))}, [(mask(), draw.randint(1, 9)) for _ in range(60)]
    found = update.disjoint_sums(spark.createDataFrame([(m,) for m in kinds], "m long"), spark.createDataFrame(weights, "w long, h long"), rank)
    expected = {m: sum(h for w, h in weights if not w & m) for m in kinds}
    assert {r.m: r.total for r in found.collect()} == {m: t for m, t in expected.items() if t}


def test_updates_use_joins_on_keys_only(spark):
    x, factors, _ = case(3)
    masks = tables(spark, factors)
    s = spark.createDataFrame([(0, 3, 1)], "row long, w long, cnt long")
    h = spark.createDataFrame([(3, 1)], "w long, h long")
    plan = update.deltas(masks["i"], s, h, 1, 30)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("density", [0.1, 0.6])
def test_first_cells_by_threshold(spark, monkeypatch, density):
    cells = lambda: sorted(map(tuple, random.cells(spark, (20, 30, 10), density, 3).collect()))
    heap = cells()
    monkeypatch.setattr(random, "SORTED", 0)
    assert cells() == heap and len(set(heap)) == int(density * 6000)


@pytest.mark.parametrize("seed", [11, 13])
def test_core_sweep_over_stored_patterns(spark, seed):
    x, factors, core = case(seed)
    patterns = core_plan.Patterns(tensor_of(spark, x), DIMS, tables(spark, factors), most=1)
    assert patterns.stored
    assert core_plan.sweep(patterns, core, (3, 3, 3))[0] == brute_core(x, factors, core, (3, 3, 3))


def test_empty_tables(spark):
    none = spark.range(0)
    assert update.disjoint_sums(none.select(F.col("id").alias("m")), none.select(F.col("id").alias("w"), F.col("id").alias("h")), 7).count() == 0
    assert np.array_equal(random.cells(spark, (2, 2), 0.0, 1).collect(), [])
