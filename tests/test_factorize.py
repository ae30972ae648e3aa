"""Factorization against brute force on small tensors."""

import itertools

import numpy as np
import pytest

from bitloom import schema
from bitloom.operators import masks as mk
from bitloom.operators import matrix, reconstruct, update
from bitloom.plans import core as core_plan
from bitloom.plans import factorize
from bitloom.schema import Config, Dims

DIMS = Dims(7, 5, 6)


def bits(f):
    return [int(sum(1 << r for r in np.flatnonzero(row))) for row in f]


def tables(spark, factors):
    return {c: spark.createDataFrame(list(enumerate(bits(f))), schema.MASKS) for c, f in zip("ijk", factors, strict=True)}


def tensor_of(spark, x):
    return spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(x)], schema.TENSOR)


def rebuilt(factors, core):
    a, b, c = factors
    out = np.zeros((len(a), len(b), len(c)), bool)
    for r1, r2, r3 in core:
        out |= a[:, r1, None, None] & b[None, :, r2, None] & c[None, None, :, r3]
    return out


def case(seed, rank=3):
    rng = np.random.default_rng(seed)
    x = rng.random(tuple(DIMS)) < 0.3
    factors = [rng.random((n, rank)) < 0.4 for n in DIMS]
    core = {tuple(map(int, c)) for c in np.argwhere(rng.random((rank,) * 3) < 0.3)}
    return x, factors, core


@pytest.mark.parametrize("tucker", [False, True])
@pytest.mark.parametrize("mode", [1, 2, 3])
def test_deltas_are_differences_of_errors(spark, mode, tucker):
    x, factors, core = case(mode)
    core = core if tucker else {(r, r, r) for r in range(3)}
    masks = tables(spark, factors)
    own = factorize.core_table(spark, core) if tucker else None
    s, h = mk.statistics(tensor_of(spark, x), DIMS, masks, mode, own)
    for r in range(3):
        found = {row.idx: row.d for row in update.deltas(masks["ijk"[mode - 1]], s, h, r).collect()}
        for i in range(len(factors[mode - 1])):
            errors = []
            for v in (True, False):
                tried = [f.copy() for f in factors]
                tried[mode - 1][i, r] = v
                errors.append(int((rebuilt(tried, core) != x).sum()))
            assert found[i] == errors[0] - errors[1]


def test_error_equals_cells_that_differ(spark):
    x, factors, core = case(5)
    masks = tables(spark, factors)
    for own, cells in ((None, {(r, r, r) for r in range(3)}), (core, core)):
        row = reconstruct.error(tensor_of(spark, x), DIMS, masks, factorize.core_table(spark, own)).first()
        model = rebuilt(factors, cells)
        assert (row.nnz, row.recon_nnz, row.hits, row.abs_error) == (x.sum(), model.sum(), (model & x).sum(), (model != x).sum())
        assert row.rel_error == pytest.approx((model != x).sum() / DIMS.cells)


def test_superdiagonal_core_is_cp(spark):
    x, factors, _ = case(6)
    t, masks = tensor_of(spark, x), tables(spark, factors)
    diagonal = {(r, r, r) for r in range(3)}
    cp = reconstruct.error(t, DIMS, masks).first()
    assert reconstruct.error(t, DIMS, masks, factorize.core_table(spark, diagonal)).first() == cp


@pytest.mark.parametrize("most_zeros", [1.0, 0.5])
def test_distributed_and_driver_sweeps_agree(spark, monkeypatch, most_zeros):
    x, factors, _ = case(7)
    t, config = tensor_of(spark, x), Config(DIMS, "cp", rank=3, seed=4, most_zeros=most_zeros)
    results = []
    for most in (factorize.MOST_STATISTICS, 0):
        monkeypatch.setattr(factorize, "MOST_STATISTICS", most)
        model = factorize.sweep(t, config, factorize.Model(tables(spark, factors)), 1)
        results.append(({c: sorted(map(tuple, m.collect())) for c, m in model.masks.items()}, model.delta, model.bit_updates))
    assert results[0] == results[1]


def test_factor_sweep_never_raises_the_error_and_its_delta_is_the_change(spark):
    x, factors, core = case(8)
    t = tensor_of(spark, x)
    config = Config(DIMS, "tk", ranks=(3, 3, 3), core_density=0.1, seed=1, most_zeros=1.0)
    model = factorize.Model(tables(spark, factors), core)
    for mode in (1, 2, 3):
        before = factorize.model_error(t, config, model)["abs_error"]
        after_model = factorize.factor_sweep(t, config, factorize.Model(model.masks, core), mode, 1)
        after = factorize.model_error(t, config, after_model)["abs_error"]
        assert after <= before and after - before == after_model.delta
        model = after_model


def brute_core(x, factors, core, ranks):
    core = set(core)
    for cell in itertools.product(*map(range, ranks)):
        used = [{c[n] for c in core} for n in range(3)]
        ones = [[sum(f[i, r] for r in u) for i in range(len(f))] for f, u in zip(factors, used, strict=True)]
        flip = False
        for i, j, k in np.ndindex(x.shape):
            if factors[0][i, cell[0]] and factors[1][j, cell[1]] and factors[2][k, cell[2]]:
                s = (ones[0][i], ones[1][j], ones[2][k])
                flip |= (not x[i, j, k] and s == (1, 1, 1)) if cell in core else bool(x[i, j, k] and 0 in s)
        if flip:
            core ^= {cell}
    return core


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_core_sweep_follows_its_rule(spark, seed):
    x, factors, core = case(seed)
    patterns = core_plan.Patterns(tensor_of(spark, x), DIMS, tables(spark, factors))
    assert core_plan.sweep(patterns, core, (3, 3, 3))[0] == brute_core(x, factors, core, (3, 3, 3))


def test_planted_model_stays(spark):
    _, factors, _ = case(14)
    x = rebuilt(factors, {(r, r, r) for r in range(3)})
    config = Config(DIMS, "cp", rank=3, seed=0, most_zeros=1.0, zero_probability=1.0)
    model = factorize.sweep(tensor_of(spark, x), config, factorize.Model(tables(spark, factors)), 1)
    assert factorize.model_error(tensor_of(spark, x), config, model)["abs_error"] == 0


def test_result_does_not_depend_on_partitions(spark):
    x, _, _ = case(15)
    config = Config(DIMS, "cp", rank=2, density=0.3, seed=9, iterations=2)
    found = [factorize.factorize(tensor_of(spark, x).repartition(n), config, "every").history for n in (1, 5)]
    assert found[0] == found[1]


def test_convergence():
    c = factorize.Convergence(Config(DIMS, "cp", rank=1, iterations=3))
    assert [c.reached(n, 5) for n in (1, 2, 3)] == [False, False, True]
    c = factorize.Convergence(Config(DIMS, "cp", rank=1, iterations=None, error_delta=2.0, consecutive=2))
    assert [c.reached(n, d) for n, d in enumerate((1, 5, 1, -1), 1)] == [False, False, False, True]


@pytest.mark.parametrize("bad", [{"rank": 0}, {"rank": 64}, {"rank": 2, "density": 1.5}, {"rank": 2, "iterations": None}, {"method": "x", "rank": 2}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        Config(DIMS, **bad)


def test_empty_tensor(spark):
    config = Config(DIMS, "tk", ranks=(2, 2, 2), density=0.2, core_density=0.2, seed=1, iterations=1)
    result = factorize.factorize(spark.createDataFrame([], schema.TENSOR), config, "end")
    assert result.error is not None and result.error >= 0


def test_error_of_more_cells_than_a_long_counts(spark):
    one = {c: spark.createDataFrame([(0, 1)], schema.MASKS) for c in "ijk"}
    row = reconstruct.error(spark.createDataFrame([(0, 0, 0)], schema.TENSOR), Dims(1 << 22, 1 << 22, 1 << 22), one).first()
    assert (row.nnz, row.recon_nnz, row.hits, row.abs_error, row.rel_error) == (1, 1, 1, 0, 0.0)


def test_row_summations_of_too_many_columns_are_refused(spark):
    with pytest.raises(ValueError):
        matrix.row_summations(spark.createDataFrame([(0, 0)], schema.FACTOR), matrix.MOST_SUMMED + 1)
