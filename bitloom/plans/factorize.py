"""Boolean CP and Tucker factorization by alternating greedy updates.

Each factor update aggregates the tensor once to the statistics S and H (operators.masks) and then sweeps over its columns. If
those are small (MOST_STATISTICS rows) the sweep runs on the driver in numpy; otherwise each column is a distributed update whose
result is checkpointed. Both give the same bits. Masks are all that passes from one update to the next, so that plans do
not grow.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits, draw
from bitloom.functions.select import cut
from bitloom.operators import masks as mk
from bitloom.operators import matrix, reconstruct, update
from bitloom.operators.tensor import MODES, length
from bitloom.plans import core as core_plan
from bitloom.plans import random
from bitloom.schema import CORE, MASKS, Config

log = logging.getLogger("bitloom")
#: Rows of S, H and the factor, of up to 24 bytes, up to which a sweep runs on the driver.
MOST_STATISTICS = 500_000


@dataclass
class Model:
    masks: dict[str, DataFrame]
    core: set[tuple[int, int, int]] | None = None
    delta: int = 0
    bit_updates: int = 0
    core_seconds: float = 0.0


@dataclass
class Result:
    model: Model
    history: list[dict] = field(default_factory=list)
    error: int | None = None
    factor_seconds: float = 0.0
    core_seconds: float = 0.0


def core_table(spark: SparkSession, core: set[tuple[int, int, int]] | None) -> DataFrame | None:
    return None if core is None else spark.createDataFrame(sorted(core), CORE)


def start(spark: SparkSession, config: Config, candidate: int) -> Model:
    seed = (config.seed or 0) * 1000 + candidate * 10
    masks = {}
    for n, (c, rows, rank) in enumerate(zip("ijk", config.dims, config.all_ranks, strict=True)):
        masks[c] = cut(matrix.bit_rows(random.factor(spark, rows, rank, config.density, seed + n), rows))
    core = None
    if config.method == "tk":
        core = {tuple(r) for r in random.core(spark, config.ranks, config.core_density, seed + 3).collect()}
    return Model(masks, core)


def factor_sweep(tensor: DataFrame, config: Config, model: Model, mode: int, iteration: int) -> Model:
    """model with the factor of a mode updated, columns in order, and the sums of what changed."""
    spark, column = tensor.sparkSession, MODES[mode][0]
    rows, rank = length(config.dims, column), config.all_ranks[mode - 1]
    s, h = mk.statistics(tensor, config.dims, model.masks, mode, core_table(spark, model.core))
    s, h = s.cache(), h.cache()
    try:
        if rows + s.count() + h.count() <= MOST_STATISTICS:
            masks, delta, changes = _small(spark, s, h, model.masks[column], rows, rank, config, mode, iteration)
        else:
            masks, delta, changes = _large(s, h, model.masks[column], rows, rank, config, mode, iteration)
    finally:
        s.unpersist()
        h.unpersist()
    return replace(model, masks=model.masks | {column: masks}, delta=model.delta + delta, bit_updates=model.bit_updates + changes)


def _large(s: DataFrame, h: DataFrame, masks: DataFrame, rows: int, rank: int, config: Config, mode: int, iteration: int) -> tuple[DataFrame, int, int]:
    delta = changes = 0
    for r in range(rank):
        tie = update.tie_draw(config.seed or 0, config.zero_probability, F.col("idx"), iteration, mode, r)
        new = cut(update.column_update(masks, s, h, r, rows, config.most_zeros, tie, rank))
        found = update.column_delta(new).first()
        delta, changes, masks = delta + (found["delta"] or 0), changes + (found["bit_updates"] or 0), new.select("idx", "m")
    return masks, delta, changes


def _small(spark: SparkSession, s: DataFrame, h: DataFrame, masks: DataFrame, rows: int, rank: int, config: Config, mode: int, iteration: int) -> tuple[DataFrame, int, int]:
    found = masks.toArrow()
    m = np.zeros(rows, np.int64)
    m[found["idx"].to_numpy()] = found["m"].to_numpy()
    st, ht = s.toArrow(), h.toArrow()
    row, w, cnt = (st[c].to_numpy().astype(np.int64) for c in ("row", "w", "cnt"))
    hw, hn = (ht[c].to_numpy().astype(np.int64) for c in ("w", "h"))
    most, delta, changes = int(rows * config.most_zeros), 0, 0
    for r in range(rank):
        bit = np.int64(1 << r)
        rest = m & ~bit
        ones = np.zeros(rows, np.int64)
        use = ((w & bit) != 0) & ((rest[row] & w) == 0)
        np.add.at(ones, row[use], cnt[use])
        kinds, kind = np.unique(rest, return_inverse=True)
        own = (hw & bit) != 0
        whole = np.array([hn[own & ((hw & k) == 0)].sum() for k in kinds], np.int64)
        d = whole[kind] - 2 * ones
        new = (d < 0).astype(np.int64)
        for idx in np.flatnonzero(d == 0) if config.zero_probability < 1 else ():
            new[idx] = draw.uniform_of(config.seed or 0, iteration, mode, r, int(idx)) > config.zero_probability
        zeros = np.flatnonzero(new == 0)
        if config.most_zeros < 1 and len(zeros) > most:
            new[zeros[np.lexsort((zeros, d[zeros]))][: len(zeros) - most]] = 1
        old = (m >> r) & 1
        delta += int((d * (new - old)).sum())
        changes += int((new != old).sum())
        m = rest | (new << r)
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(m)], MASKS), delta, changes


def sweep(tensor: DataFrame, config: Config, model: Model, iteration: int) -> Model:
    """One iteration: for Tucker first the core, whose change is not in the delta, then the three factors."""
    model, began = replace(model, delta=0, bit_updates=0, core_seconds=0.0), time.time()
    if model.core is not None:
        found, _ = core_plan.sweep(core_plan.Patterns(tensor, config.dims, model.masks), model.core, config.ranks)
        model = replace(model, core=found, core_seconds=time.time() - began)
    for mode in (1, 2, 3):
        model = factor_sweep(tensor, config, model, mode, iteration)
    return model


def model_error(tensor: DataFrame, config: Config, model: Model) -> dict:
    return reconstruct.error(tensor, config.dims, model.masks, core_table(tensor.sparkSession, model.core), config.all_ranks[0]).first().asDict()


class Convergence:
    """Stops at the number of iterations, or once the error delta was under the threshold so many times in a row."""

    def __init__(self, config: Config):
        self.config, self.quiet = config, 0

    def reached(self, iteration: int, delta: int) -> bool:
        c = self.config
        if c.error_delta is not None:
            self.quiet = self.quiet + 1 if abs(delta) < c.error_delta else 0
            if self.quiet >= c.consecutive:
                return True
        return c.iterations is not None and iteration >= c.iterations


def factorize(tensor: DataFrame, config: Config, compute_error: str | None = None) -> Result:
    """Factorize the tensor. The first iteration updates each candidate set and keeps the one whose error fell most (ties: the
    first). compute_error is every (the least error over iterations is reported, the last model kept), end or None."""
    spark, stop = tensor.sparkSession, Convergence(config)
    tensor = tensor.cache()
    result = Result(Model({}))
    try:
        model, iteration = None, 0
        while True:
            iteration += 1
            began = time.time()
            if model is None:
                tried = [sweep(tensor, config, start(spark, config, k), iteration) for k in range(config.candidates)]
                model, core_seconds = min(tried, key=lambda t: t.delta), sum(t.core_seconds for t in tried)
            else:
                model = sweep(tensor, config, model, iteration)
                core_seconds = model.core_seconds
            result.core_seconds += core_seconds
            result.factor_seconds += time.time() - began - core_seconds
            step = {"iteration": iteration, "delta": model.delta, "bit_updates": model.bit_updates}
            if compute_error == "every":
                step |= model_error(tensor, config, model)
            result.history.append(step)
            log.info("%s", step)
            if stop.reached(iteration, model.delta):
                break
        result.model = model
        if compute_error == "every":
            result.error = min(s["abs_error"] for s in result.history)
        elif compute_error == "end":
            result.error = model_error(tensor, config, model)["abs_error"]
    finally:
        tensor.unpersist()
    return result


def entries(model: Model, ranks: tuple[int, int, int]) -> DataFrame:
    """(mode, idx, r) of the factors."""
    parts = [model.masks[c].select(F.lit(n).alias("mode"), "idx", F.explode(bits.columns_of(F.col("m"), ranks[n - 1]).cast("array<bigint>")).alias("r")) for n, c in enumerate("ijk", 1)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
