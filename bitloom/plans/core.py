"""The sweep over the core of a Tucker model.

For each cell of the core, in lexicographic order, look at the cells of the tensor that it stands for (its support). Let s1, s2,
s3 be how many used columns the rows of such a cell have; a column is used if the core has an entry with it. An absent
element is set if the support has a nonzero with s1, s2 or s3 = 0, which nothing can cover. A present one is cleared if the
support has a zero with s1 = s2 = s3 = 1, which it alone covers. Both ask for existence, not for a net gain, so a sweep can
raise the error.

Only the masks of rows matter, so one aggregation of the tensor to patterns of masks (and three histograms) answers all of
the sweep. The walk over the core is sequential by its rule.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.select import cut
from bitloom.operators import masks as mk
from bitloom.schema import Dims


#: Patterns of masks, of 32 bytes, up to which a sweep runs on the driver.
MOST_PATTERNS = 500_000


class Patterns:
    """Counts of nonzeros by mask patterns, and of rows by mask, on the driver if there are few, else in the checkpoint folder."""

    def __init__(self, tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], most: int = MOST_PATTERNS):
        tables = [mk.patterns(tensor, dims, masks), *(mk.histogram(masks[c]) for c in "ijk")]
        few = [t.limit(most + 1).toArrow() for t in tables]
        self.stored = None
        if max(t.num_rows for t in few) > most:
            self.stored = [cut(t) for t in tables]
            return
        few = [[t[c].to_numpy().astype(np.int64) for c in t.column_names] for t in few]
        self.rows, self.cnt, self.of = few[0][:3], few[0][3], few[1:]

    def uncovered_nonzero(self, cell: tuple[int, int, int], used: list[int]) -> bool:
        """Whether the support of cell has a nonzero of which a row has no used column."""
        if self.stored:
            support, empty = F.lit(True), F.lit(False)
            for c, r, u in zip("abc", cell, used, strict=True):
                support, empty = support & _has(c, r), empty | (F.col(c).bitwiseAND(F.lit(u).cast("long")) == 0)
            return not self.stored[0].where(support & empty).isEmpty()
        support = np.all([m >> r & 1 for m, r in zip(self.rows, cell, strict=True)], axis=0)
        empty = np.any([(m & u) == 0 for m, u in zip(self.rows, used, strict=True)], axis=0)
        return bool((support & empty).any())

    def lone_zero(self, cell: tuple[int, int, int], used: list[int]) -> bool:
        """Whether the support of cell has a zero of which each row has one used column only: whether there are more such cells
        than nonzeros among them."""
        if self.stored:
            lone = lambda c, r, u: _has(c, r) & (F.bit_count(F.col(c).bitwiseAND(F.lit(u).cast("long"))) == 1)
            total = lambda t, n, on: t.where(on).agg(F.sum(n)).first()[0] or 0
            cells = math.prod(total(t, "n", lone("m", r, u)) for t, r, u in zip(self.stored[1:], cell, used, strict=True))
            return cells > total(self.stored[0], "cnt", reduce(Column.__and__, (lone(c, r, u) for c, r, u in zip("abc", cell, used, strict=True))))
        lone = lambda m, r, u: (m >> r & 1 == 1) & (np.bitwise_count(m & u) == 1)
        cells = math.prod(int(n[lone(m, r, u)].sum()) for (m, n), r, u in zip(self.of, cell, used, strict=True))
        hits = np.all([lone(m, r, u) for m, r, u in zip(self.rows, cell, used, strict=True)], axis=0)
        return cells > int(self.cnt[hits].sum())


def used_columns(core: set[tuple[int, int, int]]) -> list[int]:
    out = [0, 0, 0]
    for cell in core:
        out = [u | 1 << r for u, r in zip(out, cell, strict=True)]
    return out


def sweep(patterns: Patterns, core: set[tuple[int, int, int]], ranks: tuple[int, int, int]) -> tuple[set[tuple[int, int, int]], int]:
    """The core after one sweep, and how many elements changed."""
    core, changes = set(core), 0
    used = used_columns(core)
    for cell in np.ndindex(*ranks):
        flip = patterns.lone_zero(cell, used) if cell in core else patterns.uncovered_nonzero(cell, used)
        if flip:
            core ^= {cell}
            used, changes = used_columns(core), changes + 1
    return core, changes


def _has(column: str, r: int):
    return F.col(column).bitwiseAND(F.lit(1 << r).cast("long")) != 0


def gain_add(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], core: set, cell: tuple[int, int, int]) -> DataFrame:
    """(gain): 1 if the support of an absent element has a nonzero that nothing can cover."""
    used = [F.lit(u).cast("long") for u in used_columns(core)]
    rows = mk.joined(tensor, dims, masks, "ijk").where(_has("m_i", cell[0]) & _has("m_j", cell[1]) & _has("m_k", cell[2]))
    empty = [F.col(f"m_{c}").bitwiseAND(u) == 0 for c, u in zip("ijk", used, strict=True)]
    return rows.agg(F.coalesce(F.max((empty[0] | empty[1] | empty[2]).cast("long")), F.lit(0)).alias("gain"))


def gain_remove(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], core: set, cell: tuple[int, int, int]) -> DataFrame:
    """(gain): 1 if the support of a present element has a zero that it alone covers: fewer nonzeros than such cells."""
    lone = {}
    for c, r, u in zip("ijk", cell, used_columns(core), strict=True):
        m = masks[c]
        lone[c] = m.where(_has("m", r) & (F.bit_count(F.col("m").bitwiseAND(F.lit(u).cast("long"))) == 1))
    cells = None
    for c in "ijk":
        n = lone[c].agg(F.count("*").alias(f"n_{c}"))
        cells = n if cells is None else cells.join(F.broadcast(n), F.lit(True))  # one row each
    hits = mk.joined(tensor, dims, lone, "ijk").agg(F.count("*").alias("hits"))
    found = cells.join(F.broadcast(hits), F.lit(True))
    return found.select((F.col("n_i") * F.col("n_j") * F.col("n_k") > F.col("hits")).cast("long").alias("gain"))
