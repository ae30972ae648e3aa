"""Cell masks and the statistics that a factor update needs.

For a target mode, every cell of the other two modes has a mask w over the target's columns: for CP the AND of its two rows,
for Tucker the OR of bit a over core entries (a, b, c) whose b and c its rows have. A cell of row m is covered if m & w <> 0.
S(row, w) counts nonzeros, H(w) counts cells; masks of 0 are left out, as no column can cover their cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.operators.tensor import MODES, length
from bitloom.schema import BROADCAST_ROWS, MOST_RANK, Dims


def bounded(masks: DataFrame, rows: int) -> DataFrame:
    """masks, to be broadcast if it has few enough rows; else joins are shuffled."""
    return F.broadcast(masks) if rows <= BROADCAST_ROWS else masks


def joined(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], columns: str) -> DataFrame:
    """The tensor with a column m_<c> for each of the given columns: the bit row of that index."""
    for c in columns:
        side = masks[c].select(F.col("idx").alias(c), F.col("m").alias(f"m_{c}"))
        tensor = tensor.join(bounded(side, length(dims, c)), c)
    return tensor


def histogram(masks: DataFrame) -> DataFrame:
    """(m, n): how many rows have each mask."""
    return masks.groupBy("m").agg(F.count("*").alias("n"))


def core_for(core: DataFrame | None, mode: int) -> DataFrame | None:
    """(a, b, c): the core with the target's column first, then that of the slow mode, then that of the fast one."""
    if core is None:
        return None
    at = {"i": "r1", "j": "r2", "k": "r3"}
    target, slow, fast = MODES[mode]
    return core.select(F.col(at[target]).alias("a"), F.col(at[slow]).alias("b"), F.col(at[fast]).alias("c"))


def cell_masks(pairs: DataFrame, core: DataFrame | None) -> DataFrame:
    """pairs of masks (s, f) of the slow and the fast mode, with w: the mask of their cells. Masks of 0 are left out.

    A core has as many rows as the ranks allow and is broadcast; pairs meet it by the columns of their slow mode's row.
    """
    if core is None:
        return pairs.withColumn("w", F.col("s").bitwiseAND(F.col("f"))).where("w <> 0")
    has = F.call_function("shiftright", F.col("f"), F.col("c")).bitwiseAND(F.lit(1).cast("long")) == 1
    each = pairs.select("s", "f").distinct().select("s", "f", F.explode(bits.columns_of(F.col("s"), MOST_RANK)).alias("b"))
    found = each.join(F.broadcast(core.withColumn("b", F.col("b").cast(each.schema["b"].dataType))), "b").where(has)
    found = found.groupBy("s", "f").agg(F.bit_or(bits.bit(F.col("a"))).alias("w"))
    return pairs.join(found, ["s", "f"])


def statistics(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], mode: int, core: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S (row, w, cnt) and H (w, h). The tensor is aggregated once, to counts of (row, s, f)."""
    row, slow, fast = MODES[mode]
    own = core_for(core, mode)
    counted = joined(tensor, dims, masks, slow + fast).groupBy(F.col(row).alias("row"), F.col(f"m_{slow}").alias("s"), F.col(f"m_{fast}").alias("f")).agg(F.count("*").alias("cnt"))
    s = cell_masks(counted, own).groupBy("row", "w").agg(F.sum("cnt").alias("cnt"))
    a, b = histogram(masks[slow]), histogram(masks[fast])
    small, large = (a, b) if length(dims, slow) <= length(dims, fast) else (b, a)
    names = ("s", "f") if small is a else ("f", "s")
    small = small.select(F.col("m").alias(names[0]), F.col("n").alias("n1"))
    large = large.select(F.col("m").alias(names[1]), F.col("n").alias("n2"))
    rows = min(length(dims, slow), length(dims, fast))
    pairs = large.join(bounded(small, rows), F.lit(True))  # distinct masks, not cells
    h = cell_masks(pairs, own).groupBy("w").agg(F.sum(F.col("n1") * F.col("n2")).cast("long").alias("h"))
    return s, h


def patterns(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame]) -> DataFrame:
    """(a, b, c, cnt): nonzeros by the masks of their three rows."""
    three = joined(tensor, dims, masks, "ijk")
    return three.groupBy(F.col("m_i").alias("a"), F.col("m_j").alias("b"), F.col("m_k").alias("c")).agg(F.count("*").alias("cnt"))
