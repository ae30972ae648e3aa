"""The greedy update of one column of a factor: error changes, choice of bits, cap of zeros, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits, draw
from bitloom.functions.select import cut, kth
from bitloom.schema import MOST_RANK

#: Bits of a mask that one step of disjoint_sums settles: a row becomes at most 2 ** STEP.
STEP = 6


def disjoint_sums(kinds: DataFrame, weights: DataFrame, rank: int) -> DataFrame:
    """(m, total): for each mask m of kinds, the sum of h over the rows (w, h) of weights whose w shares no bit with m; masks
    without such a row are left out.

    Bits are settled in steps from the lowest. After a step, weights whose bits above are equal are summed for each beginning p
    that a mask has, so no mask meets each weight, and all joins are on equal keys.
    """
    state = weights.select(F.lit(0).cast("long").alias("p"), F.col("w").alias("rest"), "h")
    for low in range(0, rank, STEP):
        width = min(STEP, rank - low)
        values = F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long"))
        free = F.filter(values, lambda v: v.bitwiseAND(F.col("rest")) == 0)
        state = state.select("p", F.explode(free).alias("v"), F.shiftrightunsigned("rest", width).alias("rest"), "h")
        state = state.select(F.col("p").bitwiseOR(F.shiftleft("v", low)).alias("p"), "rest", "h")
        begins = kinds.select(F.col("m").bitwiseAND(F.lit((1 << low + width) - 1).cast("long")).alias("p")).distinct()
        state = state.join(begins, "p", "left_semi").groupBy("p", "rest").agg(F.sum("h").alias("h"))
    return state.select(F.col("p").alias("m"), F.col("h").alias("total"))


def deltas(masks: DataFrame, s: DataFrame, h: DataFrame, r: int, rank: int = MOST_RANK) -> DataFrame:
    """(idx, m, d): the error with bit r set less that without it, everything else fixed.

    d sums H(w) - 2 * S(row, w) over the masks w that have bit r and share no other bit with the row. The part of H depends on
    the row's bits alone, so it is computed once for each distinct row.
    """
    bit = F.lit(1 << r).cast("long")
    others = F.bitwise_not(bit)
    decides = (F.col("w").bitwiseAND(bit) != 0) & (F.col("m").bitwiseAND(F.col("w")).bitwiseAND(others) == 0)
    kinds = masks.select(F.col("m").bitwiseAND(others).alias("m")).distinct()
    own = h.where(F.col("w").bitwiseAND(bit) != 0).select(F.col("w").bitwiseAND(others).alias("w"), "h")
    base = disjoint_sums(kinds, own, rank).withColumnRenamed("m", "kind")
    hit = s.join(masks, F.col("row") == F.col("idx")).where(decides).groupBy("idx").agg(F.sum("cnt").cast("long").alias("ones"))
    found = masks.join(base, F.col("m").bitwiseAND(others) == F.col("kind"), "left").join(hit, "idx", "left")
    return found.select("idx", "m", (F.coalesce("total", F.lit(0)) - 2 * F.coalesce("ones", F.lit(0))).cast("long").alias("d"))


def choice(d: Column, tie: Column) -> Column:
    """The bit with the lower error; tie is the bit where both are equal."""
    return F.when(d < 0, 1).when(d > 0, 0).otherwise(tie).cast("int")


def tie_draw(seed: int, zero_probability: float, idx: Column, *key: int) -> Column:
    if zero_probability >= 1:
        return F.lit(0)
    return F.when(draw.uniform(seed, *(F.lit(k) for k in key), idx) <= zero_probability, 0).otherwise(1)


def capped(chosen: DataFrame, rows: int, most_zeros: float) -> DataFrame:
    """(idx, m, d, bit): chosen, with the cheapest surplus zeros turned to ones, by (d, idx), so that at most
    floor(rows * most_zeros) are left. The place of the last one turned is found by counts; no row is sorted or moved."""
    chosen = cut(chosen)
    zeros = chosen.where("bit = 0")
    surplus = zeros.count() - int(rows * most_zeros)
    if surplus <= 0:
        return chosen
    d, below = kth(zeros, "d", surplus)
    idx, _ = kth(zeros.where(F.col("d") == d), "idx", surplus - below)
    turned = (F.col("bit") == 0) & ((F.col("d") < d) | ((F.col("d") == d) & (F.col("idx") <= idx)))
    return chosen.withColumn("bit", F.when(turned, 1).otherwise(F.col("bit")))


def column_update(masks: DataFrame, s: DataFrame, h: DataFrame, r: int, rows: int, most_zeros: float = 1.0, tie: Column | None = None, rank: int = MOST_RANK) -> DataFrame:
    """(idx, d, old, bit, m): the chosen bit r of each row, and the row with it."""
    found = deltas(masks, s, h, r, rank)
    found = found.withColumn("bit", choice(F.col("d"), F.lit(0) if tie is None else tie))
    if most_zeros < 1:
        found = capped(found, rows, most_zeros)
    return found.select("idx", "d", bits.get_bits(F.col("m"), r, r).cast("int").alias("old"), "bit", bits.set_bits(F.col("m"), r, r, F.col("bit")).alias("m"))


def column_delta(updated: DataFrame) -> DataFrame:
    """(delta, bit_updates): the change of the error and the number of bits that a column update changed."""
    return updated.agg(F.sum(F.col("d") * (F.col("bit") - F.col("old"))).cast("long").alias("delta"), F.sum(F.abs(F.col("bit") - F.col("old"))).cast("long").alias("bit_updates"))
