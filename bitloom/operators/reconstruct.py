"""Boolean reconstruction from factors, and its error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.operators import masks as mk
from bitloom.operators import update
from bitloom.operators.tensor import MODES
from bitloom.schema import MOST_RANK, Dims


def _kinds(entries: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a mode (index c, m_<c>) that have entries, and (m_<c>, r) of the distinct ones."""
    rows = entries.groupBy(F.col("idx").alias(c)).agg(F.bit_or(bits.bit(F.col("r"))).alias(f"m_{c}"))
    kinds = rows.select(f"m_{c}").distinct()
    return rows, kinds.select(f"m_{c}", F.explode(bits.columns_of(F.col(f"m_{c}"), MOST_RANK).cast("array<bigint>")).alias("r"))


def _cells(patterns: DataFrame, rows: list[DataFrame]) -> DataFrame:
    """The cells of patterns of rows. Patterns are distinct, and so are the cells."""
    patterns = patterns.select("m_i", "m_j", "m_k").distinct()
    for side, c in zip(rows, "ijk", strict=True):
        patterns = patterns.join(side, f"m_{c}")
    return patterns.select("i", "j", "k")


def cp(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """The cells that some column covers, from entries (idx, r). Only distinct rows meet by their columns."""
    rows, kinds = zip(*(_kinds(f, n) for f, n in zip((a, b, c), "ijk", strict=True)), strict=True)
    return _cells(kinds[0].join(kinds[1], "r").join(kinds[2], "r"), rows)


def tucker(core: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    rows, kinds = zip(*(_kinds(f, n) for f, n in zip((a, b, c), "ijk", strict=True)), strict=True)
    found = F.broadcast(core.select(*(F.col(n).cast("long").alias(n) for n in ("r1", "r2", "r3"))))
    for n, k in enumerate(kinds, 1):
        found = found.join(k.withColumnRenamed("r", f"r{n}"), f"r{n}")
    return _cells(found, rows)


def contains(cells: DataFrame, dims: Dims, masks: dict[str, DataFrame], core: DataFrame | None = None) -> DataFrame:
    """Cells with has: whether the reconstruction has them."""
    found = mk.joined(cells, dims, masks, "ijk")
    if core is None:
        return found.select("i", "j", "k", (F.col("m_i").bitwiseAND(F.col("m_j")).bitwiseAND(F.col("m_k")) != 0).alias("has"))
    slow, fast = (F.col(f"m_{c}") for c in MODES[1][1:])
    w = mk.cell_masks(found.select(slow.alias("s"), fast.alias("f")).distinct(), mk.core_for(core, 1))
    both = found.join(w, (slow == F.col("s")) & (fast == F.col("f")), "left")
    return both.select("i", "j", "k", F.coalesce(F.col("m_i").bitwiseAND(F.col("w")) != 0, F.lit(False)).alias("has"))


def error(tensor: DataFrame, dims: Dims, masks: dict[str, DataFrame], core: DataFrame | None = None, rank: int = MOST_RANK) -> DataFrame:
    """(nnz, recon_nnz, hits, abs_error, rel_error), without building the reconstruction.

    Its size comes from the mode-1 statistics of distinct masks: cells that a row covers are all but those whose masks share
    no bit with it. rank is that of mode 1, if known.
    """
    _, h = mk.statistics(tensor.limit(0), dims, masks, 1, core)
    rows = mk.histogram(masks["i"])
    apart = update.disjoint_sums(rows.select("m"), h, rank)
    whole = h.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("whole"))
    size = rows.join(apart, "m", "left").join(F.broadcast(whole), F.lit(True))  # one row
    size = size.agg(F.coalesce(F.sum(F.col("n") * (F.col("whole") - F.coalesce("total", F.lit(0)))), F.lit(0)).cast("long").alias("recon_nnz"))
    hits = contains(tensor, dims, masks, core).agg(F.count("*").alias("nnz"), F.count_if("has").alias("hits"))
    wrong = F.col("nnz") + F.col("recon_nnz") - 2 * F.col("hits")
    both = hits.join(F.broadcast(size), F.lit(True))  # one row each
    return both.select("nnz", "recon_nnz", "hits", wrong.alias("abs_error"), (wrong / F.lit(float(dims.cells))).alias("rel_error"))
