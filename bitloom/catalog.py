"""The queries of the library by name, over tensors derived from the tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.functions.select import cut
from bitloom.operators import masks as mk
from bitloom.operators import matrix, ranges, reconstruct, tensor, update
from bitloom.oracle import COLUMN, CORE, FACTORS, RANK, RANKS, SQL
from bitloom.plans import core as core_plan
from bitloom.plans import factorize, random
from bitloom.schema import CORE as CORE_SCHEMA
from bitloom.schema import Config, Dims
from bitloom.sources import sinks, text
from bitloom.sources.tables import SUPPLY as DIMS
from bitloom.sources.tables import events, supply, wide, wide_dims

__all__ = ["QUERIES", "SQL", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def listed(c: str | Column) -> Column:
    return F.concat_ws(",", (F.col(c) if isinstance(c, str) else c).cast("array<string>"))


def factor(spark: SparkSession, column: str, rank: int = RANK, shift: int = 0) -> DataFrame:
    """Entries (idx, r) of an arithmetic factor."""
    n, p = FACTORS[column]
    cells = spark.range(n).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rank - 1).cast("long"))).alias("r"))
    return cells.where((F.col("idx") * p + F.col("r") * 101 + 11 + 7 * shift) % 97 < 30)


def cp_masks(spark: SparkSession, rank: int = RANK, shift: int = 0) -> dict[str, DataFrame]:
    return {c: matrix.bit_rows(factor(spark, c, rank, shift), FACTORS[c][0]) for c in "ijk"}


def tk_masks(spark: SparkSession) -> dict[str, DataFrame]:
    return cp_masks(spark, RANKS[0])


def core(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CORE), CORE_SCHEMA)


def lines(spark: SparkSession, sf_dir: str, separator: str, base: int) -> DataFrame:
    return text.to_lines(supply(spark, sf_dir), ["i", "j", "k"], separator, base)


@query
def parse_coo(spark, sf_dir):
    comments = spark.createDataFrame([("# i,j,k",), ("% 30,40,50",)], "value string")
    return text.parse(comments.unionAll(lines(spark, sf_dir, "csv", 1)), "csv")


@query
def parse_coo_strict(spark, sf_dir):
    return text.parse(lines(spark, sf_dir, "tsv", 1), "tsv", comments=False)


@query
def to_base0(spark, sf_dir):
    return text.within(text.to_base0(text.parse(lines(spark, sf_dir, "ssv", 1), "ssv"), 1), DIMS).distinct()


@query
def tensor_text(spark, sf_dir):
    return lines(spark, sf_dir, "csv", 1)


@query
def factor_dense(spark, sf_dir):
    return sinks.dense_lines(cp_masks(spark)["i"], RANK)


@query
def factor_sparse(spark, sf_dir):
    return text.to_lines(factor(spark, "j"), ["idx", "r"], "tsv", 1)


@query
def core_sparse(spark, sf_dir):
    return text.to_lines(core(spark), ["r1", "r2", "r3"], "tsv", 1)


@query
def unfold_mode1(spark, sf_dir):
    return tensor.unfold(supply(spark, sf_dir), DIMS, 1)


@query
def unfold_mode2(spark, sf_dir):
    return tensor.unfold(supply(spark, sf_dir), DIMS, 2)


@query
def unfold_mode3(spark, sf_dir):
    return tensor.unfold(supply(spark, sf_dir), DIMS, 3)


@query
def unfold_core(spark, sf_dir):
    return tensor.unfold(core(spark).toDF("i", "j", "k"), Dims(*RANKS), 1)


@query
def events_tensor(spark, sf_dir):
    return events(spark, sf_dir)


@query
def nnz(spark, sf_dir):
    return supply(spark, sf_dir).agg(F.count("*").alias("n"))


@query
def slice_counts(spark, sf_dir):
    t = supply(spark, sf_dir)
    return reduce(DataFrame.unionAll, (tensor.slice_counts(t, n).select(F.lit(n).cast("long").alias("mode"), "idx", "cnt") for n in (1, 2, 3)))


@query
def row_pieces(spark, sf_dir):
    return tensor.row_pieces(unfold_mode1(spark, sf_dir), DIMS.j).select("block", "row", listed("cols").alias("cols"))


@query
def matrix_transpose(spark, sf_dir):
    return matrix.transpose(factor(spark, "i"))


@query
def matrix_rowwise(spark, sf_dir):
    return matrix.rowwise(factor(spark, "i"), DIMS.i).select("idx", listed("cols").alias("cols"))


@query
def matrix_colwise(spark, sf_dir):
    return matrix.colwise(factor(spark, "i"), RANK).select("r", listed("rows").alias("rows"))


@query
def sparse_to_dense(spark, sf_dir):
    return matrix.to_dense(factor(spark, "k"), DIMS.k, RANK).select("idx", "r", F.col("v").cast("long").alias("v"))


@query
def dense_to_sparse(spark, sf_dir):
    dense = matrix.to_dense(factor(spark, "k"), DIMS.k, RANK).groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda c: c["v"]).alias("values"))
    return matrix.from_dense(dense)


@query
def bit_rows(spark, sf_dir):
    return cp_masks(spark)["j"]


@query
def bit_rows_to_sparse(spark, sf_dir):
    return matrix.entries_of(cp_masks(spark)["j"], RANK)


@query
def num_unique_columns(spark, sf_dir):
    return matrix.unique_columns(factor(spark, "j"))


@query
def bit_masks(spark, sf_dir):
    return spark.range(1).select(F.explode(bits.bit_masks(1, 3)).alias("m"))


@query
def set_bits(spark, sf_dir):
    new = bits.set_bits(F.col("m"), 1, 3, F.col("idx") % 8)
    return cp_masks(spark)["i"].select("idx", new.alias("m"), bits.changed(F.col("m"), new).alias("changed"))


@query
def get_bits(spark, sf_dir):
    return cp_masks(spark)["i"].select("idx", bits.get_bits(F.col("m"), 2, 4).alias("v"))


@query
def num_zeros_table(spark, sf_dir):
    return spark.range(32).select(F.col("id").alias("v"), bits.zeros(F.col("id"), 5).alias("zeros"))


@query
def split_bit_row(spark, sf_dir):
    pieces = ranges.split_by_size(spark, 0, RANK - 1, 4).select("part", F.explode(F.sequence("lo", "hi")).alias("r"), "lo")
    entries = matrix.entries_of(cp_masks(spark)["i"], RANK)
    value = F.bit_or(bits.bit(F.col("r") - F.col("lo"))).alias("v")
    return entries.join(F.broadcast(pieces), "r").groupBy("idx", "part").agg(value)


@query
def slice_rowwise(spark, sf_dir):
    return matrix.rowwise(factor(spark, "i").where(F.col("r").between(1, 3)), DIMS.i).select("idx", listed("cols").alias("cols"))


@query
def colwise_in_range(spark, sf_dir):
    return matrix.colwise(factor(spark, "i").where(F.col("idx").between(5, 14)), RANK).select("r", listed("rows").alias("rows"))


@query
def mask_join(spark, sf_dir):
    return mk.joined(supply(spark, sf_dir), DIMS, cp_masks(spark), "ijk").select("i", "j", "k", "m_i", "m_j", "m_k")


def cp_model(spark: SparkSession) -> DataFrame:
    return reconstruct.cp(*(factor(spark, c) for c in "ijk"))


@query
def cp_reconstruct(spark, sf_dir):
    return cp_model(spark)


@query
def tucker_reconstruct(spark, sf_dir):
    return reconstruct.tucker(core(spark), *(factor(spark, c, RANKS[0]) for c in "ijk"))


@query
def recon_contains(spark, sf_dir):
    found = reconstruct.contains(supply(spark, sf_dir), DIMS, tk_masks(spark), core(spark))
    return found.select("i", "j", "k", F.col("has").cast("long").alias("has"))


@query
def sum_abs_diff(spark, sf_dir):
    return tensor.compare(supply(spark, sf_dir), cp_model(spark)).select("abs_diff", "only_a", "only_b", "both")


@query
def sq_frobenius(spark, sf_dir):
    return tensor.compare(supply(spark, sf_dir), cp_model(spark)).select("sq_diff")


@query
def tensor_semi(spark, sf_dir):
    return tensor.semi(supply(spark, sf_dir), cp_model(spark))


@query
def tensor_anti(spark, sf_dir):
    return tensor.anti(supply(spark, sf_dir), cp_model(spark))


@query
def tensor_except(spark, sf_dir):
    return cp_model(spark).exceptAll(supply(spark, sf_dir).select("i", "j", "k"))


@query
def tensor_intersect(spark, sf_dir):
    return supply(spark, sf_dir).intersect(cp_model(spark))


@query
def factor_row_summary(spark, sf_dir):
    used = F.lit(core_plan.used_columns(CORE)[0]).cast("long")
    return tk_masks(spark)["i"].select("idx", F.bit_count(F.col("m").bitwiseAND(used)).cast("long").alias("s"))


@query
def row_summation(spark, sf_dir):
    return matrix.row_summations(factor(spark, "j"), RANK).select("m", listed("rows").alias("rows"))


@query
def merge_rows(spark, sf_dir):
    rows = matrix.rowwise(factor(spark, "j"), DIMS.j).select((F.col("idx") % 5).alias("key"), "cols")
    return matrix.merged(rows).select("key", listed("cols").alias("cols"))


@query
def row_distance(spark, sf_dir):
    side = lambda c: matrix.rowwise(factor(spark, c), DIMS.i)
    return matrix.row_distance(side("i"), matrix.rowwise(factor(spark, "j").where(F.col("idx") < DIMS.i), DIMS.i))


@query
def cp_error(spark, sf_dir):
    return reconstruct.error(supply(spark, sf_dir), DIMS, cp_masks(spark), rank=RANK)


@query
def tk_error(spark, sf_dir):
    return reconstruct.error(supply(spark, sf_dir), DIMS, tk_masks(spark), core(spark), RANKS[0])


@query
def best_candidate(spark, sf_dir):
    t = supply(spark, sf_dir)
    tried = [reconstruct.error(t, DIMS, cp_masks(spark, shift=k), rank=RANK).select("abs_error", F.lit(k).cast("long").alias("candidate")) for k in range(3)]
    best = reduce(DataFrame.unionAll, tried).agg(F.min(F.struct("abs_error", "candidate")).alias("b"))
    return best.select("b.candidate", "b.abs_error")


def _deltas(mode: int, tucker: bool):
    def run(spark, sf_dir):
        masks, own = (tk_masks(spark), core(spark)) if tucker else (cp_masks(spark), None)
        s, h = mk.statistics(supply(spark, sf_dir), DIMS, masks, mode, own)
        return update.deltas(masks[tensor.MODES[mode][0]], s, h, COLUMN, RANKS[mode - 1] if tucker else RANK).select("idx", "d")

    return run


for _mode in (1, 2, 3):
    QUERIES[f"cp_error_delta_mode{_mode}"] = _deltas(_mode, False)
    QUERIES[f"tk_error_delta_mode{_mode}"] = _deltas(_mode, True)


def _update(spark: SparkSession, sf_dir: str, most_zeros: float) -> DataFrame:
    masks = cp_masks(spark)
    s, h = mk.statistics(supply(spark, sf_dir), DIMS, masks, 1)
    return update.column_update(masks["i"], s, h, COLUMN, DIMS.i, most_zeros, rank=RANK)


@query
def argmin_column(spark, sf_dir):
    return _update(spark, sf_dir, 1.0).select("idx", F.col("bit").cast("long").alias("bit"))


@query
def zero_cap(spark, sf_dir):
    return _update(spark, sf_dir, 0.5).select("idx", F.col("bit").cast("long").alias("bit"))


@query
def cp_column_update(spark, sf_dir):
    return _update(spark, sf_dir, 0.5).select("idx", "d", F.col("old").cast("long").alias("old"), F.col("bit").cast("long").alias("bit"), "m")


@query
def cp_column_delta(spark, sf_dir):
    return update.column_delta(_update(spark, sf_dir, 0.5)).select("delta")


@query
def cp_bit_updates(spark, sf_dir):
    new, old = _update(spark, sf_dir, 0.5).select("idx", "m"), cp_masks(spark)["i"].withColumnRenamed("m", "was")
    return new.join(old, "idx").agg(F.sum(bits.changed(F.col("was"), F.col("m"))).alias("bit_updates"))


@query
def tk_cell_masks(spark, sf_dir):
    masks = tk_masks(spark)
    pairs = masks["k"].select(F.col("idx").alias("k"), F.col("m").alias("s")).join(F.broadcast(masks["j"].select(F.col("idx").alias("j"), F.col("m").alias("f"))), F.lit(True))
    return mk.cell_masks(pairs, mk.core_for(core(spark), 1)).select("j", "k", "w")


@query
def core_gain_add(spark, sf_dir):
    return core_plan.gain_add(supply(spark, sf_dir), DIMS, tk_masks(spark), CORE, (0, 0, 0))


@query
def core_gain_remove(spark, sf_dir):
    return core_plan.gain_remove(supply(spark, sf_dir), DIMS, tk_masks(spark), CORE, min(CORE))


@query
def column_blocks(spark, sf_dir):
    return ranges.column_blocks(unfold_mode1(spark, sf_dir), DIMS.k, DIMS.j, 7)


@query
def input_ranges(spark, sf_dir):
    t = supply(spark, sf_dir).select(ranges.part_of(F.col("i"), DIMS.i, 7).alias("part"))
    return ranges.split(spark, 0, DIMS.i - 1, 7).join(t.groupBy("part").agg(F.count("*").alias("cnt")), "part", "left").select("part", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


@query
def split_max_size(spark, sf_dir):
    return ranges.split_by_size(spark, 3, 40, 8)


@query
def split_num(spark, sf_dir):
    return ranges.split(spark, 3, 40, 9)


@query
def split_range_balanced(spark, sf_dir):
    return ranges.balanced(tensor.slice_counts(supply(spark, sf_dir), 2), 6)


@query
def random_tensor(spark, sf_dir):
    return random.cells(spark, tuple(DIMS), 0.01, 5).toDF("i", "j", "k")


@query
def init_factor(spark, sf_dir):
    return random.factor(spark, DIMS.j, RANK, 0.3, 5)


def _config(method: str, **more) -> Config:
    return Config(DIMS, method, rank=RANK, ranks=RANKS, density=0.05, core_density=0.125, seed=3, **more)


@query
def cp_factor_update(spark, sf_dir):
    model = factorize.Model(cp_masks(spark))
    return factorize.factor_sweep(supply(spark, sf_dir), _config("cp", zero_probability=1.0), model, 1, 1).masks["i"]


@query
def cp_sweep(spark, sf_dir):
    model = factorize.sweep(cut(supply(spark, sf_dir)), _config("cp"), factorize.Model(cp_masks(spark)), 1)
    return factorize.entries(model, (RANK,) * 3)


@query
def tk_sweep(spark, sf_dir):
    model = factorize.sweep(cut(supply(spark, sf_dir)), _config("tk"), factorize.Model(tk_masks(spark), set(CORE)), 1)
    return factorize.entries(model, RANKS)


@query
def core_update(spark, sf_dir):
    patterns = core_plan.Patterns(supply(spark, sf_dir), DIMS, tk_masks(spark))
    return factorize.core_table(spark, core_plan.sweep(patterns, CORE, RANKS)[0])


@query
def cp_factorize(spark, sf_dir):
    result = factorize.factorize(supply(spark, sf_dir), _config("cp", iterations=4), "every")
    return spark.createDataFrame(result.history, "iteration long, delta long, bit_updates long, abs_error long")


@query
def tk_factorize(spark, sf_dir):
    result = factorize.factorize(supply(spark, sf_dir), _config("tk", iterations=3), "every")
    return spark.createDataFrame(result.history, "iteration long, delta long, bit_updates long, abs_error long")


def wide_masks(spark: SparkSession, dims: Dims) -> dict[str, DataFrame]:
    """Bit rows of arithmetic factors of any length."""
    out = {}
    for c, n in zip("ijk", dims, strict=True):
        p = FACTORS[c][1]
        on = [F.when((F.col("id") * p + r * 101 + 11) % 97 < 30, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(RANK)]
        out[c] = spark.range(n).select(F.col("id").alias("idx"), reduce(Column.__add__, on).cast("long").alias("m"))
    return out


@query
def wide_slice_counts(spark, sf_dir):
    t = wide(spark, sf_dir)
    return reduce(DataFrame.unionAll, (tensor.slice_counts(t, n).select(F.lit(n).cast("long").alias("mode"), "idx", "cnt") for n in (1, 2, 3)))


@query
def wide_error(spark, sf_dir):
    dims = wide_dims(spark, sf_dir)
    return reconstruct.error(wide(spark, sf_dir), dims, wide_masks(spark, dims), rank=RANK)


@query
def wide_error_delta(spark, sf_dir):
    dims = wide_dims(spark, sf_dir)
    masks = wide_masks(spark, dims)
    s, h = mk.statistics(wide(spark, sf_dir), dims, masks, 2)
    return update.deltas(masks["j"], s, h, COLUMN, RANK).select("idx", "d")


@query
def wide_column_update(spark, sf_dir):
    dims = wide_dims(spark, sf_dir)
    masks = wide_masks(spark, dims)
    s, h = mk.statistics(wide(spark, sf_dir), dims, masks, 2)
    new = update.column_update(masks["j"], s, h, COLUMN, dims.j, 0.5, rank=RANK)
    return new.select("idx", "d", F.col("old").cast("long").alias("old"), F.col("bit").cast("long").alias("bit"), "m")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CP factorization of the supply tensor: the error of each iteration."""
    return cp_factorize(spark, sf_dir)
