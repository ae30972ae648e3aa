"""Factorize a tensor in a text file: python -m bitloom.cli OPTIONS TENSOR."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from bitloom.plans import factorize
from bitloom.schema import Config, Dims
from bitloom.sources import sinks, text


def _number(kind, low, high=None):
    def parse(value: str):
        n = kind(value)
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"{value} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
        return n

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitloom", description="Boolean CP and Tucker factorization of a sparse three-way tensor.")
    add, share, count = p.add_argument, _number(float, 0, 1), _number(int, 1)
    add("tensor", help="text file, or folder of them, with a nonzero on each line")
    add("-m", "--factorization-method", choices=("cp", "tk"), required=True)
    add("-b", "--base-index", type=int, choices=(0, 1), required=True)
    add("-r", "--rank", type=count)
    for n in (1, 2, 3):
        add(f"-r{n}", f"--rank{n}", type=count)
        add(f"-m{n}", f"--mode{n}-length", type=count, required=True)
    add("-rs", "--random-seed", type=_number(int, 0))
    add("-nic", "--num-initial-candidate-sets", type=count, default=1)
    add("-ifd", "--initial-factor-matrix-density", type=share, required=True)
    add("-icd", "--initial-core-tensor-density", type=share)
    add("-cni", "--converge-by-num-iters", type=count)
    add("-ced", "--converge-by-abs-error-delta", type=_number(float, 0))
    add("-nci", "--num-consecutive-iters-for-converge-by-abs-error-delta", type=count, default=3)
    add("-pz", "--prob-for-zero-for-tie-breaking", type=share, default=0.9)
    add("-mz", "--max-zero-percentage", type=share, default=0.95)
    add("-ce", "--compute-error", choices=("every", "end"))
    add("-od", "--output-dir-path")
    add("-op", "--output-file-prefix")
    add("--tensor-file-separator-type", choices=tuple(text.SEPARATORS), default="csv")
    add("--output-result-summary", action="store_true", help="append error and times to a file in the output folder")
    add("-up", "--num-unfolded-tensor-partitions", type=count, help="partitions of shuffles; results do not depend on it")
    add("-ip", "--num-input-tensor-partitions", type=count, help="accepted, without effect")
    add("-mrss", "--max-rank-split-size", type=count, default=15, help="accepted, without effect")
    add("--unfolded-tensor-partitioner", choices=("map-based", "array-based"), default="map-based", help="accepted, without effect")
    return p


def config_of(p: argparse.ArgumentParser, a: argparse.Namespace) -> Config:
    if a.factorization_method == "cp" and a.rank is None:
        p.error("--rank is required for cp")
    if a.factorization_method == "tk" and None in (a.rank1, a.rank2, a.rank3, a.initial_core_tensor_density):
        p.error("--rank1, --rank2, --rank3 and --initial-core-tensor-density are required for tk")
    if a.output_result_summary and not a.output_dir_path:
        p.error("--output-result-summary needs --output-dir-path")
    iterations = a.converge_by_num_iters or (10 if a.converge_by_abs_error_delta is None else None)
    seed = a.random_seed if a.random_seed is not None else time.time_ns() % 1_000_000
    return Config(
        Dims(a.mode1_length, a.mode2_length, a.mode3_length), a.factorization_method, a.rank or 0, (a.rank1 or 0, a.rank2 or 0, a.rank3 or 0),
        a.initial_factor_matrix_density, a.initial_core_tensor_density or 0.0, seed, a.num_initial_candidate_sets, iterations,
        a.converge_by_abs_error_delta, a.num_consecutive_iters_for_converge_by_abs_error_delta, a.prob_for_zero_for_tie_breaking, a.max_zero_percentage,
    )


def log_lines(a: argparse.Namespace, config: Config, result: factorize.Result, seconds: float) -> list[str]:
    """The parameters, a line for each iteration, and the error and times at the end."""
    told = vars(a) | {"random_seed": config.seed}
    steps = [", ".join(f"{k}: {v}" for k, v in step.items()) for step in result.history]
    end = f"error: {'' if result.error is None else result.error}, seconds: {seconds:.3f}, factors: {result.factor_seconds:.3f}, core: {result.core_seconds:.3f}"
    return [*(f"{k}: {v}" for k, v in told.items() if v is not None), *steps, end]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> factorize.Result:
    p = parser()
    a = p.parse_args(args)
    config = config_of(p, a)
    logging.basicConfig(level=logging.INFO, stream=sys.stdout, format="%(message)s")
    spark = spark or SparkSession.builder.appName("bitloom").getOrCreate()
    if a.num_unfolded_tensor_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.num_unfolded_tensor_partitions))
    began = time.time()
    tensor = text.load(spark, a.tensor, config.dims, a.tensor_file_separator_type, a.base_index)
    result = factorize.factorize(tensor, config, a.compute_error)
    seconds = time.time() - began
    if a.output_dir_path:
        prefix = a.output_file_prefix or sinks.prefix_of(a.tensor)
        sinks.write_log(spark, a.output_dir_path, prefix, log_lines(a, config, result, seconds))
        for n, c in enumerate("ijk", 1):
            sinks.write_factor(result.model.masks[c], config.all_ranks[n - 1], a.output_dir_path, prefix, n, a.base_index)
        if result.model.core is not None:
            sinks.write_core(factorize.core_table(spark, result.model.core), a.output_dir_path, prefix, a.base_index)
        if a.output_result_summary:
            sinks.write_summary(spark, a.output_dir_path, sinks.prefix_of(a.tensor), result.error, seconds, result.factor_seconds, result.core_seconds)
    return result


if __name__ == "__main__":
    main()
