"""Text tensors, sinks and the command line."""

import pytest
from pyspark.errors import PySparkException

from bitloom import cli
from bitloom.functions import draw
from bitloom.operators import ranges
from bitloom.schema import Dims
from bitloom.sources import sinks, text


def write(tmp_path, *lines):
    p = tmp_path / "x.tensor"
    p.write_text("".join(f"{x}\n" for x in lines))
    return str(p)


@pytest.mark.parametrize(("kind", "sep"), [("csv", ","), ("ssv", " "), ("tsv", "\t")])
def test_comments_bases_separators_and_duplicates(spark, tmp_path, kind, sep):
    path = write(tmp_path, "# a comment", "% another", *(sep.join(r) for r in ("123", "123", "312")))
    found = text.load(spark, path, Dims(3, 3, 3), kind, base=1)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 2), (2, 0, 1)]


@pytest.mark.parametrize("line", ["1,2", "1,2,3,4", "", "1, 2,x", "9,1,1", "-1,0,0"])
def test_bad_lines_fail(spark, tmp_path, line):
    with pytest.raises(PySparkException):
        text.load(spark, write(tmp_path, "0,0,0", line), Dims(3, 3, 3)).collect()


def test_prefix():
    assert sinks.prefix_of("/a/b/sample.tensor") == "sample" and sinks.prefix_of("plain") == "plain"


def test_command_line_writes_factors_core_and_summary(spark, tmp_path):
    path = write(tmp_path, *(f"{i},{j},{k}" for i in range(3) for j in range(2) for k in range(2) if (i + j + k) % 2))
    common = [path, "-b", "0", "-m1", "3", "-m2", "2", "-m3", "2", "-ifd", "0.5", "-rs", "1", "-cni", "2", "-ce", "end", "-od", str(tmp_path / "out")]
    result = cli.main(["-m", "tk", "-r1", "2", "-r2", "2", "-r3", "2", "-icd", "0.5", "--output-result-summary", *common], spark)
    assert result.error is not None
    dense = [r.value for r in spark.read.text(str(tmp_path / "out" / "x_factor1_dense.txt")).collect()]
    assert len(dense) == 3 and all(set(v) <= {"0", "1"} and len(v) == 2 for v in dense)
    core = {tuple(map(int, r.value.split("\t"))) for r in spark.read.text(str(tmp_path / "out" / "x_core_tensor.txt")).collect()}
    assert core == result.model.core
    assert len(spark.read.text(str(tmp_path / "out" / "x.result")).first().value.split("\t")) == 4
    log = (tmp_path / "out" / "x.log").read_text().splitlines()
    assert "random_seed: 1" in log and sum(line.startswith("iteration: ") for line in log) == 2
    assert log[-1].startswith(f"error: {result.error}, ")


@pytest.mark.parametrize("args", [["-m", "cp"], ["-m", "tk", "-r1", "2"], ["-m", "zz"]])
def test_command_line_refuses(args, tmp_path):
    with pytest.raises(SystemExit):
        cli.main([*args, "x", "-b", "0", "-m1", "3", "-m2", "2", "-m3", "2", "-ifd", "0.5"])


def test_draws_are_the_same_on_the_driver(spark):
    from pyspark.sql import functions as F

    for row in spark.range(5).select("id", draw.uniform(7, F.lit(3), F.col("id")).alias("u")).collect():
        assert row.u == draw.uniform_of(7, 3, row.id)


def test_ranges_refuse_too_many_parts(spark):
    with pytest.raises(ValueError):
        ranges.split(spark, 0, 2, 4)
