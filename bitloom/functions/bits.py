"""Bit rows as long columns: column r of a row is bit r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(r: Column | int) -> Column:
    """The row that has column r alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(r).cast("int") if isinstance(r, int) else r.cast("int"))


def range_mask(start: int, end: int) -> int:
    """The bits from start to end, both included."""
    return ((1 << (end - start + 1)) - 1) << start


def bit_masks(start: int, end: int) -> Column:
    """All rows that have columns from start to end only, as an array in ascending order."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << (end - start + 1)) - 1)), lambda v: F.shiftleft(v.cast("long"), start))


def get_bits(m: Column, start: int, end: int) -> Column:
    """Columns from start to end as a number whose lowest bit is start."""
    return F.shiftright(m, start).bitwiseAND(F.lit(range_mask(0, end - start)).cast("long"))


def set_bits(m: Column, start: int, end: int, value: Column) -> Column:
    """m with columns from start to end replaced by value."""
    keep = F.lit(~range_mask(start, end)).cast("long")
    return m.bitwiseAND(keep).bitwiseOR(F.shiftleft(value.cast("long"), start))


def changed(old: Column, new: Column) -> Column:
    return F.bit_count(old.bitwiseXOR(new)).cast("long")


def zeros(v: Column, width: int) -> Column:
    """Zeros in the binary form of v of width digits."""
    return (F.lit(width) - F.bit_count(v)).cast("long")


def bit_string(m: Column, width: int) -> Column:
    """'0' and '1' for each column, column 0 leftmost."""
    return F.reverse(F.lpad(F.bin(m), width, "0"))


def columns_of(m: Column, width: int) -> Column:
    """The set columns, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda r: F.call_function("shiftright", m, r).bitwiseAND(F.lit(1).cast("long")) == 1)
