"""Array expressions that several operators share. All are plain Catalyst expressions over one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative op over an array of whole numbers, with 0 as its neutral value (sums, or the largest of
    numbers from 0 on), by doubling: step k combines each place with the result that ends 2**k places before it, so an array of
    n is copied log2(n) times and never once per element."""
    zero = F.lit(0).cast("bigint")
    x = F.transform(x, lambda v: v.cast("bigint"))

    def doubled(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2.0), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(zero, by), F.slice(acc, F.lit(1), F.size(acc) - by)), op)

    def run(v: Column) -> Column:
        last = F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), v, doubled))

    return let(x, run)


def prefix_sums(x: Column) -> Column:
    return running(x, lambda a, b: a + b)


def running_max(x: Column) -> Column:
    return running(x, lambda a, b: F.greatest(a, b))
