"""Column helpers for operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a loop."""
    return F.transform(F.array(value), body)[0]


def _running(steps: Column) -> Column:
    """Sum of the steps before each one, for a short array."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    add = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
    return F.aggregate(steps, start, add)["out"]


def sums_before(steps: Column) -> Column:
    """Sum of the steps before each one (array of long), by blocks so that long arrays stay cheap."""

    def body(all_steps: Column) -> Column:
        blocks = F.when(F.size(all_steps) > 0, F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        cut = F.transform(blocks, lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda parts: F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        join = lambda parts: F.flatten(F.zip_with(_running(totals(parts)), parts, lambda start, p: F.transform(_running(p), lambda x: x + start)))
        return let(cut, join)

    return let(F.transform(steps, lambda x: x.cast("long")), body)
