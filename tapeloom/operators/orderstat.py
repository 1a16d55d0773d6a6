"""Order statistics over all rows so far, exact, for groups too large for one task.

Every value gets its rank in its key. The rank of an answer is then found one base-16 digit at a
time: a row asks how many earlier values begin with its digits so far and each next digit, which
is a running count within (key, digits so far). Each digit is one pass of running counts, which
split hot groups into blocks; nothing holds a group's past.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import KEYS, ORDER, largest_group, matched, running, spread
from tapeloom.runtime import frozen

BASE_BITS = 4


def prefix_order(df: DataFrame, value: str, wanted: dict[str, Column], *, exclusive: bool = False, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Add, per name, the value at a 0-based rank among the key's non-null values so far; null for a null rank.

    A rank is a column of the row and must lie below the number of values so far. ``exclusive``
    leaves the row's own value out.
    """
    keys = list(keys)
    rows = frozen(spread(df, keys, order))
    values = spread(rows.filter(F.col(value).isNotNull()).select(*keys, F.col("_rn").alias("_pos"), F.col(value).alias("_v")), keys, ["_v", "_pos"])
    values = frozen(values.withColumnRenamed("_rn", "_vr"))
    top = max(largest_group(values, keys) - 1, 0)
    levels = max((top.bit_length() + BASE_BITS - 1) // BASE_BITS, 1)
    cells = F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("long").alias("_k")) for n, c in wanted.items()])
    asked = rows.select(*keys, F.col("_rn").alias("_pos"), F.explode(cells).alias("c")).select(*keys, "_pos", "c.*").filter("_k is not null")
    asked = asked.withColumn("_node", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        shift = level * BASE_BITS
        inserts = values.select(*keys, "_pos", F.shiftright("_vr", shift + BASE_BITS).alias("_node"), F.shiftright("_vr", shift).bitwiseAND(F.lit(15)).alias("_digit"))
        both = asked.unionByName(inserts, allowMissingColumns=True)
        is_query = F.col("_name").isNotNull()
        both = both.withColumn("_turn", F.when(is_query, 0 if exclusive else 1).otherwise(1 if exclusive else 0))
        counts = {f"_c{d}": ("sum", (F.col("_digit") == d).cast("long")) for d in range(16)}
        both = running(both, counts, keys=[*keys, "_node"], order=["_pos", "_turn", F.coalesce("_name", F.lit(""))])
        below, digit, rest = F.lit(0), F.lit(15), F.col("_k")
        steps = []
        for d in range(16):
            upto = below + F.coalesce(F.col(f"_c{d}"), F.lit(0))
            steps.append((F.col("_k") < upto, d, F.col("_k") - below))
            below = upto
        for found, d, left in reversed(steps):
            digit, rest = F.when(found, d).otherwise(digit), F.when(found, left).otherwise(rest)
        asked = frozen(both.filter(is_query).select(*keys, "_pos", "_name", rest.alias("_k"), (F.shiftleft("_node", BASE_BITS) + digit).alias("_node")))
    answers = matched(asked, values.select(*keys, F.col("_vr").alias("_node"), "_v"), [*keys, "_node"])
    answers = answers.groupBy(*keys, F.col("_pos").alias("_rn")).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted])
    return matched(rows, answers, [*keys, "_rn"], "left").drop("_rn")


def prefix_quantile(df: DataFrame, value: str, name: str, q: Column, least: int = 1, *, exclusive: bool = False, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Linear-interpolated quantile of the values so far; null under ``least`` of them."""
    df = running(df, {"_count": ("count", value)}, keys=keys, order=order, exclusive=exclusive)
    at = q * (F.coalesce("_count", F.lit(0)) - 1)
    df = df.withColumn("_place", F.when(F.col("_count") >= max(least, 1), at))
    out = prefix_order(df, value, {"_low": F.floor("_place"), "_high": F.ceil("_place")}, exclusive=exclusive, keys=keys, order=order)
    part = F.col("_place") - F.floor("_place")
    return out.withColumn(name, F.col("_low") + (F.col("_high") - F.col("_low")) * part).drop("_count", "_place", "_low", "_high")
