"""Ordered computation per key that stays safe when one key holds most of the rows.

Every helper first counts the largest group. Up to ``max_group_rows`` a plain window over the
key does the work. Beyond it the rows are sorted across the cluster and numbered, and each key is
cut into blocks of a fixed number of rows, so that a hot key spreads over many tasks:

* a bounded frame gets the neighbouring rows it needs copied into each block (``windowed``);
* a running aggregate adds the totals of the blocks before (``running``).

Both ways give the same rows; a null key is a key like others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.runtime import frozen, max_group_rows

KEYS = ("symbol",)
ORDER = ("ts_event", "sequence")


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table on every row, as a scalar subquery instead of a join."""
    packed = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]))
    return df.withColumn("_row", packed.scalar()).select("*", "_row.*").drop("_row")


def matched(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", salts: int = 1, spread: bool = False) -> DataFrame:
    """Join where ``on`` is equal, null with null; the left side's columns come first.

    ``salts``: for a right side with one small row per key. It is repeated that often, so that the
    rows of a hot key on the left meet it in as many tasks. Which copy a row meets changes nothing.
    ``spread``: for a right side that grows with the table; it is shuffled, never sent to all tasks.
    """
    on = [on] if isinstance(on, str) else list(on)
    names = {k: f"_on_{i}" for i, k in enumerate(on)}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()])
    if salts > 1:
        left = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        right = right.withColumn("_salts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        same &= F.col("_salt") == F.col("_salts")
    out = left.join(right.hint("merge") if spread else right, same, how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(n)) for k, n in names.items()})
    return out.drop(*names.values(), "_salt", "_salts")


#: Copies of a small row per key that the rows of a hot key are joined with.
SALTS = 16


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


_SIZES: ContextVar[tuple[tuple[frozenset[str], Callable[[], int]], ...]] = ContextVar("_SIZES", default=())


@contextmanager
def sized(df: DataFrame, keys: Sequence[str], times: int = 1) -> Iterator[None]:
    """Count the groups of ``df`` once, when first asked, for all ordered steps inside.

    For a chain of steps whose groups by these keys, or by more, hold at most ``times`` as many rows
    as those of ``df``.
    """
    found: list[int] = []

    def size() -> int:
        if not found:
            found.append(times * largest_group(df, keys))
        return found[0]

    token = _SIZES.set((*_SIZES.get(), (frozenset(keys), size)))
    try:
        yield
    finally:
        _SIZES.reset(token)


def fits(df: DataFrame, keys: Sequence[str]) -> bool:
    limit = max_group_rows(df.sparkSession)
    if any(known <= set(keys) and size() <= limit for known, size in _SIZES.get()):
        return True
    return largest_group(df, keys) <= limit


def spec(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``_rn``, the row's position in its key, without gathering a key in one task.

    The sort splits the rows by sampled ranges of (key, order), so its partitions are even
    whatever the keys. The id keeps partition number and position; it is frozen before use.
    """
    placed = df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = frozen(placed).withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = matched(placed, starts, [*keys, "_part"])
    return joined.withColumn("_rn", F.expr("_at - _first + _base")).drop("_at", "_first", "_base", "_part")


def numbered(df: DataFrame, name: str = "rn", keys: Sequence[str] = KEYS, order: Sequence[str | Column] = ORDER) -> DataFrame:
    """Position of each row in its key, from 0."""
    if fits(df, keys):
        return df.withColumn(name, F.row_number().over(spec(keys, order)).cast("long") - 1)
    return spread(df, keys, order).withColumnRenamed("_rn", name)


def haloed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], before: int = 0, after: int = 0) -> DataFrame:
    """Rows in blocks ``_blk``, each with the rows before and after it that it needs; its own ones are ``_own``."""
    block = max(max_group_rows(df.sparkSession), before, after, 1)
    rows = spread(df, keys, order).withColumn("_blk", F.expr(f"_rn div {block}")).withColumn("_off", F.expr(f"_rn % {block}"))
    copies = [F.struct(F.col("_blk").alias("_blk"), F.lit(True).alias("_own"))]
    if before:
        copies.append(F.when(F.col("_off") >= block - before, F.struct((F.col("_blk") + 1).alias("_blk"), F.lit(False).alias("_own"))))
    if after:
        copies.append(F.when((F.col("_off") < after) & (F.col("_blk") > 0), F.struct((F.col("_blk") - 1).alias("_blk"), F.lit(False).alias("_own"))))
    return rows.withColumn("_copy", F.explode(F.array_compact(F.array(*copies)))).drop("_blk", "_off").select("*", "_copy.*").drop("_copy")


def windowed(
    df: DataFrame,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str | Column] = ORDER,
    check: bool = True,
) -> DataFrame:
    """Apply ``fn(rows, window)`` per key; ``fn`` may look at most ``before``/``after`` rows away.

    ``check=False`` is for tables whose groups are bounded by the calendar, such as bars.
    """
    if not check or fits(df, keys):
        return fn(df, spec(keys, order))
    rows = haloed(df, keys, order, before, after)
    out = fn(rows, spec([*keys, "_blk"], ["_rn"]))
    return out.filter("_own").drop("_rn", "_blk", "_own")


def _total(kind: str, column: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(column, F.when(column.isNotNull(), order))
    if kind == "first":
        return F.min_by(column, F.when(column.isNotNull(), order))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](column)


def _over(kind: str, column: Column, w: WindowSpec) -> Column:
    if kind in ("last", "first"):
        return getattr(F, kind)(column, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](column).over(w)


def _merge(kind: str, carried: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(carried + here)
    if kind == "min":
        return F.least(carried, here)
    if kind == "max":
        return F.greatest(carried, here)
    return F.coalesce(here, carried) if kind == "last" else F.coalesce(carried, here)


def running(
    df: DataFrame,
    aggs: dict[str, tuple[str, str | Column]],
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str | Column] = ORDER,
    exclusive: bool = False,
    check: bool = True,
) -> DataFrame:
    """Aggregates from a key's first row to this one: ``{name: (kind, column)}``.

    Kinds are sum, count, min, max, and first/last of the non-null values. ``exclusive`` leaves
    the row itself out.
    """
    top = -1 if exclusive else 0
    sources = {name: (kind, F.col(c) if isinstance(c, str) else c) for name, (kind, c) in aggs.items()}
    if not check or fits(df, keys):
        w = spec(keys, order).rowsBetween(Window.unboundedPreceding, top)
        return df.withColumns({name: _over(kind, c, w) for name, (kind, c) in sources.items()})
    block = max_group_rows(df.sparkSession)
    rows = spread(df, keys, order).withColumn("_blk", F.expr(f"_rn div {block}"))
    totals = rows.groupBy(*keys, "_blk").agg(*[_total(kind, c, F.col("_rn")).alias(f"_t_{name}") for name, (kind, c) in sources.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    merge_kind = {"count": "sum"}
    carried = totals.select(
        *keys,
        "_blk",
        *[_over(merge_kind.get(kind, kind), F.col(f"_t_{name}"), earlier).alias(f"_c_{name}") for name, (kind, _) in sources.items()],
    )
    rows = matched(rows, carried, [*keys, "_blk"])
    inside = spec([*keys, "_blk"], ["_rn"]).rowsBetween(Window.unboundedPreceding, top)
    rows = rows.withColumns({name: _merge(kind, F.col(f"_c_{name}"), _over(kind, c, inside)) for name, (kind, c) in sources.items()})
    return rows.drop("_rn", "_blk", *[f"_c_{name}" for name in sources])


def exact_quantiles(
    df: DataFrame, columns: dict[str, str], probs: Sequence[float], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per key as arrays ``{name: column}``.

    Small groups use ``percentile``. Above the limit each column is first counted by value and the
    running count finds the values at the wanted positions; without keys only values near these are counted.
    """
    if not keys:
        return _whole_quantiles(df, columns, [float(p) for p in probs])
    if fits(df, keys):
        array = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), array).alias(name) for name, c in columns.items()])
    parts = [_spread_quantiles(df, name, c, probs, keys) for name, c in columns.items()]
    return reduce(lambda a, b: matched(a, b, keys, "left"), parts, df.select(*keys).distinct())  # a key without any value has its row too


#: Rows up to which one task counts all values of a table, and the sketch's accuracy above that.
COUNTED_ROWS = 200_000
ACCURACY = 10_000


def _whole_quantiles(df: DataFrame, columns: dict[str, str], probs: list[float]) -> DataFrame:
    """Quantiles of the whole table, one row.

    Above `COUNTED_ROWS` a sketch of each column gives bounds around every wanted position. The rows below the
    bounds are counted and the values between them ranked, a few thousandths of all. The sketch only says
    where to look: a position outside its bounds, which the counts show, is looked up among all values.
    """
    names, spark = list(columns), df.sparkSession
    values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns.values())])
    values = frozen(values)  # read three times
    array = F.array(*[F.lit(p) for p in probs])
    if values.count() <= min(max_group_rows(spark), COUNTED_ROWS):
        return values.agg(*[F.percentile(f"_v{i}", array).alias(name) for i, name in enumerate(names)])
    slack = 3 / ACCURACY
    around = [[min(max(p + d, 0.0), 1.0) for d in (-slack, slack)] for p in probs]
    marks = F.array(*[F.lit(m) for pair in around for m in pair])
    sketch = [F.percentile_approx(f"_v{i}", marks, ACCURACY) for i in range(len(names))]
    found = values.agg(*[c.alias(f"m{i}") for i, c in enumerate(sketch)], *[F.count(f"_v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    slots = []  # of each wanted position: column, quantile, bounds, the two ranks around it
    for i in range(len(names)):
        for j, p in enumerate(probs if found[f"n{i}"] else []):
            at = (found[f"n{i}"] - 1) * p
            slots.append((i, j, *found[f"m{i}"][2 * j : 2 * j + 2], math.floor(at), math.ceil(at), at))
    answers: dict[int, list] = {i: [None] * len(probs) for i in range(len(names)) if found[f"n{i}"]}
    if slots:
        below = values.agg(*[F.count(F.when(F.col(f"_v{i}") < low, 1)).alias(f"b{s}") for s, (i, _, low, *_) in enumerate(slots)]).first()
        inside = [F.when(F.col(f"_v{i}").between(low, high), F.struct(F.lit(s).alias("slot"), F.col(f"_v{i}").alias("v"))) for s, (i, _, low, high, *_) in enumerate(slots)]
        ranked = values.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.slot", "x.v").agg(F.count(F.lit(1)).alias("n"))
        ranked = ranked.withColumn("to", F.sum("n").over(Window.partitionBy("slot").orderBy("v")))
        rank = lambda k: F.get(F.array(*[F.lit(slot[k] - below[f"b{s}"]) for s, slot in enumerate(slots)]), F.col("slot"))
        at = lambda k: F.max(F.when((rank(k) < F.col("to")) & (rank(k) >= F.col("to") - F.col("n")), F.col("v")))
        for slot, low, high in ranked.groupBy("slot").agg(at(4), at(5)).collect():  # a row per wanted position
            i, j, _, _, lo, hi, exact = slots[slot]
            if low is not None and high is not None:
                answers[i][j] = low if low == high or lo == hi else (hi - exact) * low + (exact - lo) * high
    known = lambda i: F.array(*[F.lit(v) for v in answers[i]]) if i in answers else F.lit(None).cast("array<double>")
    missed = [i for i in answers if None in answers[i]]
    out = spark.range(1).select(*[known(i).alias(name) for i, name in enumerate(names) if i not in missed])
    return reduce(beside, [_spread_quantiles(values, names[i], f"_v{i}", probs, ()) for i in missed], out).select(*names)


def _spread_quantiles(df: DataFrame, name: str, column: str, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    values = df.select(*keys, F.col(column).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    values = running(values, {"_to": ("sum", "_n")}, keys=keys, order=["_v"])
    sizes = values.groupBy(*keys).agg(F.max("_to").alias("_size"))
    values = matched(values, sizes, keys, salts=SALTS) if keys else values.transform(beside, sizes)
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        holds = lambda pos: (pos < F.col("_to")) & (pos >= F.col("_to") - F.col("_n"))
        low, high = F.max(F.when(holds(lo), F.col("_v"))), F.max(F.when(holds(hi), F.col("_v")))
        frac = F.max(at - lo)
        picks.append((low + (high - low) * frac).alias(f"_q{i}"))
    return values.groupBy(*keys).agg(*picks).select(*keys, F.array(*[f"_q{i}" for i in range(len(probs))]).alias(name))
