"""A Merkle manifest of a table: a tree per group over its rows, and one tree over the groups' roots.

A level of an aligned block is one hex string, 64 characters a node. A parent is the hash of a fixed-width
substring, so a block's upper levels come from SQL substrings; what flanks a node within its run are its
siblings. Blocks hold ``FAN ** STEPS`` nodes; their roots are the nodes of the next round, until each
group has a single block. Paths come down the same rounds, from the top tree to the leaves.

Rows are laid out once by sampled ranges of (group, order), so no group, however large, gathers in one task;
positions come from counts per range. What is exchanged per row is the leaf, not the row's content.

Cases: null values are ``-`` in a leaf; a null group is a group like others, the first one; rows of a
group with the same order are ordered by leaf, so repeated rows get neighbouring positions (which of them
gets which is the same thing); an empty table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import written
from tapeloom.operators.ordered import matched

#: Children of a node, and levels that one round adds.
FAN, STEPS = 16, 2
BLOCK = FAN**STEPS
HEX = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[encoded(v) for v in values])


def laid_out(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows written in order; ``_part`` is the range a row is in, ``_at`` grows with the order within it."""
    order = [F.col(c).asc_nulls_first() for c in order]
    df = df.withColumn("_tie", F.monotonically_increasing_id())  # parts the copies of a row; their order changes nothing
    order.append(F.col("_tie").asc())
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(placed.drop("_tie"), "laid").withColumn("_part", F.shiftright("_at", 33))


def counted(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_before``, the rows of the key in earlier ranges. A key has at most one row per range."""
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def cells_of(laid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return laid.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))


def positions(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Put each row in its group: ``g`` numbers the groups in order, ``pos`` the rows within, ``n`` are the group's rows."""
    laid = laid_out(leaves, [group, *order, "leaf"])
    cells = written(counted(cells_of(laid, [group]), [group]), "cells")
    groups = laid_out(cells.groupBy(group).agg(F.sum("_rows").alias("n")), [group])
    numbers = matched(groups, counted(cells_of(groups, []), []), "_part")
    numbers = numbers.select(group, "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("g"))
    # A group is in few ranges and a range has few rows: neither join has a key with many rows.
    heads = matched(cells, numbers, group).drop("_rows")
    joined = matched(laid, heads, ["_part", group])
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def parents(level: Column) -> Column:
    """The level above: one hash for each run of ``FAN`` nodes."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * width + 1, F.lit(width)), 256)), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """Rows (g, block, n, members, levels) of nodes (g, pos, n, node, rest)."""
    member = F.struct("pos", "node", "rest")
    grouped = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    lowest = F.array_join(F.transform("members", lambda m: m["node"]), "")
    raised = lambda levels, j: F.when(F.col("n") > F.pow(F.lit(float(FAN)), j), F.array_append(levels, parents(F.element_at(levels, -1)))).otherwise(levels)
    return grouped.withColumn("levels", F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.array(lowest), raised))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, from the leaves up; a group ends in the round in which it has one block."""
    rounds, rest = [], nodes.schema["rest"].dataType
    most = None
    while most is None or most > BLOCK:
        rounds.append(written(blocks(nodes), "blocks"))
        most = rounds[0].agg(F.max("n")).first()[0] or 0 if most is None else -(-most // BLOCK)
        above = rounds[-1].where(F.col("n") > BLOCK)
        nodes = above.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).alias("node"), F.lit(None).cast(rest).alias("rest"))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """The root of each group: (g, node)."""
    ended = [r.where(F.col("n") <= BLOCK).select("g", F.element_at("levels", -1).alias("node")) for r in rounds]
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def flanks(levels: Column, k: Column) -> Column:
    """Left and right siblings of the block's k-th node and its parents, as hex strings, level by level."""

    def at(level: Column, j: Column) -> Column:
        i = F.floor(k / F.pow(F.lit(float(FAN)), j)).cast("int")
        start = F.floor(i / FAN).cast("int") * (FAN * HEX)
        here = i * HEX
        return F.struct(level.substr(start + 1, here - start).alias("left"), level.substr(here + HEX + 1, start + FAN * HEX - here - HEX).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def descended(rounds: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """Every node of the lowest round with its path; ``crowns`` (g, path, head) goes on from the groups' roots."""
    nodes = None
    for level in reversed(rounds):
        with_path = level.where(F.col("n") <= BLOCK).join(crowns, "g")  # a group has one such block
        if nodes is not None:
            upper = nodes.select("g", F.col("pos").alias("block"), "path", "head")
            with_path = with_path.unionByName(level.where(F.col("n") > BLOCK).join(upper, ["g", "block"]))
        each = with_path.select("g", "levels", F.col("path").alias("above"), "head", F.posexplode("members").alias("k", "member"))
        nodes = each.select("g", "member.*", F.concat(flanks(F.col("levels"), F.col("k")), F.col("above")).alias("path"), "head")
    return nodes


PATH = "array<struct<left:string,right:string>>"


def manifest(leaves: DataFrame, group: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep.., leaf, path, subroot, root) of rows (group, order.., leaf).

    ``path`` lists the siblings at the left and right of the row's node, level by level up to the root.
    """
    placed = positions(leaves, group, order)
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    trees = climbed(placed.select("g", "pos", "n", F.col("leaf").alias("node"), rest.alias("rest")))
    roots = tops(trees)
    groups = roots.count()
    top = climbed(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(groups).cast("long").alias("n"), "node", F.col("g").alias("rest")))
    root = tops(top).select("g", F.array().cast(PATH).alias("path"), F.col("node").alias("head"))
    crowns = descended(top, root).select(F.col("rest").alias("g"), "path", F.struct(F.col("node").alias("subroot"), F.col("head").alias("root")).alias("head"))
    crowns = written(crowns, "crowns")
    nodes = descended(trees, crowns)
    return nodes.select(*[F.col("rest")[c].alias(c) for c in keep], F.col("node").alias("leaf"), "path", "head.*")


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda h, s: digest(s["left"], h, s["right"]))
