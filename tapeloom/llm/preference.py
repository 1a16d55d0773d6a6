"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The prompt is the longest common prefix of turns (role and text equal; nulls equal each other),
rendered once. What follows in either conversation is its completion, rendered with the same template.
The mask of a completion lists the spans (code points, end exclusive) of its assistant turns' texts with
their closing mark: the parts that a loss is taken on.

All of it is DataFrame functions. A conversation is the list of its turns by turn number, then role,
then text; repeated rows count once, null roles and texts are rendered as empty. Rows without a
conversation id belong to no conversation and are left out. A missing side (null id, or an id without
turns) has no turns: its completion is empty, its mask too. Two equal conversations have empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import written
from tapeloom.llm.native import let, sums_before

#: Opens a turn (before and after the role) and closes it.
OPEN, OPENED, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """A row for each conversation: its id and ``turns`` in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(conv_id).agg(F.array_sort(F.collect_set(one)).cast(TURNS).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(OPENED))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def masked(turns: Column, role: str = "assistant") -> Column:
    """Spans of what the role says in the rendered turns: array of (start, end)."""
    steps = F.flatten(F.transform(turns, lambda t: F.array(F.length(_head(t)), F.length(_body(t)))))

    def spans(before: Column) -> Column:
        at = F.transform(turns, lambda t, i: F.struct((t["role"] == role).alias("on"), F.element_at(before, 2 * i + 2).cast("int").alias("start"), (F.element_at(before, 2 * i + 2) + F.length(_body(t))).cast("int").alias("end")))
        return F.transform(F.filter(at, lambda x: F.coalesce(x["on"], F.lit(False))), lambda x: F.struct(x["start"], x["end"]))

    return let(sums_before(steps), spans)


def pairs_formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two columns of turns by prompt, n_prompt_turns, and for each side its completion and mask."""
    none = F.array().cast(TURNS)
    rest = [c for c in pairs.columns if c not in (chosen, rejected, "prompt", "n_prompt_turns", f"{chosen}_mask", f"{rejected}_mask")]
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    both = pairs.select(*rest, a.alias("_a"), b.alias("_b"))
    both = both.withColumn("n_prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    n = F.col("n_prompt_turns")
    after = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    cut = both.select(*rest, "n_prompt_turns", F.slice("_a", F.lit(1), n).alias("_p"), after(F.col("_a")).alias("_a"), after(F.col("_b")).alias("_b"))
    return cut.select(
        *rest,
        "n_prompt_turns",
        rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_a")).alias(chosen),
        rendered(F.col("_b")).alias(rejected),
        masked(F.col("_a")).alias(f"{chosen}_mask"),
        masked(F.col("_b")).alias(f"{rejected}_mask"),
    )


def format_pairs(pairs: DataFrame, turns: DataFrame, chosen_id: str = "chosen_id", rejected_id: str = "rejected_id") -> DataFrame:
    """Format a table of pairs of conversation ids against the table of turns."""
    known = conversations(turns)
    a = known.select(F.col("conv_id").alias(chosen_id), F.col("turns").alias("chosen"))
    b = known.select(F.col("conv_id").alias(rejected_id), F.col("turns").alias("rejected"))
    return pairs_formatted(pairs.join(a, chosen_id, "left").join(b, rejected_id, "left"))


def same_start_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation chosen against the one with the smallest id that starts with the same turn.

    That one is itself chosen against the largest id of those; without another it has a null rejected_id:
    where all first turns differ, as in the given tables, there are no pairs. A partner with a longer
    common prefix is not looked for.
    """
    first = F.col("turns")[0]
    # the hash passes over nulls, so it is told which part is one
    start = F.xxhash64(first["role"].isNull(), first["role"], first["text"].isNull(), first["text"])
    known = conversations(turns).withColumn("start", start)
    ends = known.groupBy("start").agg(*[f(F.struct("conv_id", "turns")).alias(name) for f, name in ((F.min, "first"), (F.max, "last"))])
    # written, so that the join is of two plain shuffles and a start that many share can be split
    both = known.join(written(ends, "starts"), "start")
    other = F.when(F.col("conv_id") != F.col("first.conv_id"), F.col("first")).when(F.col("conv_id") != F.col("last.conv_id"), F.col("last"))
    return both.select(F.col("conv_id").alias("chosen_id"), other.alias("other"), F.col("turns").alias("chosen")).select("chosen_id", F.col("other.conv_id").alias("rejected_id"), "chosen", F.col("other.turns").alias("rejected"))
