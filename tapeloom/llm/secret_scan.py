"""Secret scans over a trigram inverted index.

1. A Boolean query over trigrams is derived from each rule's regular expression: every match must
   contain all trigrams of one of its clauses (`trigram_query`). Letters are folded to lower case.
2. The index holds a posting (trigram, document) for every trigram of the queries and every document
   that contains it (`postings`).
3. Postings are intersected per clause; documents that meet a clause are the rule's candidates.
4. Candidates are verified by the regular expression; a rule without mandatory trigrams scans all texts.

All of it is DataFrame functions. Matches are leftmost and do not overlap, per rule; those whose
``group`` is shorter than ``least`` characters are dropped after matching. Spans are in code points,
end exclusive, by start, then in the order of the rules. Null and empty texts have no spans. Postings
name a document by a hash of its id and text, so repeated rows and null ids need no care; were two
hashes equal, a text would be scanned in vain, never missed.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.native import let, sums_before

Clause = frozenset[str]
#: Most strings that a part of an expression is spelled out to.
SPELLED = 128
#: Most trigrams of a clause that postings are asked for: bits of a long.
ASKED = 62


@dataclass(frozen=True)
class Rule:
    """pattern: an expression that Java and Python read alike. base: one of the fixed kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# A run of one class is taken whole, so dropping runs that are too short is the same as asking for longer ones.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
]
MORE_RULES = [
    Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
]
RULES = BASE_RULES + MORE_RULES


def _spelled(op, arg) -> set[str] | None:
    """All strings that a node matches, in lower case; None: too many."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _spelled_all(arg[-1])
    if op is rc.BRANCH:
        ways = [_spelled_all(w) for w in arg[1]]
        return None if None in ways or sum(map(len, ways)) > SPELLED else set().union(*ways)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4 and (inner := _spelled_all(arg[2])) is not None:
        if sum(len(inner) ** n for n in range(arg[0], arg[1] + 1)) <= SPELLED:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(sorted(inner), repeat=n)}
    return None


def _spelled_all(nodes) -> set[str] | None:
    done = {""}
    for op, arg in nodes:
        more = _spelled(op, arg)
        if more is None or len(done) * len(more) > SPELLED:
            return None
        done = {a + b for a in done for b in more}
    return done


def _least(clauses: set[Clause]) -> set[Clause]:
    """Without the clauses that ask for more than another one."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: set[Clause], b: set[Clause]) -> set[Clause]:
    return _least({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> set[Clause]:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _required(nodes) -> set[Clause]:
    out, spelled = {frozenset()}, {""}
    for op, arg in nodes:
        more = _spelled(op, arg)
        if more is not None and len(spelled) * len(more) <= SPELLED:
            spelled = {a + b for a in spelled for b in more}
            continue
        out, spelled = _both(out, _of_strings(spelled)), more if more is not None else {""}
        if more is None:
            if op is rc.SUBPATTERN:
                out = _both(out, _required(arg[-1]))
            elif op is rc.BRANCH:
                out = _both(out, _least(set().union(*(_required(w) for w in arg[1]))))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                out = _both(out, _required(arg[2]))
    return _both(out, _of_strings(spelled))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses of which every match of the pattern meets one, a clause being trigrams that occur together.

    Empty: no trigram is mandatory.
    """
    clauses = _required(rp.parse(pattern))
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def postings(df: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: a row (trigram, key) for each of the trigrams and each text with it."""
    known = F.array(*[F.lit(t) for t in trigrams])
    found = let(F.lower(F.col(text)), lambda low: F.filter(known, lambda t: F.contains(low, t)))
    return df.select(F.explode(found).alias("trigram"), F.col(key))


def candidates(index: DataFrame, queries: dict[str, list[Clause]], key: str) -> DataFrame:
    """Intersect postings: (key, kinds), the kinds of which a text meets a clause."""
    numbered = [(n, kind, clause) for n, (kind, clause) in enumerate((k, c) for k, cs in queries.items() for c in cs)]
    spark = index.sparkSession
    # a bit for each trigram of a clause, beyond `ASKED` of them the rest is left to the verification
    asked = spark.createDataFrame([(t, n, 1 << i) for n, _, clause in numbered for i, t in enumerate(sorted(clause)[:ASKED])], "trigram string, clause int, bit long")
    met = F.create_map(*[F.lit(x) for n, _, clause in numbered for x in (n, (1 << min(len(clause), ASKED)) - 1)]).cast("map<int,bigint>")
    kind = F.create_map(*[F.lit(x) for n, k, _ in numbered for x in (n, k)])
    both = index.join(F.broadcast(asked), "trigram")  # a row for each trigram of a rule
    whole = both.groupBy(key, "clause").agg(F.bit_or("bit").alias("seen"))
    return whole.where(F.col("seen") == met[F.col("clause")]).groupBy(key).agg(F.collect_set(kind[F.col("clause")]).alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All spans of one rule: start, order, end, kind."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("checked"),
    )

    def placed(p: Column) -> Column:
        gaps = F.transform(F.slice(p["gaps"], 1, F.size(p["sizes"])), F.length)
        start = sums_before(F.flatten(F.zip_with(gaps, p["sizes"], lambda g, s: F.array(g, s))))
        one = lambda s, i: F.struct(
            F.element_at(s, 2 * i + 2).cast("int").alias("start"), F.lit(order).alias("order"), (F.element_at(s, 2 * i + 2) + F.element_at(p["sizes"], i + 1)).cast("int").alias("end"), F.lit(rule.kind).alias("kind"), F.element_at(p["checked"], i + 1).alias("checked")
        )
        made = let(start, lambda s: F.transform(p["sizes"], lambda _, i: one(s, i)))
        return F.transform(F.filter(made, lambda x: x["checked"] >= rule.least), lambda x: x.dropFields("checked"))

    return F.when(F.regexp_like(text, pattern), let(parts, placed)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def scan(df: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns of ``df`` and ``spans``: array of (start, order, end, kind) of every secret found.

    A column with the new name is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    key, kinds = "_secret_key", "_secret_kinds"
    rows = df.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    if queries:
        index = postings(rows, sorted({t for q in queries.values() for c in q for t in c}), key, text)
        found = candidates(index, queries, key).withColumnRenamed("kinds", kinds)
        rows = rows.join(found.hint("shuffle_hash"), key, "left")
    else:
        rows = rows.withColumn(kinds, F.lit(None).cast("array<string>"))
    none = F.array().cast(SPANS)
    whole = F.coalesce(F.col(text), F.lit(""))
    each = [spans_of(whole, r, i) if r.kind not in queries else F.when(F.array_contains(kinds, r.kind), spans_of(whole, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.withColumn(spans, F.array_sort(F.concat(none, *each))).drop(key, kinds)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
