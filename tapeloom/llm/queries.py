"""The registered queries of this package, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, jaccard, langid, merkle, periodic_runs, preference, quality, secret_scan, sentencepiece_codec, substring_dedup, suffix_lm, topk, urlfilter
from tapeloom.llm.common import held_out, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text, as digests."""
    model = piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sentencepiece_codec.encode(docs, model, decoded="decoded")
    return pieces.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sentencepiece_codec.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("covered_bytes"),  # a text may have no pieces
    )


TOP_K_SQL = """
WITH made AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM made q JOIN made c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_exact_top_k", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5).select("query_id", "rank", "vec_id", "score")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; the filters never see the texts held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL; the model learns from a small table of URLs that the rules have labelled."""
    host, path = urlfilter.parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urlfilter.matched(F.col("host"), F.col("path"), URL_RULES)
    pages = pages.withColumns({"rule": rule, "verdict": verdict})
    model = urlfilter.fit(pages)
    return urlfilter.judged(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; labels of the documents held out are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    stats = written(quality.statistics_of(docs, ["doc_id", "held_out"]), "statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    scored = quality.score(stats, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets), items AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM sizes s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = s.doc_id
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike in 90 % of their three-word shingles."""
    found = jaccard.components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def _spans_sql(rule: secret_scan.Rule, order: int) -> str:
    """A list of {start, order, end, kind} of one rule's matches in t."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    sizes, checked = (f"list_transform(regexp_extract_all(t, {pattern}, {g}), lambda x: length(x))" for g in (0, rule.group))
    gaps = f"list_transform(string_split_regex(t, {pattern}), lambda x: length(x))"
    made = "list_transform(range(1, len(z) + 1), lambda i: {'at': list_sum(g[1:i]) + coalesce(list_sum(z[1:i - 1]), 0), 'size': z[i], 'checked': c[i]})"
    kept = f"list_transform(list_filter(m, lambda x: x.checked >= {rule.least}), lambda x: {{'start': x.at::BIGINT, 'ord': {order}, 'stop': (x.at + x.size)::BIGINT, 'kind': '{rule.kind}'}})"
    return f"(SELECT {kept} FROM (SELECT {made} AS m FROM (SELECT {gaps} AS g, {sizes} AS z, {checked} AS c)))"


_JOINED_SQL = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
SECRET_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort(list_concat({", ".join(_spans_sql(r, i) for i, r in enumerate(secret_scan.RULES))})) AS s FROM docs)
SELECT doc_id, {", ".join(f"len(list_filter(s, lambda x: x.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
  sha256({_JOINED_SQL.format(f"list_filter(s, lambda x: x.kind IN ({_BASE_KINDS}))")}) AS base_sha256, {_JOINED_SQL.format("s")} AS spans
FROM found
"""


@query("op4_secret_scan", SECRET_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.BASE_RULES]))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def _rendered_sql(turn: str, part: str = "both") -> str:
    head = f"('<|' || coalesce({turn}.role, '') || '|>' || chr(10))"
    body = f"(coalesce({turn}.text, '') || '<|end|>' || chr(10))"
    return {"head": head, "body": body, "both": f"({head} || {body})"}[part]


def _text_sql(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: {_rendered_sql('x')}), '')"


def _mask_sql(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda x: length({_rendered_sql('x')}))), 0) + length({_rendered_sql(f'{turns}[i]', 'head')})"
    on = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return f"array_to_string(list_transform({on}, lambda i: CAST(({before}) AS BIGINT) || ':' || CAST(({before}) + length({_rendered_sql(f'{turns}[i]', 'body')}) AS BIGINT)), ',')"


PREFERENCE_SQL = f"""
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM once GROUP BY conv_id
), starts AS (
  SELECT turns[1].role AS role, turns[1].text AS text, min(conv_id) AS a, max(conv_id) AS b FROM convs GROUP BY 1, 2
), pairs AS (
  SELECT c.conv_id AS chosen_id, CASE WHEN c.conv_id <> s.a THEN s.a WHEN c.conv_id <> s.b THEN s.b END AS rejected_id, c.turns AS p
  FROM convs c JOIN starts s ON c.turns[1].role IS NOT DISTINCT FROM s.role AND c.turns[1].text IS NOT DISTINCT FROM s.text
), sides AS (
  SELECT chosen_id, rejected_id, p, coalesce(d.turns, []) AS q FROM pairs LEFT JOIN convs d ON d.conv_id = rejected_id
), cut AS (
  SELECT *, coalesce(
    list_min(list_filter(range(1, least(len(p), len(q)) + 1), lambda i: p[i].role IS DISTINCT FROM q[i].role OR p[i].text IS DISTINCT FROM q[i].text)) - 1,
    least(len(p), len(q))) AS n
  FROM sides
), parts AS (SELECT chosen_id, rejected_id, n, p[1:n] AS s, p[n + 1:] AS a, q[n + 1:] AS b FROM cut)
SELECT chosen_id, coalesce(rejected_id, -1) AS rejected_id, n AS n_prompt_turns, {_text_sql("s")} AS prompt, {_text_sql("a")} AS chosen, {_text_sql("b")} AS rejected,
  {_mask_sql("a")} AS chosen_mask, {_mask_sql("b")} AS rejected_mask
FROM parts
"""


@query("op7_preference_format", PREFERENCE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen side of a preference pair; rejected_id is -1 where there is no other side."""
    turns = table(spark, sf_dir, "conversations")
    made = preference.pairs_formatted(preference.same_start_pairs(turns))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return made.select("chosen_id", F.coalesce("rejected_id", F.lit(-1)).alias("rejected_id"), F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


@query("op10_suffix_tree_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text; the tree is fitted on the texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    model, counts = suffix_lm.fit(docs.where(~F.col("held_out")))
    scored = suffix_lm.score(docs, model, counts, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


#: crc32 bit by bit: each byte enters at the first of its eight steps.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)),
  lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT)),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::BIGINT)"""

MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC_SQL} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows
), trees AS (
  SELECT source, list(leaf ORDER BY pos) AS l, 0 AS lev FROM placed GROUP BY source
  UNION ALL
  SELECT source, list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], ''))), lev + 1 FROM trees WHERE len(l) > 1
), subroots AS (
  SELECT source, l[1] AS subroot, lev, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM trees WHERE len(l) = 1
), top AS (
  SELECT list(subroot ORDER BY pos) AS l, 0 AS lev FROM subroots
  UNION ALL
  SELECT list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], ''))), lev + 1 FROM top WHERE len(l) > 1
), crown AS (SELECT l[1] AS root FROM top WHERE len(l) = 1),
steps AS (
  SELECT p.r, t.lev, t.l, p.pos // (16 ** t.lev)::BIGINT AS i FROM placed p JOIN trees t ON t.source IS NOT DISTINCT FROM p.source WHERE len(t.l) > 1
  UNION ALL
  SELECT p.r, s.lev + t.lev, t.l, s.pos // (16 ** t.lev)::BIGINT FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN top t ON len(t.l) > 1
), sides AS (
  SELECT r, lev, array_to_string(l[i - i % 16 + 1:i], '') AS a, array_to_string(l[i + 2:i - i % 16 + 16], '') AS b FROM steps
), fold AS (
  SELECT r, coalesce(changed, leaf) AS h, 0 AS lev, '' AS seen FROM placed
  UNION ALL
  SELECT f.r, sha256(s.a || f.h || s.b), f.lev + 1, f.seen || s.a || s.b FROM fold f JOIN sides s ON s.r = f.r AND s.lev = f.lev
), ends AS (SELECT r, max_by(h, lev) AS folded_root, max_by(seen, lev) AS seen FROM fold GROUP BY r)
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(e.seen) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
FROM placed p JOIN ends e USING (r) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, crown
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest tree per source, its proofs, and their check against every fifth text in lower case."""
    docs = table(spark, sf_dir, "documents")
    row_leaf = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", row_leaf(F.col("text")).alias("leaf"), F.when(tampered, row_leaf(lower)).alias("changed"))
    made = merkle.manifest(written(leaves, "leaves"), "source", ["doc_id"], ["doc_id", "changed"])
    made = made.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SUBSTRING_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM texts
), again AS (
  SELECT r, i, i AS start FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
marked AS (
  SELECT r, word, i, coalesce(i - max(start) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) < 35, false) AS covered
  FROM words LEFT JOIN again USING (r, i)
), made AS (
  SELECT r, count(*) FILTER (WHERE covered) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT covered) AS kept FROM marked GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN made USING (r)
"""


@query("op12_substring_dedup", SUBSTRING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of 35-word windows that occur again."""
    made = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=35)
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


WORD = r"[^\x20\x09-\x0D]+"


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; every tenth one first goes on in circles from one of its words to its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def circling(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.expr("h div 10")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int")))
        return F.when(n > 0, F.array_join(made, " "))

    made = F.element_at(F.transform(F.array(words), circling), 1)  # the words are taken once
    docs = docs.select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.collapsed(docs, least=24)
    longer = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: F.when(longer(x, y) != 0, -longer(x, y)).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
    best = F.get(F.array_sort("runs", lambda x, y: F.signum(order(x, y)).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
