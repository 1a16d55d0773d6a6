"""A corpus pipeline in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept:

* quality: documents that the classifier rejects go;
* near_duplicates: of each group of documents alike in 80 % of their five-word shingles one stays;
* decontaminate: documents that hold a benchmark item go;
* secrets: secrets in the texts are replaced by their kind;
* tokens: texts become pieces with their spans.

All but the last return the columns that they were given, others than those of documents included,
whatever their names. Null and empty texts, texts without words and texts of any length pass every stage
by its own rule: they are scored, never near copies of another, hold no benchmark item and no secret, and
have no pieces. Of rows with the same id and text one stays (near_duplicates); rows with the same id and
other texts are told apart. Empty tables give empty ones. `tokens` needs lang and source, and keeps
only these, the id and the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate as contamination
from tapeloom.llm import jaccard, secret_scan, sentencepiece_codec
from tapeloom.llm import quality as classifier
from tapeloom.llm.common import held_out, table, unused, written
from tapeloom.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a quality score of 0.3 or more."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    ids = F.broadcast(classifier.sample_of(labels).select("doc_id"))  # bounded
    stats = classifier.statistics_of(docs.join(ids, "doc_id", "left_semi"), ["doc_id"])
    model = classifier.fit(stats, labels, F.lit(True))
    score = unused(docs, "score")
    return classifier.scored(docs, model, name=score).where(F.col(score) >= 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard.deduplicated(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark item."""
    hits = unused(docs, "hits")
    found = contamination.flagged(docs, table(spark, sf_dir, "benchmark"), hits=hits)
    return found.where(F.size(hits) == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with secrets replaced by their kind."""
    spans = unused(docs, "spans")
    found = secret_scan.scan(docs, spans=spans)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, and each one's span in the bytes of the text."""
    pieces = sentencepiece_codec.encode(docs, piece_model())
    return pieces.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Trained trees and byte-pair merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
