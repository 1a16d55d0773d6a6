"""Reading and writing feeds, artifacts, event logs and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.runtime import written

# Columns that tell the feeds apart.
MBO_REQUIRED = ["ts_event", "action", "side", "price", "size"]
MBP_REQUIRED = ["ts_event", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"]
# Numeric columns of a raw feed and the prefixes of the book's.
NUMERIC = {"price": "double", "size": "bigint", "order_id": "bigint", "sequence": "bigint", "flags": "int", "channel_id": "int", "publisher_id": "int", "instrument_id": "bigint", "rtype": "int", "ts_in_delta": "bigint"}
BOOK_PREFIXES = {"bid_px_": "double", "ask_px_": "double", "bid_sz_": "double", "ask_sz_": "double", "bid_ct_": "double", "ask_ct_": "double"}
CSV = (".csv", ".csv.gz", ".gz", ".csv.zst", ".zst")
# Text times keep their microseconds; the writer's own format would cut them to milliseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read Parquet or CSV by extension (folders as Parquet), keeping those wanted columns that exist."""
    if path.lower().endswith(CSV):
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def load_feed(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Stack files with differing columns; each row knows its file, and ``ingest`` orders rows by file and place in it."""
    out = None
    for path in paths:
        df = read_table(spark, path)
        kept = [c for c in (columns or df.columns) if c in df.columns]
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        df = df.select(*kept, F.col("_metadata.file_name").alias("source_file"), at.alias("ingest"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def feed_type(df: DataFrame) -> str:
    """MBP where the best quotes are there, MBO where order events are, else UNKNOWN."""
    names = set(df.columns)
    if {"bid_px_00", "ask_px_00"} <= names or {"bid_px", "ask_px"} <= names:
        return "MBP"
    return "MBO" if {"action", "side", "price"} <= names else "UNKNOWN"


def missing_columns(df: DataFrame, kind: str | None = None) -> list[str]:
    required = MBP_REQUIRED if (kind or feed_type(df)) == "MBP" else MBO_REQUIRED
    return [c for c in required if c not in df.columns and not (c == "ts_event" and "ts_recv" in df.columns)]


def schema_report(dfs: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row per feed: its type and what it lacks."""
    rows = [(name, feed_type(df), ",".join(missing_columns(df)), not missing_columns(df)) for name, df in dfs.items()]
    return spark.createDataFrame(rows, "feed string, kind string, missing string, passed boolean")


def typed(df: DataFrame) -> DataFrame:
    """Raw text columns as times and numbers by name; what does not parse becomes null."""

    def cast(name: str) -> Column:
        if name in ("ts_event", "ts_recv"):
            return F.try_to_timestamp(F.col(name)).cast("timestamp_ntz")
        kind = NUMERIC.get(name) or next((t for p, t in BOOK_PREFIXES.items() if name.startswith(p)), None)
        return F.expr(f"try_cast(`{name}` AS {kind})") if kind else F.col(name)

    return df.select(*[cast(c).alias(c) for c in df.columns])


def wide_to_arrays(df: DataFrame, levels: int = 10) -> DataFrame:
    """Level columns bid_px_00 … as the arrays the book functions read; absent levels become 0 sizes and null prices."""
    out = df
    for side in ("bid_px", "ask_px", "bid_sz", "ask_sz"):
        default = F.lit(0.0) if side.endswith("sz") else F.lit(None).cast("double")
        cells = [F.col(f"{side}_{i:02d}").cast("double") if f"{side}_{i:02d}" in df.columns else default for i in range(levels)]
        out = out.withColumn(side, F.array(*cells))
    return out.drop(*[f"{s}_{i:02d}" for s in ("bid_px", "ask_px", "bid_sz", "ask_sz") for i in range(levels)])


def write_shards(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_by_date(df: DataFrame, path: str, ts: str = "ts_event") -> None:
    """Parquet in one folder per trade date; a date may span tasks, so a busy day is written by many."""
    df.withColumn("trade_date", F.to_date(ts)).write.mode("overwrite").partitionBy("trade_date").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    if path.lower().endswith(CSV):
        writer.options(header=True, timestampFormat=MICROS, timestampNTZFormat=MICROS).csv(path)
    else:
        writer.parquet(path)


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows and time range of every file of a table."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min("ts_event").alias("ts_min"), F.max("ts_event").alias("ts_max"))


def write_artifact(root: str, features: DataFrame, labels: DataFrame, metadata: DataFrame, info: dict[str, str]) -> DataFrame:
    """Write features, labels and metadata with a one-row manifest; returns the manifest."""
    for name, df in (("features", features), ("labels", labels), ("metadata", metadata)):
        write_shards(df, f"{root}/{name}")
    spark = features.sparkSession
    stats = spark.read.parquet(f"{root}/metadata").agg(F.count(F.lit(1)).alias("rows"), F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"))
    columns = lambda df: F.array(*[F.lit(c) for c in df.columns])
    manifest = stats.select("*", columns(features).alias("feature_columns"), columns(labels).alias("label_columns"), *[F.lit(v).alias(k) for k, v in info.items()])
    manifest.write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.json(f"{root}/manifest")


def load_artifact(spark: SparkSession, root: str, keys: Sequence[str] = ("symbol", "ts_event", "sequence")) -> DataFrame:
    """Features, labels and metadata of an artifact side by side."""
    parts = [spark.read.parquet(f"{root}/{n}") for n in ("features", "labels", "metadata")]
    out = parts[0]
    for df in parts[1:]:
        out = out.join(df.drop(*[c for c in df.columns if c in out.columns and c not in keys]), list(keys))
    return out


def load_features(spark: SparkSession, root: str, keys: Sequence[str] = ("symbol", "ts_event", "sequence")) -> tuple[DataFrame, DataFrame]:
    """The features of `load_artifact`, each row as often as there, without a shuffle of the wide rows.

    Also the table that says how often, for the keys that don't come out once; it is to be discarded after use.
    """
    parts = [spark.read.parquet(f"{root}/{n}") for n in ("features", "labels", "metadata")]
    ones = lambda i: [F.lit(int(i == k)).cast("long").alias(f"_n{k}") for k in (1, 2)]
    held = reduce(DataFrame.unionByName, [df.select(*keys, *ones(i)) for i, df in enumerate(parts)]).dropna(subset=list(keys))
    held = held.groupBy(*keys).agg((F.sum("_n1") * F.sum("_n2")).alias("_times")).filter("_times <> 1")
    times = written(held, "times")
    rows = parts[0].join(times, list(keys), "left")
    absent = reduce(Column.__or__, [F.col(k).isNull() for k in keys])  # a null key meets no other
    copies = F.array_repeat(F.lit(0), F.when(absent, 0).otherwise(F.coalesce("_times", F.lit(1))).cast("int"))
    return rows.withColumn("_copy", F.explode(copies)).drop("_times", "_copy"), times


EVENT_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("extra", T.StructType([T.StructField("stat_features", T.MapType(T.StringType(), T.DoubleType()))])),
    ]
)


def read_event_log(spark: SparkSession, path: str, schema: T.StructType = EVENT_LOG) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_report(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """A small report as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.options(header=True, timestampFormat=MICROS, timestampNTZFormat=MICROS).csv(path) if as_csv else writer.json(path)
