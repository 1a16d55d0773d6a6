"""Market-shaped views over the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 10


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks_of(ev: DataFrame) -> DataFrame:
    action = (
        F.when(F.col("event_type") == "purchase", "T")
        .when(F.col("event_type").isin("click", "signup"), "A")
        .when(F.col("event_type") == "error", "C")
        .otherwise("M")
    )
    return ev.select(
        F.col("user_id").alias("symbol"),
        F.col("ts").alias("ts_event"),
        F.col("event_id").alias("sequence"),
        action.alias("action"),
        F.when(F.col("event_id") % 3 == 0, "B").otherwise("A").alias("side"),
        (F.lit(1000.0) + F.col("value")).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
        F.col("event_id").alias("order_id"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(events(spark, sf_dir))


def book_of(t: DataFrame) -> DataFrame:
    step, seq = F.lit(0.01), F.col("sequence")
    levels = range(LEVELS)
    return t.filter("action <> 'T'").select(
        "symbol",
        "ts_event",
        "sequence",
        F.array(*[F.col("price") - step * (i + 1) for i in levels]).alias("bid_px"),
        F.array(*[F.col("price") + step * (i + 1) for i in levels]).alias("ask_px"),
        F.array(*[((seq * 7 + i * 13) % 50 + 1).cast("double") for i in levels]).alias("bid_sz"),
        F.array(*[((seq * 11 + i * 17) % 50 + 1).cast("double") for i in levels]).alias("ask_sz"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_of(ticks(spark, sf_dir))


# The same views in SQL.
TICKS_CTE = """ticks AS (
  SELECT user_id AS symbol, ts AS ts_event, event_id AS sequence,
         CASE WHEN event_type = 'purchase' THEN 'T' WHEN event_type IN ('click', 'signup') THEN 'A'
              WHEN event_type = 'error' THEN 'C' ELSE 'M' END AS action,
         CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS side,
         1000.0::DOUBLE + value AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + 1 AS size,
         event_id AS order_id
  FROM events)"""
BOOK_CTE = (
    TICKS_CTE
    + """, book AS (
  SELECT symbol, ts_event, sequence,
         list_transform(range(0, 10), lambda i: price - 0.01::DOUBLE * (i + 1)) AS bid_px,
         list_transform(range(0, 10), lambda i: price + 0.01::DOUBLE * (i + 1)) AS ask_px,
         list_transform(range(0, 10), lambda i: ((sequence * 7 + i * 13) % 50 + 1)::DOUBLE) AS bid_sz,
         list_transform(range(0, 10), lambda i: ((sequence * 11 + i * 17) % 50 + 1)::DOUBLE) AS ask_sz
  FROM ticks WHERE action <> 'T')"""
)
TICKS = f"WITH {TICKS_CTE}\n"
BOOK = f"WITH {BOOK_CTE}\n"


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with faults planted by event id: lost times, bad prices and sizes, resets, copies, spikes."""
    fault = F.col("sequence") % 50
    copies = F.sequence(F.lit(0), F.when(fault.isin(6, 7), 1).otherwise(0))
    rows = ticks(spark, sf_dir).withColumn("copy", F.explode(copies))
    price = F.col("price")
    return rows.select(
        "symbol",
        F.when(fault != 1, F.col("ts_event")).alias("ts_event"),
        F.when((fault == 7) & (F.col("copy") == 1), F.expr("ts_event + INTERVAL 1 SECOND")).otherwise(F.col("ts_event")).alias("ts_recv"),
        "sequence",
        F.when(fault == 4, "R").otherwise(F.concat(F.lit(" "), F.lower("action"))).alias("action"),
        F.when(fault == 5, "n").otherwise(F.lower("side")).alias("side"),
        F.when(fault == 2, -price).when(fault == 8, price * 1.5).when(fault == 9, price * 10).when(fault != 10, price).alias("price"),
        F.when(fault == 3, -F.col("size")).when(fault == 11, F.lit(0)).otherwise(F.col("size")).alias("size"),
        "order_id",
        (F.col("sequence") * 2 + F.col("copy")).alias("ingest"),
    )


def raw_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with faults planted by event id: lost, crossed, locked and wide quotes, bad sizes, an outlier."""
    fault = F.col("sequence") % 50

    def bid(p, i):
        return F.when((i == 0) & (fault == 1), 0.0).when((i == 0) & (fault == 2), p + 0.07).when((i == 0) & (fault == 3), F.get("ask_px", 0)).when((i == 4) & (fault == 7), p * 100).otherwise(p)

    return book(spark, sf_dir).select(
        "symbol",
        "ts_event",
        "sequence",
        F.transform("bid_px", bid).alias("bid_px"),
        F.transform("ask_px", lambda p, i: F.when((i == 0) & (fault == 4), p + 10).otherwise(p)).alias("ask_px"),
        F.transform("bid_sz", lambda s, i: F.when((i == 2) & (fault == 5), -1.0).otherwise(s)).alias("bid_sz"),
        F.transform("ask_sz", lambda s, i: F.when((i != 3) | (fault != 6), s)).alias("ask_sz"),
    )


RAW_CTE = """raw AS (
  SELECT symbol, CASE WHEN sequence % 50 <> 1 THEN ts_event END AS ts_event,
         CASE WHEN sequence % 50 = 7 AND c = 1 THEN ts_event + INTERVAL 1 SECOND ELSE ts_event END AS ts_recv, sequence,
         CASE WHEN sequence % 50 = 4 THEN 'R' ELSE ' ' || lower(action) END AS action,
         CASE WHEN sequence % 50 = 5 THEN 'n' ELSE lower(side) END AS side,
         CASE sequence % 50 WHEN 2 THEN -price WHEN 8 THEN price * 1.5::DOUBLE WHEN 9 THEN price * 10 WHEN 10 THEN NULL ELSE price END AS price,
         CASE sequence % 50 WHEN 3 THEN -size WHEN 11 THEN 0 ELSE size END AS size, order_id, sequence * 2 + c AS ingest
  FROM ticks, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR sequence % 50 IN (6, 7))"""
RAW_BOOK_CTE = """raw_book AS (
  SELECT symbol, ts_event, sequence,
         list_transform(bid_px, lambda p, i: CASE WHEN i = 1 AND sequence % 50 = 1 THEN 0.0::DOUBLE WHEN i = 1 AND sequence % 50 = 2 THEN p + 0.07::DOUBLE
           WHEN i = 1 AND sequence % 50 = 3 THEN ask_px[1] WHEN i = 5 AND sequence % 50 = 7 THEN p * 100 ELSE p END) AS bid_px,
         list_transform(ask_px, lambda p, i: CASE WHEN i = 1 AND sequence % 50 = 4 THEN p + 10 ELSE p END) AS ask_px,
         list_transform(bid_sz, lambda s, i: CASE WHEN i = 3 AND sequence % 50 = 5 THEN -1.0::DOUBLE ELSE s END) AS bid_sz,
         list_transform(ask_sz, lambda s, i: CASE WHEN i <> 4 OR sequence % 50 <> 6 THEN s END) AS ask_sz
  FROM book)"""
