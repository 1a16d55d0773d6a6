"""Streams over the same feeds: bars, machines with keyed state, joins, sessions and monitoring.

Watermarks bound the state: rows later than ``LATE`` behind the newest are dropped by windows,
joins and deduplication. Sources should set maxFilesPerTrigger (or the like), which bounds what a
key brings to one micro-batch.

The last windows of a stream stay open, as nothing moves the watermark past them. `Closing` ends the
input: a marker, given once all rows have been read, that moves the watermark past every window.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.machines import Machine, run
from tapeloom.functions.market import is_buy, is_sell, is_trade
from tapeloom.runtime import shared_path

LATE = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append", arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run a stream over all data there is now, into a Parquet table in the shared folder, and read that.

    ``arrivals``: steps that bring new data. After each of them the stream goes on from its state.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    for arrive in arrivals or [lambda: None]:
        arrive()
        writer.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Closing:
    """The end of a stream's input. `write` it as the last arrival; rows that come later are late."""

    TIME = "2200-01-01 00:00:00"  # within the range of nanoseconds

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_path(spark, "closing")
        spark.createDataFrame([], "at timestamp").write.parquet(self.folder)

    def write(self) -> None:
        self.spark.range(1).select(F.lit(self.TIME).cast("timestamp").alias("at")).write.mode("append").parquet(self.folder)

    def after(self, rows: DataFrame, time: str) -> DataFrame:
        """The rows, then a marker with nulls. Its own window is never past the watermark, so it is in no result."""
        marker = self.spark.readStream.schema("at timestamp").parquet(self.folder)
        return rows.unionByName(marker.select(*[F.col("at").alias(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def watermarked(rows: DataFrame, closing: Closing | None, time: str = "ts_event", late: str = LATE) -> DataFrame:
    return (closing.after(rows, time) if closing else rows).withWatermark(time, late)


def streaming_bars(ticks: DataFrame, freq: str, closing: Closing | None = None, late: str = LATE) -> DataFrame:
    """Trade bars, sent once their window is past the watermark. ``ts_event`` must be TIMESTAMP."""
    order, size = F.struct("ts_event", "sequence"), F.col("size").cast("double")
    rows = watermarked(ticks.filter(is_trade() & (F.col("price") > 0)), closing, late=late)
    bars = rows.groupBy("symbol", F.window("ts_event", freq).alias("w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum(size).alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
        F.sum(F.when(is_buy(), size).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(is_sell(), size).otherwise(0.0)).alias("sell_volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume", "tick_count", "buy_volume", "sell_volume")


class _Runner(StatefulProcessor):
    """Keeps a machine's state per key as JSON and feeds it a micro-batch in time order."""

    def __init__(self, machine: Machine, order: Sequence[str], columns: Sequence[str]):
        self.machine, self.order, self.columns = machine, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else json.loads(json.dumps(self.machine.start))
        values = [[None if v is None or v != v else v for v in batch[c].tolist()] for c in self.machine.inputs]
        results, state = run(self.machine, state, values)
        self.state.update((json.dumps(state),))
        out = batch[self.columns].copy()
        for i, name in enumerate(self.machine.outputs):
            out[name] = pd.Series([r[i] for r in results], index=out.index, dtype="object")
        yield out

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, machine: Machine, keep: Sequence[str], order: Sequence[str] = ("ts_event", "sequence"), key: str = "symbol") -> DataFrame:
    """A machine over each key's rows as they come, with its state in the state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = [stream.schema[c] for c in keep]
    types = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in machine.outputs.items()))
    return stream.groupBy(key).transformWithStateInPandas(_Runner(machine, order, keep), T.StructType(fields + types.fields), "Append", "None")


class _Ordered(StatefulProcessor):
    """Feeds each key's machine in time order, whatever order rows arrive in.

    Rows wait in list state until the watermark has passed them: no earlier row can come any more.
    A timer at the earliest waiting row's time gives the turn. A call serves all keys of a bucket, and a
    value of state holds a chunk of rows or of machines, so that the calls do not grow with the keys.
    Rows are JSON objects made by Spark, in ``inputs``, ``columns`` and ``order``; a waiting one is not parsed.
    """

    CHUNK = 10_000  # rows or machines in a value of state

    def __init__(self, machine: Machine, order: Sequence[str], columns: Sequence[str]):
        self.machine, self.order, self.columns = machine, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])
        self.states = handle.getListState("states", text(["owners", "json"]))
        self.waiting = handle.getListState("waiting", text(["us", "owners", "rows"]))

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        parts = [rows[i : i + self.CHUNK] for i in range(0, len(rows), self.CHUNK)]
        return [tuple("\n".join(map(str, c)) for c in zip(*part)) for part in parts]

    def _load(self, values) -> Iterator[tuple]:
        for value in values:
            yield from zip(*[c.split("\n") for c in value])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            if not len(chunk):  # a call without input
                continue
            us = chunk["event_us"].tolist()
            first = min([*us, *([] if first is None else [first])])
            self.waiting.appendList(self._chunks(list(zip(us, chunk["owner"].tolist(), chunk["row"].tolist()))))
        if first is not None and all(t > first // 1000 + 1 for t in self.handle.listTimers()):
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[str, list] = {}
        rest, soonest = [], None
        for us, owner, row in self._load(self.waiting.get()):
            if int(us) <= passed:
                ready.setdefault(owner, []).append(row)
            else:
                rest.append((us, owner, row))
                soonest = int(us) if soonest is None else min(soonest, int(us))
        self.waiting.put(self._chunks(rest)) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(soonest // 1000 + 1)
        if not ready:
            return
        states = dict(self._load(self.states.get()))
        begin, kept = json.dumps(self.machine.start), []
        for owner, lines in ready.items():
            due = [json.loads(line) for line in lines]
            for row in due:
                row["inputs"] = [float(v) if v in ("Infinity", "-Infinity") else v for v in row["inputs"].values()]
                row["order"] = list(row["order"].values())
            due.sort(key=lambda row: row["order"])
            results, state = run(self.machine, json.loads(states.get(owner, begin)), list(zip(*[row["inputs"] for row in due])))
            states[owner] = json.dumps(state)
            kept += [[*row["columns"].values(), *result] for row, result in zip(due, results)]
            if len(kept) >= self.CHUNK:
                yield self._frame(kept)
                kept = []
        self.states.put(self._chunks(list(states.items())))
        if kept:
            yield self._frame(kept)

    def _frame(self, rows: list[list]) -> pd.DataFrame:
        names = [*self.columns, *self.machine.outputs]
        return pd.DataFrame({n: pd.Series(list(c), dtype="object") for n, c in zip(names, zip(*rows))})

    def close(self) -> None:
        pass


EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _coded(field: T.StructField) -> Column:
    """A value as JSON has it: times in microseconds, no NaN."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{field.name}`)")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c


def _decoded(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(c).alias(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.expr(f"timestampadd(MICROSECOND, `{field.name}`, {EPOCH})").alias(field.name)
    return c


def run_ordered(stream: DataFrame, machine: Machine, keep: Sequence[str], order: Sequence[str] = ("ts_event", "sequence"), key: str = "symbol", late: str = LATE, closing: Closing | None = None, buckets: int = 1024) -> DataFrame:
    """A machine over each key's rows in time order, as long as none is later than ``late``.

    Gives the rows that the batch fold gives, however they arrive; a row comes out once the watermark
    has passed it, the last ones after `Closing`. State: the rows of the last ``late`` and each key's machine,
    in ``buckets`` of keys. A task holds one bucket at a time; the number is fixed for the life of a checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in machine.outputs.items()))
    packed = lambda names: F.struct(*[_coded(stream.schema[c]).alias(c) for c in names])
    row = F.to_json(F.struct(packed(order).alias("order"), packed(keep).alias("columns"), packed(machine.inputs).alias("inputs")), {"ignoreNullFields": "false"})
    rows = watermarked(stream, closing, order[0], late).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.unix_micros(order[0]).alias("event_us"), order[0],
        F.to_json(F.struct(F.col(key))).alias("owner"), row.alias("row"),
    )
    had = [stream.schema[c] for c in keep]
    plain = [T.StructField(f.name, T.LongType()) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else f for f in had]
    out = rows.groupBy("bucket").transformWithStateInPandas(_Ordered(machine, order, keep), T.StructType(plain + types.fields), "Append", "EventTime")
    return out.select(*[_decoded(f) for f in had], *types.names)


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First copy of each key; later copies within the watermark are dropped."""
    return stream.withWatermark("ts_event", LATE).dropDuplicatesWithinWatermark(list(keys))


def sessions(stream: DataFrame, gap: str, closing: Closing | None = None) -> DataFrame:
    """Runs of rows per key without a longer gap: begin, last row and count. A run's end is a gap found."""
    rows = watermarked(stream, closing)
    out = rows.groupBy("symbol", F.session_window("ts_event", gap).alias("s")).agg(F.max("ts_event").alias("last_ts"), F.count(F.lit(1)).alias("rows"))
    return out.select("symbol", F.col("s.start").alias("first_ts"), "last_ts", "rows")


def matched_outcomes(predictions: DataFrame, ticks: DataFrame, horizon: str) -> DataFrame:
    """Each prediction with the last trade price of the window after its own, once that is final."""
    trades = ticks.filter(is_trade()).withWatermark("ts_event", LATE)
    closes = trades.groupBy("symbol", F.window("ts_event", horizon).alias("w")).agg(F.max_by("price", F.struct("ts_event", "sequence")).alias("outcome_price"))
    closes = closes.select(F.col("symbol").alias("o_symbol"), F.col("w.start").alias("o_start"), F.window_time("w").alias("o_time"), "outcome_price")
    made = predictions.withWatermark("ts_event", LATE).withColumn("due", F.window("ts_event", horizon)["end"])
    near = (F.col("o_symbol") == F.col("symbol")) & (F.col("o_start") == F.col("due")) & (F.col("o_time") >= F.col("ts_event")) & (F.col("o_time") <= F.col("ts_event") + F.expr(f"2 * INTERVAL {horizon}"))
    out = made.join(closes, near)
    return out.select("symbol", "ts_event", "sequence", "price", "outcome_price", (F.col("outcome_price") > F.col("price")).alias("rose"))


def windowed_summary(log: DataFrame, window: str, base: dict[str, float], closing: Closing | None = None) -> DataFrame:
    """Monitoring counts and ratios per window of time, with their distance to a baseline."""
    from tapeloom.operators.monitor import _summary, with_deltas

    rows = watermarked(log, closing, "ts")
    out = rows.groupBy(F.window("ts", window).alias("w")).agg(*_summary(rows, []))
    return with_deltas(out.withColumn("window_start", F.col("w.start")).drop("w"), base)


