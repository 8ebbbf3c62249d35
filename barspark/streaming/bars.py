"""The same bars from a stream: a bar is closed when the watermark has passed its end."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.band import Band
from barspark.sources.tables import ohlcv
from barspark.streaming import folds
from barspark.streaming.ordered import STORE, in_order


def tick_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """symbol, ts, price, size, event_id of new files of events; ts is a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(folder)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")


def closed_bars(ticks: DataFrame, frame: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """symbol, ts (start of the bar) and OHLCV; ticks later than `late` are dropped, as a stale intent would be."""
    order = F.struct("ts", "event_id")
    window = F.window("ts", frame, slide) if slide else F.window("ts", frame)
    bars = ticks.withWatermark("ts", late).groupBy(window.alias("w"), "symbol").agg(*ohlcv(F.col("price"), order, F.col("size")))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """symbol, start, end and number of ticks of runs without a pause over gap."""
    rows = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("ticks"))
    return rows.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks")


def once_a_bar(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each symbol and ts within the watermark: a bar is evaluated once."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def keyed(ticks: DataFrame) -> DataFrame:
    """ticks (symbol, ts, price, event_id) as the rows that folds read."""
    return ticks.select(F.col("symbol").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("seq"), F.col("price").cast("double").alias("value"))


def crossing_signals(ticks: DataFrame, fast: int = 5, slow: int = 20, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, action, price, pnl: a position that an exponential crossing opens and closes, in order of ts and event_id."""
    return in_order(keyed(ticks), folds.Crossing(fast, slow), late).withColumnRenamed("key", "symbol")


def stops(fills: DataFrame, prices: DataFrame, rule: folds.LiveStops, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, action, quantity, price, entry, reason: live stops of positions that fills open.

    fills are ticks with side (+1 or -1) and quantity, prices are ticks. At one time and number a fill goes before a price.
    """
    bought = fills.select(F.col("symbol").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("seq"), F.lit("fill").alias("kind"), F.col("price").cast("double").alias("value"), (F.col("side") * F.col("quantity")).cast("double").alias("side"))
    none = F.lit(None)
    seen = keyed(prices).select("key", "ts", "seq", none.cast("string").alias("kind"), "value", none.cast("double").alias("side"))
    return in_order(bought.union(seen), rule, late).withColumnRenamed("key", "symbol")


def notices(evaluations: DataFrame, rule: folds.Notices, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, pattern, label of the signals to tell, of evaluations (symbol, ts, seq, pattern, label); a null pattern is one that found nothing."""
    rows = evaluations.select(F.col("symbol").cast("string").alias("key"), "ts", "seq", F.col("pattern").alias("kind"), "label")
    return in_order(rows, rule, late).withColumnRenamed("key", "symbol")


def once_a_day(ticks: DataFrame, minute: int = 14 * 60, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, event_id, price of each day's first tick at or after a minute of the day."""
    rows = in_order(keyed(ticks), folds.DailyGate(minute), late)
    return rows.withColumnsRenamed({"key": "symbol", "seq": "event_id", "value": "price"})


def band_orders(ticks: DataFrame, b: Band, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, kind (open, close or stale), action, quantity, price of the band strategy; a stale order has what it would have done as action."""
    return in_order(keyed(ticks), folds.BandOrders(b), late).withColumnRenamed("key", "symbol")


def delivered(df: DataFrame, batch: int, where: str) -> None:
    """A sink for foreachBatch that may be called twice for a batch: each batch has a folder of its own, which a repeat writes anew."""
    df.write.mode("overwrite").parquet(f"{where}/batch={batch}")


def run_to_end(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, with its checkpoint in where/state, and returns all that it has ever put out, in where/out.

    Called again with the same folder it goes on from the checkpoint: state, timers and rows that wait are kept.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(partial(_deliver, where=f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{where}/out/batch=*")


def _deliver(df: DataFrame, batch: int, where: str) -> None:
    delivered(df, batch, where)


def drained(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, as a table beside its checkpoint."""
    spark, where = stream.sparkSession, f"{checkpoint}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")
