"""Miss cards as a stateful stream: a title with enough misses opens a card, once while it is open; a card without further misses for a while closes by itself."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..scratch import exists, listed

STATE = "n int, open boolean, last timestamp"
CARDS = "title string, event string, n int, at timestamp"


class Cards(StatefulProcessor):
    """For each title: misses since the card was last closed, whether it is open, and the last miss. A timer by event time closes what has been quiet."""

    def __init__(self, least: int, quiet_ms: int):
        self.least, self.quiet_ms = least, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, is_open, last = self.card.get() if self.card.exists() else (0, False, None)
        at = None
        for pdf in rows:
            for ts in sorted(pdf["ts"]):
                n, last = n + 1, ts if last is None else max(pd.Timestamp(last), ts)
                if n >= self.least and not is_open:
                    is_open, at = True, ts
        self.card.update((n, is_open, pd.Timestamp(last).to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + self.quiet_ms)
        if at is not None:
            yield pd.DataFrame({"title": [key[0]], "event": ["open"], "n": [n], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, is_open, _ = self.card.get()
        self.card.clear()
        if is_open:
            at = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC).replace(tzinfo=None)
            yield pd.DataFrame({"title": [key[0]], "event": ["closed"], "n": [n], "at": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def card_events(misses: DataFrame, least: int = 5, quiet: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """(title, event, n, at) from a stream of misses (title, ts) with a watermark on ts."""
    return misses.select("title", "ts").groupBy("title").transformWithStateInPandas(
        statefulProcessor=Cards(least, int(quiet.total_seconds() * 1000)), outputStructType=CARDS, outputMode="append", timeMode="EventTime"
    )


def write_once(root: str):
    """A sink for foreachBatch: each micro-batch has a folder of its own, which a replay of that batch writes anew, so no row counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return put


def written(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of complete micro-batches."""
    done = [n for n in listed(root) if n.startswith("batch=") and exists(f"{root}/{n}/_SUCCESS")] if exists(root) else []
    return spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in done]) if done else spark.createDataFrame([], schema)


def run_cards(misses: DataFrame, root: str, checkpoint: str, least: int = 5, quiet: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """Take all that has arrived through the stream and its sink; the card events that the sink holds then."""
    spark = misses.sparkSession
    conf, backend = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    own = spark.conf.get(conf)
    spark.conf.set(conf, backend)  # the state store that this operator needs
    try:
        query = card_events(misses, least, quiet).writeStream.foreachBatch(write_once(root)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, own)
    return written(spark, root, CARDS)


def open_cards(events: DataFrame) -> DataFrame:
    """(title, opened): cards whose last event is an opening."""
    last = events.groupBy("title").agg(F.max_by("event", F.struct("at", F.col("event") == "open")).alias("event"), F.max(F.when(F.col("event") == "open", F.col("at"))).alias("opened"))
    return last.where("event = 'open'").select("title", "opened")
