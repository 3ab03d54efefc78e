"""Structured Streaming counterparts of periodic crawling, rebuilding and near-duplicate memory."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from tidefeed.operators import dedup

WINDOW, THRESHOLD = dedup.WINDOW, dedup.THRESHOLD


def read_folder(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def periodic(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """A job for every batch; one query per checkpoint, so runs never overlap. every: an interval; none: what there is, once."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


LEAST_HOURS, MOST_HOURS, BUSY_MINUTES = 1, 168, 5


class Interval:
    """When a periodic job is next due, kept as a table of versions (swapped in one step), so that a restart goes on with it.

    hours: 1 to 168, others are refused. A job that is due while one runs is put off by five minutes. Times are UTC.
    """

    def __init__(self, table, hours: int, enabled: bool = True):
        if not LEAST_HOURS <= hours <= MOST_HOURS:
            raise ValueError(f"the interval must be {LEAST_HOURS} to {MOST_HOURS} hours, not {hours}")
        self.table, self.hours, self.enabled = table, hours, enabled

    def state(self) -> dict:
        """next_run, last_run, run_count, last_result; nothing is due before the first next_run is set."""
        rows = self.table.read()
        return json.loads(rows.first().state) if rows is not None else {"next_run": None, "last_run": None, "run_count": 0, "last_result": None}

    def _keep(self, state: dict) -> dict:
        rows = self.table.spark.createDataFrame([(json.dumps(state),)], "state string")
        self.table.switch(self.table.write(rows))
        return state

    def due(self, now: datetime) -> bool:
        """Whether a run is due; the first look only sets when."""
        if not self.enabled:
            return False
        state = self.state()
        if state["next_run"] is None:
            self._keep(state | {"next_run": (now + timedelta(hours=self.hours)).isoformat()})
            return False
        return now >= datetime.fromisoformat(state["next_run"])

    def poll(self, now: datetime, job: Callable[[], str], running: bool = False) -> bool:
        """Runs the job if it is due; returns whether it ran. Its next run counts from now, whether or not it succeeds."""
        if not self.due(now):
            return False
        state = self.state()
        if running:
            self._keep(state | {"next_run": (now + timedelta(minutes=BUSY_MINUTES)).isoformat()})
            return False
        state |= {"last_run": now.isoformat(), "next_run": (now + timedelta(hours=self.hours)).isoformat(), "run_count": state["run_count"] + 1}
        self._keep(state | {"last_result": "running"})
        try:
            result = job()
        except Exception as e:
            result = f"failed: {type(e).__name__}"
        self._keep(state | {"last_result": result})
        return True

    def remaining(self, now: datetime) -> int | None:
        """Seconds until the next run; none if there is none."""
        at = self.state()["next_run"]
        return None if not self.enabled or at is None else max(0, int((datetime.fromisoformat(at) - now).total_seconds()))


class Progress(StreamingQueryListener):
    """What streams have done: a row a batch, as they go."""

    def __init__(self):
        self.batches: list[dict] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))


def rebuild_for_new_users(known: Callable[[], DataFrame], rebuild: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that rebuilds only if the batch has users not seen before."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.select("user_id").distinct().join(known(), "user_id", "left_anti").isEmpty():
            rebuild()

    return each


def crawl_then_rebuild(crawl: Callable[[DataFrame, int], None], rebuild: Callable[[str], None], auto: bool = True) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: takes a crawl's batch in and then, if that succeeded and `auto` is set, rebuilds the model with its reason."""

    def each(batch: DataFrame, number: int) -> None:
        crawl(batch, number)
        if auto:
            rebuild("auto-after-crawl")

    return each


def into_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream's rows as Parquet, each batch once: it has a folder of its own, which a batch that is tried again replaces. Read with from_folder.

    Appended batches add up; of complete results the last batch is the result.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    with stateful(stream.sparkSession):
        return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def from_folder(spark: SparkSession, path: str, schema, mode: str = "append") -> DataFrame:
    """What into_folder has written."""
    rows = spark.read.option("basePath", path).schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return rows.drop("batch")


@contextmanager
def stateful(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which state of several values a key needs; the session's own setting stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


class SourceMemory(StatefulProcessor):
    """What a source has accepted: its last WINDOW fingerprints as a list, and the hashes of all of its addresses and contents as maps.

    A batch's rows of a source are taken in order of seq. With the hashes, a row with a known one is a duplicate; then a row within
    THRESHOLD bits of one of the last fingerprints is a near-duplicate; else it is new and remembered. State is written with the
    batch, so a batch that is tried again starts from the state before it.
    """

    HASHES = ("url_hash", "content_hash")

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "fp long")
        self.known = {h: handle.getMapState(h, "hash string", "seq long") for h in self.HASHES}

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        held = [r[0] for r in self.last.get()] if self.last.exists() else []
        last = np.array(held, np.int64)
        hashes = [h for h in self.HASHES if h in frame.columns]
        new = {h: {x: None for x in frame[h].unique() if self.known[h].containsKey((x,))} for h in hashes}
        out = []
        for i, fp in enumerate(frame["fp"].to_numpy(np.int64)):
            own = {h: frame[h].iat[i] for h in hashes}
            if any(own[h] in new[h] for h in hashes):
                out.append("duplicate")
            elif len(last) and (np.bitwise_count((last ^ fp).view(np.uint64)) <= THRESHOLD).any():
                out.append("near_dup")
            else:
                out.append("new")
                last = np.append(last, fp)[-WINDOW:]
                for h in hashes:
                    new[h][own[h]] = int(frame["seq"].iat[i])
        for h in hashes:
            for x, seq in new[h].items():
                if seq is not None:
                    self.known[h].updateValue((x,), (seq,))
        self.last.put([(int(x),) for x in last])
        yield pd.DataFrame({"source": [key[0]] * len(frame), "seq": frame["seq"], "status": out})

    def close(self) -> None:
        pass


def near_duplicate_memory(stream: DataFrame) -> DataFrame:
    """stream (seq, source, fp and, if copies are told apart, url_hash and content_hash) to source, seq, status. Start it within stateful()."""
    return stream.groupBy("source").transformWithStateInPandas(SourceMemory(), "source string, seq long, status string", "append", "none")


def first_of_each(stream: DataFrame, key: str) -> DataFrame:
    return stream.dropDuplicates([key])
