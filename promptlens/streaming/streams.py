"""Structured Streaming forms of the gateway.

The transformations are the batch column builders applied to streaming
DataFrames; only the stateful parts differ:

* counters / hourly figures: streaming aggregations (complete mode, or a
  watermark + event-time window in append mode, where late rows are dropped);
* dedup: ``dropDuplicates`` on the event id, without a watermark, or an anti-join
  to the ledger's partitions of the arriving dates, without state;
* scoring: the batch projection on the stream itself; with custom rules, per
  micro-batch, the rule table read anew each time;
* rate limiting: ``transformWithState`` with a list of at most ``limit``
  remembered timestamps per key, removed by a processing-time timer; no
  watermark, so every request gets a decision, however late;
* retention: ``foreachBatch`` folding each batch into a newest-N snapshot.

Every sink gets its own checkpoint location under the shared checkpoint folder,
so a restarted query resumes from its last committed batch.
"""

from __future__ import annotations

import datetime
from bisect import bisect
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptlens.functions import rules as R
from promptlens.operators import ledger as L
from promptlens.operators import scoring
from promptlens.operators.ratelimit import NULL_KEY, admit_run
from promptlens.operators.references import TASK, of_one_task
from promptlens.operators.reports import avg4, cents
from promptlens.schemas import DEFAULT_RATE_LIMIT, DEFAULT_RATE_WINDOW_S, LEDGER_COLUMNS, LEDGER_PARTITION
from promptlens.session import remove_path, scratch_path
from promptlens.sources import ledger_io

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def event_time(df: DataFrame, unix_ts_col: str = "unix_ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(F.col(unix_ts_col)))


def counters_stream(ledger_stream: DataFrame) -> DataFrame:
    """Running totals per status (complete mode)."""
    return ledger_stream.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def hourly_stream(ledger_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Hour x status counts and average latency over event time.

    In append mode a window is emitted once the watermark passes its end; rows
    later than the watermark are dropped (our policy for late data).
    """
    return (event_time(ledger_stream).withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 hour").alias("w"), "status")
            .agg(F.count(F.lit(1)).alias("count"), F.sum(cents(F.col("latency_ms"))).alias("lat_cents"),
                 F.count("latency_ms").alias("lat_n"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:00").alias("hour"), "status", "count",
                    avg4(F.col("lat_cents"), F.col("lat_n"), 100).alias("avg_latency")))


def dedup_stream(ledger_stream: DataFrame) -> DataFrame:
    """First arrival of each event id wins, however late it is.

    No watermark: it would drop late first arrivals. The state is one entry per id ever seen.
    """
    return ledger_stream.dropDuplicates(["id"])


def dedup_batch_writer(spark: SparkSession, path: str, horizon_days: int = 1):
    """foreachBatch function that appends to the ledger only events whose id it does not hold.

    The ledger itself is the memory, so no state grows with the ids ever seen. A batch is
    made unique first; its ids are then looked up in the ledger's partitions from
    ``horizon_days`` before its oldest event to as many after its newest: a repeated delivery
    bears its event's time, give or take the horizon. Late first arrivals are looked up among
    the dates of their own time and kept. A replayed batch finds what it wrote before. A batch is
    stored once as the ledger would be; its rows are decided without their payloads, and of these
    only texts that the ledger lacks are moved, once each.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stage = scratch_path(spark, "batch")
        try:
            rows = batch.withColumn(L.DIGEST, L.row_digest(batch)).select(*LEDGER_COLUMNS, L.DIGEST)
            ledger_io.append_stored(ledger_io.on_disk(rows).withColumn(TASK, F.spark_partition_id()), f"{stage}/arrived")
            arrived, day = ledger_io.stored_rows(spark, f"{stage}/arrived", f"{L.DIGEST} long"), F.col(LEDGER_PARTITION)
            first, last, some = arrived.agg(F.min(day), F.max(day), F.count(F.lit(1))).first()
            if not some:
                return
            known = _exists(spark, path)
            if known:
                held = ledger_io.stored_rows(spark, path)
                if first is not None:
                    margin = datetime.timedelta(days=horizon_days)
                    held = held.filter(day.isNull() | day.between(F.lit(first - margin), F.lit(last + margin)))
                else:
                    held = held.filter(day.isNull())

            def decide(part: Callable[[DataFrame], DataFrame]) -> DataFrame:
                new = L.first_of_ids(part(arrived))
                return new.join(part(held.select("id")), "id", "left_anti") if known else new

            new = L.in_parts(arrived, decide, f"{stage}/new")
            wanted = new.select(ledger_io.STORED_REF)
            if known:
                wanted = wanted.join(ledger_io.text_records(spark, path).select(ledger_io.STORED_REF), ledger_io.STORED_REF, "left_anti")
            records, chosen = of_one_task(ledger_io.text_records(spark, f"{stage}/arrived", f"{TASK} int"), ledger_io.STORED_REF, wanted)
            texts = records.join(chosen, [ledger_io.STORED_REF, TASK], "left_semi").drop(TASK).withColumn(ledger_io.IS_TEXT, F.lit(True))
            ledger_io.append_stored(new.unionByName(texts, allowMissingColumns=True), path)
        finally:
            remove_path(spark, stage)
    return write


def admit_arrivals(ts: np.ndarray, hits: deque, limit: int, window: float) -> np.ndarray:
    """Decide requests ``ts`` (sorted) that arrive after the remembered ``hits`` (sorted), which are updated.

    As the gateway does, a request is denied while ``limit`` hits are remembered, and only
    hits a window or more before it are forgotten. One older than the newest hit forgets
    none, and is remembered in its place.
    """
    out = np.zeros(len(ts), dtype=bool)
    late = int(np.searchsorted(ts, hits[-1], side="left")) if hits else 0
    for i in range(late):
        if len(hits) >= limit:
            break
        out[i] = True
        hits.insert(bisect(hits, float(ts[i])), float(ts[i]))
    admit_run(ts, late, len(ts), hits, limit, window, out)
    return out


class _Limiter(StatefulProcessor):
    """A key's remembered hits as a list state; a timer removes those of a key that stays silent."""

    def __init__(self, limit: int, window: float, idle: float):
        self.limit, self.window, self.idle = limit, window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Times and ids of one key in one micro-batch, bounded by the trigger's batch size.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "request"], kind="stable")
        hits = deque(row[0] for row in self.hits.get())
        admitted = admit_arrivals(batch["at"].to_numpy(dtype=np.float64), hits, self.limit, self.window)
        if hits:
            self.hits.put([(t,) for t in hits])
        else:
            self.hits.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield pd.DataFrame({"request": batch["request"].to_numpy(), "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        yield pd.DataFrame({"request": pd.Series([], dtype=object), "admitted": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def rate_limit_stream(requests_stream: DataFrame, key_col: str = "ip_address", ts_col: str = "unix_ts",
                      id_col: str = "id", limit: int = DEFAULT_RATE_LIMIT,
                      window: float = DEFAULT_RATE_WINDOW_S, idle: float | None = None) -> DataFrame:
    """(id, admitted) for every request, in arrival order: by micro-batch, then by time and id.

    Per-key state is at most ``limit`` timestamps. A key that stays silent for ``idle``
    seconds of processing time (ten windows and an hour at least, unless given) loses its
    state; a backlog that is replayed after a longer stop starts those keys afresh.
    """
    spark = requests_stream.sparkSession
    # This operator's state lives in RocksDB; on disk, so it is not bound by the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = requests_stream.select(
        F.coalesce(F.col(key_col).cast("string"), F.lit(NULL_KEY)).alias("client"),
        F.col(ts_col).cast("double").alias("at"), F.col(id_col).cast("string").alias("request"))
    out_schema = T.StructType([T.StructField("request", T.StringType()), T.StructField("admitted", T.BooleanType())])
    idle = max(10 * float(window), 3600.0) if idle is None else float(idle)
    return (keyed.groupBy("client")
            .transformWithStateInPandas(_Limiter(int(limit), float(window), idle), out_schema, "Append", "ProcessingTime")
            .withColumnRenamed("request", id_col))


def retention_batch_writer(spark: SparkSession, snapshot_root: str, max_events: int):
    """foreachBatch function keeping the newest ``max_events`` rows as versioned snapshots.

    Each batch is unioned with the current snapshot (at most ``max_events``
    rows), cut to the newest ``max_events`` and written as a new version; the
    version number is the batch id, so a replayed batch rewrites the same one. The
    newest two versions are kept.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        prev = _latest_snapshot(spark, snapshot_root, batch_id)
        merged = batch if prev is None else prev.unionByName(batch.select(*prev.columns))
        L.prune_max_events(merged, max_events).write.mode("overwrite").parquet(f"{snapshot_root}/v={batch_id:09d}")
        # A replay of this batch starts from the snapshot before it; older ones are done with.
        for v in _versions(spark, snapshot_root, batch_id)[:-1]:
            remove_path(spark, f"{snapshot_root}/v={v:09d}")
    return write


COUNTS = "status string, count long, batch long"


def counters_batch_writer(root: str):
    """foreachBatch function that adds each batch's counts per status to the stored totals.

    A batch's counts are a folder of their own, named by its number, so a replayed batch
    replaces its counts instead of adding to them; pruning the ledger touches none of it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("status").agg(F.count(F.lit(1)).alias("count")).withColumn("batch", F.lit(batch_id).cast("long")) \
            .coalesce(1).write.mode("overwrite").parquet(f"{root}/delta/v={batch_id:09d}")
    return write


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """(status, count) over the newest base and the batches after it; empty before the first batch."""
    base = _versions(spark, f"{root}/base", 1 << 62)[-1:]
    parts = [f"{root}/base/v={v:09d}" for v in base] + [f"{root}/delta/v={v:09d}" for v in _versions(spark, f"{root}/delta", 1 << 62) if not base or v > base[0]]
    if not parts:
        return spark.createDataFrame([], COUNTS).select("status", "count")
    return spark.read.schema(COUNTS).parquet(*parts).groupBy("status").agg(F.sum("count").alias("count"))


def stored_counters(spark: SparkSession, root: str) -> DataFrame:
    """The four totals, one row, as ``counters_total`` gives them for a ledger that was never pruned."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("count"))), F.lit(0)).cast("long")
    return stored_counts(spark, root).agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_processed"), of(R.STATUS_BLOCKED).alias("total_blocked"),
        of(R.STATUS_SANITIZED).alias("total_sanitized"), of(R.STATUS_PASSED).alias("total_passed"))


def compact_counters(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Fold all batches but the newest ``keep`` into a base of their sum, then remove what it holds.

    A batch that may still be replayed, the newest, is never folded. The new base is
    complete before anything is removed, and readers take batches after it only, so a
    compaction that is cut off loses and doubles nothing.
    """
    deltas = _versions(spark, f"{root}/delta", 1 << 62)
    bases = _versions(spark, f"{root}/base", 1 << 62)
    fold = [v for v in deltas[:len(deltas) - keep] if not bases or v > bases[-1]]
    if fold:
        parts = [f"{root}/base/v={v:09d}" for v in bases[-1:]] + [f"{root}/delta/v={v:09d}" for v in fold]
        total = spark.read.schema(COUNTS).parquet(*parts).groupBy("status").agg(F.sum("count").alias("count"))
        total.withColumn("batch", F.lit(fold[-1]).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{root}/base/v={fold[-1]:09d}")
        bases = bases + fold[-1:]
    for v in bases[:-1]:
        remove_path(spark, f"{root}/base/v={v:09d}")
    for v in deltas:
        if bases and v <= bases[-1]:
            remove_path(spark, f"{root}/delta/v={v:09d}")


def _versions(spark: SparkSession, root: str, before: int) -> list[int]:
    """Numbers below ``before`` of the complete version folders under ``root``, ascending."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p)
                  if s.getPath().getName().startswith("v=") and int(s.getPath().getName()[2:]) < before
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _latest_snapshot(spark: SparkSession, root: str, before: int):
    versions = _versions(spark, root, before)
    return spark.read.parquet(f"{root}/v={versions[-1]:09d}") if versions else None


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    return _latest_snapshot(spark, root, 1 << 62)


def run_available_now(stream_df: DataFrame, name: str, mode: str = "append",
                      partition_by: list[str] | None = None, timers: bool = False) -> str:
    """Run a stream over everything available now into a Parquet sink; returns the sink path.

    With processing-time ``timers`` there is always a later time to wait for, so batches
    without rows are left out: the run ends with its input.

    Complete/update results are written per batch with foreachBatch (overwrite),
    so the folder holds the final result when the query stops.
    """
    spark = stream_df.sparkSession
    root = scratch_path(spark, name)
    sink, ckpt = f"{root}/out", f"{root}/_checkpoint"
    spark.conf.set(EMPTY_BATCHES, str(not timers).lower())
    w = stream_df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        if partition_by:
            w = w.partitionBy(*partition_by)
        q = w.outputMode("append").format("parquet").option("path", sink).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(sink)
        q = w.outputMode(mode).foreachBatch(write).start()
    spark.conf.unset(EMPTY_BATCHES)
    q.awaitTermination()
    return sink


def score_stream(requests_stream: DataFrame, text_col: str = "prompt", ts_col: str = "ts", **switches) -> DataFrame:
    """Ledger rows of a request stream: the batch scoring and projection on the arriving texts themselves (no state).

    ``switches`` are those of ``score_prompts`` (enable_injection, enable_pii).
    """
    scored = scoring.score_prompts(requests_stream, text_col, **switches)
    return scoring.event_project(scored, text_col=text_col, ts_col=ts_col)


def score_batch_writer(read_rules: Callable[[], DataFrame], sink: str, text_col: str = "prompt", ts_col: str = "ts", **switches):
    """foreachBatch function that scores each micro-batch with the custom rules as they are then.

    ``read_rules`` reads the rule table anew for each batch. A batch is a folder of its own
    under ``sink``, named by its number, so that a replayed batch replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rules = scoring.load_policy_rules(read_rules())
        scored = scoring.score_prompts(batch, text_col, custom_rules=rules, **switches)
        scoring.event_project(scored, text_col=text_col, ts_col=ts_col).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    return write


def alert_stream(ledger_stream: DataFrame) -> DataFrame:
    """Critical blocked events as they arrive (the feed a webhook sender would read)."""
    return ledger_stream.filter((F.col("status") == F.lit(R.STATUS_BLOCKED))
                                & (F.col("severity") == F.lit("CRITICAL")))
