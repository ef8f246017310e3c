"""Streaming forms of three batch jobs: last drilling event, powder-factor trend, hole validation."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.columns import GeometryConfig
from ..operators.drilling import last_event_per_hole
from ..operators.holes import process_holes
from ..sources.store import KeyedStore

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastEvent(StatefulProcessor):
    """State of a hole: when its last event ended, and that event's number. Events that are later come out, others do not."""

    def __init__(self, columns: list[str], kind: str, keep_ms: int | None):
        self.columns, self.kind, self.keep_ms = columns, kind, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"tiempo_final {self.kind}, event_id long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        best, found = (known[0], -known[1]) if known else None, None
        for pdf in rows:
            row = pdf.sort_values(["tiempo_final", "event_id"], ascending=[False, True]).iloc[[0]]
            order = (row["tiempo_final"].iloc[0].to_pydatetime().replace(tzinfo=None), -int(row["event_id"].iloc[0]))
            if best is None or order > (best[0].replace(tzinfo=None), best[1]):
                best, found = order, row
        if found is not None:
            self.last.update((best[0], -best[1]))
            yield found[self.columns]

    def close(self) -> None:
        pass


def last_event_changes(events: DataFrame, keep_days: float | None = None) -> DataFrame:
    """Stream of the events that are, on arrival, their hole's last one; to be written in update mode.

    A re-drill may arrive at any time, so rows are not held against a watermark. The state is one short row per hole; with
    ``keep_days`` it is given up that long after the hole's last change. A hole whose state is gone gives a change for
    whatever comes next, which ``current_last_events`` puts in its place.
    """
    kind = dict(events.dtypes)["tiempo_final"]
    processor = LastEvent(events.columns, kind, None if keep_days is None else int(keep_days * 86_400_000))
    usable = events.where("pozo IS NOT NULL AND tiempo_final IS NOT NULL")
    return usable.groupBy("pozo").transformWithStateInPandas(processor, events.schema, "Update", "None" if keep_days is None else "ProcessingTime")


def upsert_last_events(events: DataFrame, table: str, checkpoint: str, keep_days: float | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the changes of the last event per hole under ``table``, one folder per batch.

    A batch writes only the holes it changes. Its folder is overwritten when it is replayed, and the state of the replay is
    that of the first run, so the changes are the same. ``current_last_events`` reads the table they add up to.
    """
    conf = events.sparkSession.conf
    # state that expires would keep batches without data going for ever; it goes with the next batch that has some
    needed = {STATE_STORE: ROCKS} | ({} if keep_days is None else {NO_DATA_BATCHES: "false"})
    before = {k: conf.get(k) for k in needed}

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    writer = last_event_changes(events, keep_days).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    try:
        for k, v in needed.items():
            conf.set(k, v)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def current_last_events(spark: SparkSession, table: str) -> DataFrame:
    """The last event of every hole from the changes kept so far."""
    return last_event_per_hole(spark.read.parquet(table).drop("batch"))


def compact_last_events(spark: SparkSession, table: str, into: str) -> int:
    """Puts the current last events into a keyed store, for readers that want one row per hole; returns its version."""
    return KeyedStore(spark, into, ["pozo"]).replace(current_last_events(spark, table))


def last_events_changelog(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Running last event per hole as an update stream, for sinks that take updates."""
    rest = [c for c in events.columns if c != "pozo"]
    return events.withWatermark("tiempo_final", late).groupBy("pozo").agg(
        F.max_by(F.struct(*rest), F.struct("tiempo_final", -F.col("event_id"))).alias("last")).select("pozo", "last.*")


def powder_factor_trend(holes: DataFrame, time: str = "blast_time", window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Powder factor per time window; a window is emitted once, after the watermark has passed its end."""
    return holes.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.avg("pf_vol_kgm3").alias("pf_promedio"), F.count(F.lit(1)).alias("n_pozos")).select(
        F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "pf_promedio", "n_pozos")


def whole_trend(holes: DataFrame, emitted: DataFrame, time: str = "blast_time", window: str = "30 days") -> DataFrame:
    """Windows a finished append stream has emitted, and from all its rows (a batch) those its watermark never passed."""
    done = emitted.agg(F.max("period_end").alias("_done"))  # windows end in order, so the open ones begin here or later
    later = holes.join(F.broadcast(done)).where(F.col("_done").isNull() | (F.col(time) >= F.col("_done"))).drop("_done")
    return emitted.unionByName(powder_factor_trend(later, time, window))


def validate_stream(raw: DataFrame, config: GeometryConfig, accepted_path: str, rejected_path: str, checkpoint: str, bench_height: float | None = None,
                    row_key: str | None = None, trigger: dict | None = None, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Split a stream of hole rows into accepted holes and rejection records, one folder per batch.

    A folder is overwritten when its batch is replayed, so each row lands exactly once.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        report = process_holes(batch, config, bench_height=bench_height, row_key=row_key)
        report.accepted.write.mode("overwrite").parquet(f"{accepted_path}/batch={epoch}")
        report.rejections.write.mode("overwrite").parquet(f"{rejected_path}/batch={epoch}")
        if on_batch:
            on_batch(epoch)

    return raw.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
