"""Streams: running aggregates, repeated-action stops and the registry, all with checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import AUTOSTOP_EQUAL, AUTOSTOP_STEPS
from ..operators.registry import Registry
from ..plans.storage import shared_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now; the last batch's rows (complete), or all rows that it ever put out (append)."""
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder, so that a restart leaves no row twice
        batch.write.mode("overwrite").parquet(f"{path}/data" if mode == "complete" else f"{path}/data/stream_batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data").select(*stream.columns)


def event_progress(events: DataFrame) -> DataFrame:
    """Counts and sums by event type, as they grow."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.max("value").alias("highest"))


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts per window of event time, tumbling or, with slide, overlapping; rows later than the watermark are dropped, and a
    window is put out once it is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every, slide or every), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, who: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(window, who, events) per session: events of one key with less than gap between neighbours; put out once closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), who).agg(F.count(F.lit(1)).alias("events")).withColumnRenamed("session_window", "window")


def autostop_stream(events: DataFrame, trace: str, order: str, action: str) -> DataFrame:
    """(trace, stop_step) once for each trace whose last actions are equal; the state is three numbers and an action. Steps
    are taken in the order of arrival between batches and by order within one."""
    kinds = dict(events.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place, steps, done = state.get if state.exists else (None, 0, 0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            a = getattr(r, action)
            steps, place, last = steps + 1, place + 1 if a == last else 1, a
            if not done and steps >= AUTOSTOP_STEPS and place >= AUTOSTOP_EQUAL:
                done = True
                out.append((key[0], steps))
        state.update((last, place, steps, done))
        yield pd.DataFrame(out, columns=[trace, "stop_step"])

    return events.select(trace, order, action).groupBy(trace).applyInPandasWithState(
        run, f"{trace} {kinds[trace]}, stop_step long", f"last {kinds[action]}, place long, steps long, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def registry_stream(steps: DataFrame, task: str, step: str, text: str) -> DataFrame:
    """(task, step, masked, masked_chars): the step-by-step registry as state per task: values, tokens, labels, whitelist."""
    kinds = dict(steps.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        registry = Registry()
        if state.exists:
            values, tokens, labels, words = state.get
            registry.token_of, registry.label_of, registry.whitelist = dict(zip(values, tokens)), dict(zip(values, labels)), set(words)
        out = []
        for r in pd.concat(list(batches)).sort_values(step).itertuples(index=False):
            masked, _, chars = registry.mask(getattr(r, text) or "")
            out.append((key[0], getattr(r, step), masked, chars))
        values = list(registry.token_of)
        state.update((values, [registry.token_of[v] for v in values], [registry.label_of[v] for v in values], sorted(registry.whitelist)))
        yield pd.DataFrame(out, columns=[task, step, "masked", "masked_chars"])

    return steps.select(task, step, text).groupBy(task).applyInPandasWithState(
        run, f"{task} {kinds[task]}, {step} {kinds[step]}, masked string, masked_chars long",
        "values array<string>, tokens array<string>, labels array<string>, words array<string>", "append", GroupStateTimeout.NoTimeout,
    )


def on_each(stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str):
    """Start a stream that hands each micro-batch to sink."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: sink(df)).start()
