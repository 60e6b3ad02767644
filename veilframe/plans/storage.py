"""Where plans keep what they write: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast; rows and bytes of an Arrow batch of long texts.
BROADCAST_ROWS = 100_000
BATCH_RECORDS, BATCH_BYTES = 2_000, 2 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset and the master is local, a temporary folder; a cluster's
    machines do not share one, so there that raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='veilframe-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded(df: DataFrame) -> DataFrame:
    """df to be broadcast if it was counted and has BROADCAST_ROWS at most; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared path and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_RECORDS and BATCH_BYTES, as long texts come in them; lower bounds stay. Plans
    take them when they run, after this returns, so they are not set back."""
    for name, most in (("maxRecordsPerBatch", BATCH_RECORDS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
