"""Session, storage and sizing helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be broadcast (two longs each, so 16 MB of data at most). Larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: A key is heavy if it has HEAVY_ROWS rows and more than one of HEAVY_KEYS equal shares of all rows, so that there are never
#: more than HEAVY_KEYS heavy keys; its rows are dealt over SALTS tasks.
HEAVY_ROWS, HEAVY_KEYS, SALTS = 2048, 10_000, 32
#: Records and bytes of an Arrow batch; together with the longest text they bound a worker's memory.
BATCH_RECORDS, BATCH_BYTES = 10_000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and the master is local (tests), a
    new local folder; on a cluster a folder of one machine would not do, so that raises."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="veilframe-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths made within the scratch blocks that are open, the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"
    if _SCRATCH.get():
        _SCRATCH.get()[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose intermediate tables are deleted when it ends. It gives a function that writes a table which stays: a
    result must be written by it (its attribute paths tells where), as nothing that leaves the block may depend on what is
    deleted. Blocks nest: what one keeps belongs to the block around it. A block that fails deletes as well."""
    paths: list[str] = []
    kept: list[str] = []
    outer = _SCRATCH.get()
    token = _SCRATCH.set((*outer, paths))

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        kept.append(path)
        return spark.read.schema(df.schema).parquet(path)

    keep.paths = kept  # type: ignore[attr-defined]
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            if path not in kept:
                remove_path(spark, path)
        if outer:
            outer[-1].extend(kept)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. zstd, for large
    texts, takes more memory outside the heap."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Whole numbers (int) of which a shuffle by hash into n partitions puts one into each."""
    rows = spark.range(0, 30 * n, 1, 1).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    return sorted(r["k"] for r in rows.collect())


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long, so Arrow batches are bounded in bytes too. Bounds that the session already sets at or below
    these stay as they are. Plans take them when they run, after this returns, so they are not set back."""
    for name, most in (("maxRecordsPerBatch", BATCH_RECORDS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """function, after which a worker gives free memory back: workers are used again by later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its free memory
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_per_id(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep) with one row per id. Rows without an id are left out, as no result could name them. If ids
    repeat, the least row (by text, nulls first, then the kept columns) stands for the id; the common case, unique ids,
    costs a count of the id column only."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep).filter("doc_id is not null")
    if not rows.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return rows
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", *keep)).alias("r")).select("doc_id", "r.text", *(f"r.{c}" for c in keep))


def join_on_id(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", bound: int | None = None) -> DataFrame:
    """rows join lookup on key. lookup is broadcast only after its rows were counted and are within the bound (BROADCAST_ROWS);
    beyond it both sides are shuffled and lookup is hashed, so that long rows are not sorted. Rows of by_id stay where they
    are."""
    bound = BROADCAST_ROWS if bound is None else bound
    return rows.join(F.broadcast(lookup) if lookup.limit(bound + 1).count() <= bound else lookup.hint("shuffle_hash"), key, how)


@contextlib.contextmanager
def by_id(docs: DataFrame, bound: int | None = None) -> Iterator[DataFrame]:
    """docs, for several joins with lookups by doc_id. Tables of more rows than the bound (BROADCAST_ROWS), whose lookups may be
    too large to broadcast, are written once into buckets by doc_id, so that their texts are shuffled once and not by each
    join. What leaves the block must not depend on docs."""
    if docs.limit((BROADCAST_ROWS if bound is None else bound) + 1).count() <= (BROADCAST_ROWS if bound is None else bound):
        yield docs
        return
    spark, name, n = docs.sparkSession, f"by_id_{uuid.uuid4().hex}", partitions(docs.sparkSession)
    docs.repartition(n, "doc_id").write.bucketBy(n, "doc_id").option("path", new_path(spark, "by_id")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def heavy_keys(counts: DataFrame, key: str, rows: str) -> DataFrame | None:
    """The heavy keys of counts (key, rows: how many rows it has), as (key); None if there are none. HEAVY_KEYS at most."""
    total, most = counts.agg(F.sum(rows), F.max(rows)).first()
    bound = max(HEAVY_ROWS, (total or 0) // HEAVY_KEYS)
    return counts.filter(F.col(rows) > bound).select(key) if (most or 0) > bound else None


def join_heavy(rows: DataFrame, lookup: DataFrame, key: str, by: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows join lookup on key, both shuffled. The rows of heavy keys (the one column of heavy, at most HEAVY_KEYS, so they are
    broadcast) are dealt over SALTS tasks by the column by, each with a copy of the lookup's row."""
    if heavy is None:
        return rows.join(lookup, key, how)
    marked = F.broadcast(heavy.select(F.col(heavy.columns[0]).alias(key), F.lit(True).alias("_heavy")))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(marked, key, "left").withColumn("_salt", salt).drop("_heavy")
    right = lookup.join(marked, key, "left").withColumn("_salt", every).drop("_heavy")
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
