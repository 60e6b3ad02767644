"""Readers and writers for task definitions, traces, mappings, statistics and question sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = (
    "trace_id string, index int, prompt string, image string, xml string, ac_xml string, current_activity string, window array<int>, target string, original_instruction string, "
    "anonymized_instruction string, privacy_method string, command map<string,string>, labeled_image string, parsed_action struct<operation:string,action:string,kwargs:map<string,string>>, "
    "current_response string, trace_error string"
)
MAPPING = "task_dir string, token_to_real map<string,string>, real_to_token map<string,string>, real_to_entity_type map<string,string>"
STATS = "task_dir string, total_records int, records array<struct<type:string,original_length:int,anonymized_chars_count:int,anonymized_length:int,num_tokens:int,timestamp:double>>"
QA = "question:string,answers:map<string,array<string>>,answer:string"
TASKS = "app string, package string, task_id string, category string, task string, metric_type string, metric_func string, adb_query string"
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tiff", "tif")  # fixed values
EVENT = "ts timestamp, event string, thread string, payload map<string,string>"


def read_traces(spark: SparkSession, path: str, glob: str = "*.jsonl", by_run: bool = False) -> DataFrame:
    """Trace steps of all runs below path; run and task_id come from the folder that holds each trace, or with by_run from the
    folders that write_traces makes, so that a filter on run opens only its files. Bad lines are kept in _corrupt_record."""
    reader = spark.read.option("mode", "PERMISSIVE").option("pathGlobFilter", glob)
    if by_run:
        rows = reader.schema(f"{TRACE}, _corrupt_record string, run string").json(path)
    else:
        rows = reader.schema(f"{TRACE}, _corrupt_record string").option("recursiveFileLookup", "true").json(path)
        rows = rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"/([^/]+)/traces/[^/]+$", 1))
    from ..operators.work import task_id_of

    return rows.withColumn("task_id", task_id_of(F.col("run"))).withColumn("parsed_action_json", F.to_json("parsed_action"))


def write_traces(steps: DataFrame, path: str) -> None:
    """Append steps (run, and columns of TRACE) as JSON lines in a folder for each run. A run's steps may be many, so ranges of
    run and trace are dealt, not runs; a null run has a folder of its own."""
    steps.repartitionByRange("run", "trace_id").write.mode("append").partitionBy("run").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task definitions from YAML (a parser must be installed) or JSON files: one row per task. Other files are ignored."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), "value")
    files = files.filter(F.col("file").rlike(r"\.(ya?ml|json)$"))

    def parse(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["value"]):
                if file.endswith("json"):
                    d = json.loads(text)
                else:
                    import yaml

                    d = yaml.safe_load(text)
                for t in (d or {}).get("tasks", []):
                    rows.append([d.get("APP"), d.get("package"), *(None if t.get(k) is None else str(t.get(k)) for k in ("task_id", "category", "task", "metric_type", "metric_func", "adb_query"))])
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in TASKS.split(", ")])

    return files.mapInPandas(parse, TASKS)


def read_mappings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Token mappings, one a file, or with lines one a line; entries whose value is no string are dropped."""
    rows = spark.read.schema(MAPPING).option("multiLine", not lines).option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("token_to_real", F.map_filter("token_to_real", lambda k, v: v.isNotNull()))


def usable_mapping(method: Column, mapping: Column) -> Column:
    """The mapping where the method has tokens (or is not known), else null."""
    return F.when(F.coalesce(method, F.lit("")).isin("", "token_anonymization"), mapping)


def privacy_method(traces: DataFrame, trace: str = "trace_id", order: str = "index") -> DataFrame:
    """(trace, method): what the first step says, null if that is empty."""
    return traces.groupBy(trace).agg(F.nullif(F.min_by(F.coalesce("privacy_method", F.lit("")), order), F.lit("")).alias("method"))


def read_stats(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per record of every statistics file (with lines: of every line); a legacy length stands in for a missing count."""
    rows = spark.read.schema(f"{STATS}, _corrupt_record string").option("multiLine", not lines).option("recursiveFileLookup", "true").json(path).filter("_corrupt_record is null")
    flat = rows.select("task_dir", "total_records", F.explode("records").alias("r")).select("task_dir", "total_records", "r.*")
    return flat.withColumn("masked_chars", F.coalesce("anonymized_chars_count", "anonymized_length", F.lit(0)))


def read_questions(spark: SparkSession, path: str, lines: bool = False, by_app: bool = False) -> DataFrame:
    """(app, image, question, answers, answer) of one kind's question files, one per app folder (with lines: a line an image; with
    by_app: the folders that write_json makes by app)."""
    reader, schema = spark.read.option("multiLine", not lines), f"image string, qa array<struct<{QA}>>"
    if by_app:
        rows = reader.schema(f"{schema}, app string").json(path)
    else:
        rows = reader.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("app", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))
    return rows.select("app", "image", F.explode_outer("qa").alias("q")).select("app", "image", "q.*")


def walk(spark: SparkSession, path: str) -> DataFrame:
    """(path, relative, length, is_image) of every file below path; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.split("://")[-1].rstrip("/") + "/"
    return rows.withColumn("relative", F.substring_index("path", root, -1)).withColumn("is_image", is_image(F.col("path")))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGES)


def pick_image(df: DataFrame, stem: str, files: DataFrame) -> DataFrame:
    """df with image_path: the file of that stem by the first extension that exists."""
    known = files.select(F.regexp_extract("relative", r"^(.*)\.[^.]+$", 1).alias(stem), F.lower(F.regexp_extract("relative", r"\.([^.]+)$", 1)).alias("_e"), F.col("path").alias("_p"))
    best = known.filter(F.col("_e").isin("png", "jpg", "jpeg")).groupBy(stem).agg(F.min_by("_p", F.array_position(F.array(*map(F.lit, ("png", "jpg", "jpeg"))), F.col("_e"))).alias("image_path"))
    return df.join(best, stem, "left")


def runs_without_trace(runs: DataFrame, traces: DataFrame, key: str = "run") -> DataFrame:
    """Runs to be reported as blank; nothing is ever deleted."""
    return runs.join(traces.select(key).distinct(), key, "left_anti")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and host that Spark reads it by: without one it belongs to the default file system, which on a cluster
    is not a machine's own disk. Local paths come without a scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def mirror(files: DataFrame, target: str, transform, keep_failed: bool = True) -> DataFrame:
    """(relative, status, error): files (path, relative, is_image, content, as spark.read.format("binaryFile") and walk give)
    written below target from where they are read. Images become transform(bytes); other files are copied. Where transform
    fails the original is copied, as the reference's tool does, or with keep_failed off nothing is; status tells: masked,
    copied, copied_after_error, failed. Lazy: run it once, and only once, by writing or counting the result."""
    store = qualified(files.sparkSession, target)

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(store) if "://" in store else (fs.LocalFileSystem(), store)
        for b in batches:
            out = []
            for name, image, raw in zip(b["relative"], b["is_image"], b["content"]):
                status, error, body = "copied", None, bytes(raw)
                if image:
                    try:
                        status, body = "masked", transform(body)
                    except Exception as x:  # a picture that cannot be masked is reported, not fatal
                        status, error = ("copied_after_error" if keep_failed else "failed"), str(x)
                if status != "failed":
                    path = f"{root}/{name}"
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(path, compression=None) as s:
                        s.write(body)
                out.append((name, status, error))
            yield pd.DataFrame(out, columns=["relative", "status", "error"])

    return files.select("relative", "is_image", "content").mapInPandas(run, "relative string, status string, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """walk with the files' content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    root = path.split("://")[-1].rstrip("/") + "/"
    return rows.withColumn("relative", F.substring_index("path", root, -1)).withColumn("is_image", is_image(F.col("path")))


def write_mappings(registry: DataFrame, path: str) -> None:
    """A JSON line for each (token, value, label) in a folder for each task, as read_mapping_lines reads them. registry: (task,
    value, label, token). However large a task's registry, no row and no task holds it all."""
    rows = registry.select(F.col("task").cast("string").alias("task_dir"), "token", "value", "label").distinct()
    rows.repartitionByRange("task_dir", "token").write.mode("errorifexists").partitionBy("task_dir").json(path)


def read_mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """(task_dir, token, value, label) as write_mappings wrote them; a filter on task_dir opens only its files."""
    return spark.read.schema("token string, value string, label string, task_dir string").json(path).select("task_dir", "token", "value", "label")


def write_stats(records: DataFrame, path: str) -> None:
    """Append a JSON line for each record, and one with their number, in a folder for each task, as read_stat_lines reads them.
    records: (task_dir, type, original_length, anonymized_chars_count, num_tokens, timestamp)."""
    rows = records.select("task_dir", "type", "original_length", "anonymized_chars_count", "num_tokens", "timestamp")
    totals = rows.groupBy("task_dir").agg(F.count(F.lit(1)).alias("total_records"))
    every = rows.unionByName(totals, allowMissingColumns=True)
    every.repartitionByRange("task_dir", "timestamp").write.mode("append").partitionBy("task_dir").json(path)


def read_stat_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that write_stats wrote, with total_records of its task, as read_stats gives them."""
    from ..plans.storage import bounded

    schema = "type string, original_length int, anonymized_chars_count int, anonymized_length int, num_tokens int, timestamp double, total_records long, task_dir string"
    rows = spark.read.schema(schema).json(path)
    totals = rows.filter("total_records is not null").groupBy(F.col("task_dir").alias("_task")).agg(F.sum("total_records").cast("int").alias("total_records"))
    flat = rows.filter("total_records is null").drop("total_records").join(bounded(totals), F.col("task_dir").eqNullSafe(F.col("_task"))).drop("_task")
    return flat.withColumn("masked_chars", F.coalesce("anonymized_chars_count", "anonymized_length", F.lit(0)))


def write_json(df: DataFrame, path: str, append: bool = False, by: str | None = None) -> None:
    """df as JSON lines, with by in a folder for each value of that column (null and empty share one)."""
    rows = df.write.mode("append" if append else "errorifexists")
    (rows.partitionBy(by) if by else rows).json(path)


def manual_review(df: DataFrame, flag: str = "needs_manual_review") -> tuple[DataFrame, DataFrame]:
    """Rows to be reviewed, and their number."""
    rows = df.filter(F.coalesce(F.col(flag), F.lit(False)))
    return rows, rows.agg(F.count(F.lit(1)).alias("manual_review"))


def write_events(events: DataFrame, path: str) -> None:
    """Append events (ts, event, thread, payload), as read_events reads them; each writer adds files of its own."""
    events.select("ts", "event", "thread", "payload").write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)
