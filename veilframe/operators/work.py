"""Bookkeeping of runs: what is left to do, retries, merges of incomplete tasks."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def task_id_of(name: Column) -> Column:
    """The first two parts of a run's name; null with fewer."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 2, F.concat_ws("_", parts[0], parts[1]))


def latest_run(df: DataFrame, task: str, name: str) -> DataFrame:
    """One run per task: the last by name."""
    return df.groupBy(task).agg(F.max(name).alias(name))


def incomplete(previous: DataFrame, outcomes: DataFrame, task: str, status: str) -> DataFrame:
    """Earlier incomplete tasks that did not run now, and those that ended in max_step or abort."""
    return previous.join(outcomes.select(task).distinct(), task, "left_anti").unionByName(outcomes.filter(F.col(status).isin("max_step", "abort")), allowMissingColumns=True)


def to_run(tasks: DataFrame, done: DataFrame, aborted: DataFrame, task: str) -> DataFrame:
    """Tasks that have no run, or whose run was aborted."""
    fresh = tasks.join(done.select(task).distinct(), task, "left_anti")
    again = tasks.join(aborted.select(task).distinct(), task, "left_semi")
    return fresh.union(again).distinct()


def last_attempt(df: DataFrame, task: str, attempt: str, status: str, most: int = 3) -> DataFrame:
    """The attempt that counts: the first that is not aborted, or else the last of at most so many."""
    rows = df.filter(F.col(attempt) <= most)
    w = Window.partitionBy(task).orderBy((F.col(status) == "abort").cast("int"), F.when(F.col(status) == "abort", -F.col(attempt)).otherwise(F.col(attempt)))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def name_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def missing_names(wanted: DataFrame, present: DataFrame, name: str) -> DataFrame:
    return wanted.join(present.select(name).distinct(), name, "left_anti")


def even_chunks(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """df with chunk 1..n per group, in the order of order: sizes differ by one at most, the larger first. Groups may be of
    any size."""
    from .ranks import ranked

    size, more = F.floor(F.col("_size") / n), F.col("_size") % n
    large = more * (size + 1)  # rows in the larger chunks
    chunk = F.when(F.col("_rank") < large, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - large) / F.greatest(size, F.lit(1))))
    return ranked(df, group, order).withColumn("chunk", (chunk + 1).cast("int")).drop("_rank", "_size")


def metric_type(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows of a metric type; both keeps every row. A misspelt type equals nothing."""
    return df if wanted == "both" else df.filter(F.col(column) == wanted)


def final_verdict(metric: Column, rule: Column, vision: Column, model: Column) -> Column:
    """struct(complete, source): the vision verdict of an operation, the model's of a query, each if there is one; the
    rule's verdict stands otherwise."""
    other = F.when(metric == "operation", vision).when(metric == "query_detect", model)
    source = F.when(other.isNull(), F.lit("rule_fallback")).when(metric == "operation", "vision").otherwise("model")
    return F.struct(F.coalesce(other, rule, F.lit(False)).alias("complete"), source.alias("source"))


def parse_verdict(reply: Column) -> Column:
    """struct(status, confidence) of a judge's JSON, fenced or embedded: failure and medium where it says nothing known."""
    from ..functions.text import salvage_json

    row = F.from_json(salvage_json(reply), "status string, confidence string")
    pick = lambda c, known, default: F.when(F.lower(row[c]).isin(*known), F.lower(row[c])).otherwise(default)
    return F.struct(pick("status", ("success", "failure"), "failure").alias("status"), pick("confidence", ("high", "medium", "low"), "medium").alias("confidence"))


def parse_correct(reply: Column) -> Column:
    """A model's answer verdict: JSON's boolean, else the words correct or incorrect, else false."""
    from ..functions.text import salvage_json

    said = F.from_json(salvage_json(reply), "correct boolean")["correct"]
    return F.coalesce(said, F.when(F.lower(reply).contains("incorrect"), False).when(F.lower(reply).contains("correct"), True), F.lit(False))


def parse_action(reply: Column) -> Column:
    """struct(operation, action, message) of the last line of a reply's code, read by a grammar and never run."""
    from ..functions.text import strip_leading_zeros, unfence

    said = F.regexp_extract(reply, r"(?m)^Action: (.*)$", 1)
    lines = F.filter(F.split(F.when(said != "", said).otherwise(unfence(reply)), "\n"), lambda x: F.trim(x) != "")
    code = strip_leading_zeros(F.trim(F.try_element_at(lines, F.lit(-1))))
    operation = F.regexp_extract(code, r"^(do|finish)\(", 1)
    action = F.regexp_extract(code, r"""action\s*=\s*["']([^"']*)["']""", 1)
    message = F.regexp_extract(code, r"""(?:message|text|input)\s*=\s*["']([^"']*)["']""", 1)
    box = F.transform(F.regexp_extract_all(F.regexp_extract(code, r"element\s*=\s*\[([^\]]*)\]", 1), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    name = F.when(operation == "finish", "finish").otherwise(F.nullif(action, F.lit("")))
    return F.struct(F.when(operation == "", "error").otherwise(operation).alias("operation"), name.alias("action"), F.nullif(message, F.lit("")).alias("message"), F.when(F.size(box) == 4, box).alias("box"))


def absolute_box(box: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the screen in pixels, and its centre."""
    x = lambda i: (F.get(box, i) * width / 1000).cast("int")
    y = lambda i: (F.get(box, i) * height / 1000).cast("int")
    return F.struct(x(0).alias("x1"), y(1).alias("y1"), x(2).alias("x2"), y(3).alias("y2"), ((x(0) + x(2)) / 2).cast("int").alias("cx"), ((y(1) + y(3)) / 2).cast("int").alias("cy"))


def gate(enabled: Column, method: Column, text: Column, mapping: Column, reply: Column) -> Column:
    """struct(approved, reason, result, missing_tokens): a local computation on real values. Rejected if switched off, if the
    method has no tokens, without a mapping, with tokens that it lacks, or if the reply is not JSON."""
    from .mask import unmask, unresolved_tokens

    missing = F.array_except(unresolved_tokens(text), F.coalesce(F.map_keys(mapping), F.expr("cast(array() as array<string>)")))
    from ..functions.text import salvage_json

    row = F.from_json(salvage_json(reply), "approved boolean, reason string, result string")
    reason = (
        F.when(~enabled, "disabled").when(~F.coalesce(method, F.lit("")).isin("", "token_anonymization"), "unsupported").when(mapping.isNull(), "no mapping")
        .when(F.size(missing) > 0, "missing tokens").when(row.isNull() | row["approved"].isNull(), "unreadable reply").otherwise(row["reason"])
    )
    bad = ~enabled | ~F.coalesce(method, F.lit("")).isin("", "token_anonymization") | mapping.isNull() | (F.size(missing) > 0)
    approved = ~bad & F.coalesce(row["approved"], F.lit(False))
    return F.struct(approved.alias("approved"), reason.alias("reason"), F.when(approved, row["result"]).alias("result"), missing.alias("missing_tokens"), unmask(text, mapping).alias("resolved"))


def with_notice(prompt: Column, notice: str, anchor: str) -> Column:
    """A notice before the first anchor, or at the end; once only."""
    at = F.locate(anchor, prompt)
    placed = F.when(at > 0, F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit(notice), F.substring(prompt, at, F.length(prompt)))).otherwise(F.concat(prompt, F.lit(notice)))
    return F.when(F.contains(prompt, F.lit(notice)), prompt).otherwise(placed)


def without_notice(prompt: Column, patterns: list[str]) -> Column:
    for p in patterns:
        prompt = F.regexp_replace(prompt, f"(?s){p}", "")
    return prompt


GATE_CALL = "cloud_agent_compute_with_tokens"  # a fixed value
GATE_ARGUMENTS = ("anon_tokens", "compute_instruction", "usage_reason")  # fixed values


def read_gate_call(code: str | None) -> tuple[list[str], str, str, str | None]:
    """(tokens, instruction, reason, error) of one call with literal keyword arguments; other arguments are ignored and
    nothing is ever run."""
    try:
        call = ast.parse((code or "").strip(), mode="eval").body
        name = getattr(call.func, "id", None) or getattr(call.func, "attr", None) if isinstance(call, ast.Call) else None
        if name != GATE_CALL:
            raise ValueError(f"not a call of {GATE_CALL}")
        given = {k.arg: ast.literal_eval(k.value) for k in call.keywords if k.arg in GATE_ARGUMENTS}
        tokens, instruction, reason = given.get("anon_tokens") or [], given.get("compute_instruction") or "", given.get("usage_reason") or ""
        if not isinstance(tokens, list) or not all(isinstance(x, str) for x in tokens) or not isinstance(instruction, str) or not isinstance(reason, str):
            raise ValueError("arguments of other kinds")
        return tokens, instruction, reason, None
    except (SyntaxError, ValueError) as x:
        return [], "", "", str(x)


def _gate_calls(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_gate_call(c) for c in codes], columns=["tokens", "instruction", "reason", "error"])


_gate_calls.__annotations__ = {"codes": pd.Series, "return": pd.DataFrame}
parse_gate_call = F.pandas_udf(
    _gate_calls,
    T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("instruction", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())]),
)
