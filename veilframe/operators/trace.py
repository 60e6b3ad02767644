"""Ordered traces: cut-offs, verdicts and health, as windows per trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import AUTOSTOP_EQUAL, AUTOSTOP_STEPS, REPEAT_LIMIT


def _order(trace: str, order: list[str]) -> Window:
    return Window.partitionBy(trace).orderBy(*order)


def with_runs(df: DataFrame, trace: str, order: list[str], action: str) -> DataFrame:
    """df with step (from 1), run (number of the run of equal actions; null equals null) and place (in its run, from 1)."""
    w = _order(trace, order)
    changed = F.when(F.col(action).eqNullSafe(F.lag(action).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("step", F.row_number().over(w)).withColumn("_c", changed).withColumn("run", F.sum("_c").over(w)).drop("_c")
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(trace, "run").orderBy("step")))


def repeat_cutoff(df: DataFrame, trace: str, order: list[str], action: str, limit: int = REPEAT_LIMIT) -> DataFrame:
    """Steps before the first that is the limit-th equal one in a row."""
    runs = with_runs(df, trace, order, action)
    over = F.max(F.when(F.col("place") >= limit, 1).otherwise(0)).over(Window.partitionBy(trace).orderBy("step"))
    return runs.withColumn("_over", over).filter("_over = 0").drop("_over")


def autostop(df: DataFrame, trace: str, order: list[str], action: str) -> DataFrame:
    """(trace, stop_step): the first step at which a trace has six steps at least and its last five actions are equal."""
    runs = with_runs(df, trace, order, action)
    stop = F.min(F.when((F.col("step") >= AUTOSTOP_STEPS) & (F.col("place") >= AUTOSTOP_EQUAL), F.col("step")))
    return runs.groupBy(trace).agg(stop.alias("stop_step"), F.max("step").alias("steps"))


def health(df: DataFrame, trace: str, order: list[str], action: str, finished: Column) -> DataFrame:
    """(trace, last_action, steps, status): ok if the last action is a finish, else unfinished."""
    last = df.groupBy(trace).agg(F.max_by(action, F.struct(*order)).alias("last_action"), F.max_by(finished, F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("steps"))
    return last.select(trace, "last_action", "steps", F.when(F.col("_f"), "ok").otherwise("unfinished").alias("status"))


def verdict(df: DataFrame, trace: str, order: list[str], page: Column, complete: Column, failed: Column | None = None) -> DataFrame:
    """(trace, complete, judged): the last step whose page gate holds (null holds) decides; none: not complete. Steps whose
    judge failed count nothing."""
    rows = df if failed is None else df.filter(~F.coalesce(failed, F.lit(False)))
    gate = F.coalesce(page, F.lit(True))
    last = rows.groupBy(trace).agg(F.max(F.when(gate, F.struct(*order, complete.alias("_v")))).alias("m"), F.count(F.lit(1)).alias("judged"))
    everyone = df.select(trace).distinct()
    return everyone.join(last, trace, "left").select(trace, F.coalesce("m._v", F.lit(False)).alias("complete"), F.coalesce("judged", F.lit(0)).cast("long").alias("judged"))


def sticky(df: DataFrame, trace: str, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """df with each flag latched: true from the first step on at which it held."""
    w = _order(trace, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.coalesce(F.max(f).over(w), F.lit(False)) for n, f in flags.items()})


def after_first(df: DataFrame, trace: str, order: list[str], seen: Column) -> DataFrame:
    """Steps after the first one at which seen held (two-phase judges)."""
    w = _order(trace, order)
    before = F.max(F.when(seen, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_seen", before).filter("_seen = 1").drop("_seen")


def with_next(df: DataFrame, parent: str, order: list[str], column: str, name: str = "next") -> DataFrame:
    return df.withColumn(name, F.lead(column).over(_order(parent, order)))


def ordered(df: DataFrame, group: str, order: list[str], value: str, descending: bool = False) -> DataFrame:
    """(group, sorted): whether value runs monotone; a single or no value does."""
    before = F.lag(value).over(_order(group, order))
    ok = (F.col(value) <= before) if descending else (F.col(value) >= before)
    return df.withColumn("_ok", F.coalesce(ok, F.lit(True))).groupBy(group).agg(F.min("_ok").alias("sorted"))


def instruction(df: DataFrame, trace: str, order: list[str]) -> DataFrame:
    """(trace, instruction): the first original_instruction, or else the first target."""
    key = F.struct(*order)
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), key))
    return df.groupBy(trace).agg(F.coalesce(pick("original_instruction"), pick("target")).alias("instruction"))


def ui_file(ac_xml: Column, xml: Column) -> Column:
    """The base name of the UI file to judge a step by: the accessibility dump, or else the plain one; null without either."""
    return F.nullif(F.substring_index(F.coalesce(ac_xml, xml), "/", -1), F.lit(""))


def with_ui(steps: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps whose UI file is among files (name), finish steps of question tasks that have none). The first are judged by
    their pages; the others, which would be passed over, by their answers alone. steps: ac_xml, xml, finished, metric_type."""
    named = steps.withColumn("ui_file", ui_file(F.col("ac_xml"), F.col("xml")))
    known = files.select(F.col("name").alias("ui_file")).distinct()
    rescued = named.filter(F.col("finished") & (F.col("metric_type") == "query_detect")).join(known, "ui_file", "left_anti")
    return named.join(known, "ui_file", "left_semi"), rescued


def answer(message: Column, input_: Column) -> Column:
    return F.coalesce(message, input_)


def no_ops(df: DataFrame, trace: str, order: list[str], screen: str) -> DataFrame:
    """(trace, no_ops, steps): screens equal to the next one, the last excluded; two screens or fewer have none. Equality of
    screen hashes stands in for pixel comparison, which is a slot."""
    follow = F.lead(screen).over(_order(trace, order))
    rows = df.withColumn("_same", (F.col(screen) == follow).cast("int"))
    return rows.groupBy(trace).agg(F.when(F.count(F.lit(1)) > 2, F.coalesce(F.sum("_same"), F.lit(0))).otherwise(0).cast("long").alias("no_ops"), F.count(F.lit(1)).alias("steps"))


def partial_accuracy(subgoals: Column, mode: str = "numeric_keys") -> Column:
    """Share of truthy entries of a map string -> string; no sub-goals: 0. numeric_keys counts sub-goals alone, all_keys
    everything but complete and judge_page. Non-empty strings other than false are true."""
    wanted = F.map_filter(subgoals, lambda k, v: k.rlike("^[0-9]+$") if mode == "numeric_keys" else ~k.isin("complete", "judge_page"))
    met = F.map_filter(wanted, lambda k, v: F.coalesce((v != "") & ~F.lower(v).isin("false", "0", "none", "null"), F.lit(False)))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.size(met) / F.size(wanted))


def outcome(success: Column, aborted: Column, out_of_steps: Column) -> Column:
    return F.when(success, "success").when(aborted, "abort").when(out_of_steps, "max_step").otherwise("abort")


def image_order(names: Column) -> Column:
    """Image names in the order of their steps: step pictures by number and time, then end pictures by time, then others."""
    number = lambda x, p: F.try_to_number(F.nullif(F.regexp_extract(x, p, 1), F.lit("")), F.lit("9999999999999999999")).cast("decimal(38,0)")
    huge = F.lit(10).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(38,0)")

    def key(x):
        before, end = F.contains(x, F.lit("before")), F.contains(x, F.lit("end"))
        step = number(x, r"-(\d+)-before|^(?!.*before)$")
        time = number(x, r"-(\d+)(?:-before|-end)?\.[A-Za-z]+$")
        return F.struct(F.when(before, 0).when(end, 1).otherwise(2).alias("kind"), F.coalesce(step, time, huge).alias("at"), x.alias("name"))

    return F.transform(F.array_sort(F.transform(names, key)), lambda k: k["name"])
