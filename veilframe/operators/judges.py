"""Judges as data: rule rows evaluated over node tables, device state and answers.

A rule is (task_id, subgoal, kind, scope, arg). Kinds of pages: has (some key contains arg), absent (none does), always,
sibling (a child of the parent of a node whose key contains scope contains arg), sibling_lacks, sibling_is (the part after
its last ; equals arg), next (the node after one that contains scope contains arg), group (all of arg's comma-separated
names occur). Kinds of steps: state_equals, state_differs, state_contains and state_lacks (output of command scope), answer
(the answer of a finished step passes the rule judge against arg), answer_state (against the output of command scope). The
subgoal 'page' is the gate of a page; a task's subgoals must all hold for complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import bounded
from . import catalogue
from .qa import rule_judge

RULE = "task_id string, subgoal string, kind string, scope string, arg string"


PAGE_KINDS = ("has", "absent", "always", "sibling", "sibling_lacks", "sibling_is", "next", "group")
STATE_KINDS = ("state_equals", "state_differs", "state_contains", "state_lacks", "answer", "answer_state")
#: Rules beyond the catalogue's, as register_judge adds them.
_REGISTERED: list[tuple] = []


def register_judge(rows: list[tuple]) -> None:
    """Add rules (task_id, subgoal, kind, scope, arg); those of a task that the catalogue has replace its own."""
    for r in rows:
        if len(r) != 5 or r[2] not in (*PAGE_KINDS, *STATE_KINDS):
            raise ValueError(f"not a rule: {r}")
    _REGISTERED.extend(rows)


def rules(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Rules as a table: rows, or else the catalogue's and the registered ones."""
    if rows is None:
        own = {r[0] for r in _REGISTERED}
        rows = [r for r in catalogue.rows() if r[0] not in own] + _REGISTERED
    return spark.createDataFrame(rows, RULE)


def bind(tasks: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """tasks (task_id, ...) that have rules; the others cannot be judged and do not enter the metrics."""
    return tasks.join(rule_rows.select("task_id").distinct(), "task_id", "left_semi")


def judge_pages(nodes: DataFrame, rule_rows: DataFrame, trace: str = "trace_id", step: str = "step") -> DataFrame:
    """(trace, step, task_id, page, subgoals map, complete) from nodes (trace, task_id, step, parent_id, ord, key). A page's nodes are shuffled
    once, into families of keys; the rules of its task, one row a task, are tested on these. A step whose task has no rule is not
    judged."""
    wanted = rule_rows.filter(F.col("kind").isin(*PAGE_KINDS)).groupBy("task_id").agg(F.collect_list(F.struct("subgoal", "kind", "scope", "arg")).alias("_rules"))
    page = [trace, step, "task_id"]
    rows = nodes.select(*page, "parent_id", F.struct("ord", "key").alias("_n")).repartition(*page)  # also what the second aggregate needs
    families = rows.groupBy(*page, "parent_id").agg(F.transform(F.array_sort(F.collect_list("_n")), lambda n: n["key"]).alias("_keys")).groupBy(*page).agg(F.collect_list("_keys").alias("_families"))
    some = lambda test: F.exists("_families", test)
    has = lambda keys, text: F.exists(keys, lambda k: F.contains(k, text))

    def met(r):
        beside = lambda test: some(lambda keys: has(keys, r["scope"]) & test(keys))
        pairs = lambda keys: F.zip_with(F.slice(keys, F.lit(1), F.size(keys) - 1), F.slice(keys, F.lit(2), F.size(keys) - 1), lambda a, b: F.contains(a, r["scope"]) & F.contains(b, r["arg"]))
        kind, with_arg = r["kind"], lambda keys: has(keys, r["arg"])
        out = (
            F.when(kind == "has", some(with_arg)).when(kind == "absent", ~some(with_arg)).when(kind == "sibling", beside(with_arg)).when(kind == "sibling_lacks", ~beside(with_arg))
            .when(kind == "sibling_is", beside(lambda keys: F.exists(keys, lambda k: F.substring_index(k, ";", -1) == r["arg"]))).when(kind == "next", some(lambda keys: F.exists(pairs(keys), lambda x: x)))
            .when(kind == "group", F.forall(F.split(r["arg"], ","), lambda name: some(lambda keys: has(keys, F.trim(name))))).otherwise(True)
        )
        return F.struct(r["subgoal"].alias("subgoal"), F.coalesce(out, F.lit(False)).alias("met"))

    judged = families.join(bounded(wanted), "task_id").withColumn("_met", F.transform("_rules", met))
    holds = lambda goal: F.forall(F.filter("_met", lambda m: m["subgoal"] == goal), lambda m: m["met"])
    goals = F.filter(F.array_distinct(F.transform("_met", lambda m: m["subgoal"])), lambda g: g != "page")
    subgoals = F.map_from_entries(F.transform(goals, lambda g: F.struct(g, holds(g))))
    complete = (F.size("subgoals") > 0) & F.forall(F.map_values("subgoals"), lambda v: v)
    return judged.select(*page, holds(F.lit("page")).alias("page"), subgoals.alias("subgoals")).withColumn("complete", complete)


def judge_state(steps: DataFrame, rule_rows: DataFrame, trace: str = "trace_id", step: str = "step") -> DataFrame:
    """The same from steps (trace, task_id, step, command map, answer, finished): device state and answers. A step without the
    command's output does not pass its gate."""
    rows = steps.join(bounded(rule_rows.filter(F.col("kind").isin(*STATE_KINDS))), "task_id")
    output = F.try_element_at("command", F.col("scope"))
    kind, arg = F.col("kind"), F.col("arg")
    met = (
        F.when(kind == "state_equals", F.trim(output) == arg).when(kind == "state_differs", F.trim(output) != arg)
        .when(kind == "state_contains", F.contains(output, arg)).when(kind == "state_lacks", ~F.contains(output, arg))
        .when(F.col("finished"), rule_judge(F.col("answer"), F.when(kind == "answer", arg).otherwise(F.coalesce(output, F.lit(""))))).otherwise(False)
    )
    ready = F.when(kind == "answer", F.col("finished")).when(kind == "answer_state", F.col("finished") & output.isNotNull()).otherwise(output.isNotNull())
    judged = rows.withColumn("met", F.coalesce(met, F.lit(False))).withColumn("_ready", ready)
    gates = judged.groupBy(trace, step, "task_id").agg(F.min("_ready").alias("_ready"))
    out = _settle(judged.select(trace, step, "task_id", "subgoal", "kind", "scope", "arg", "met"), trace, step)
    return out.join(gates, [trace, step, "task_id"]).withColumn("page", F.col("page") & F.coalesce("_ready", F.lit(False))).drop("_ready")


def _settle(met: DataFrame, trace: str, step: str) -> DataFrame:
    goals = met.groupBy(trace, step, "task_id", "subgoal").agg(F.min("met").alias("met"))
    out = goals.groupBy(trace, step, "task_id").agg(
        F.coalesce(F.min(F.when(F.col("subgoal") == "page", F.col("met"))), F.lit(True)).alias("page"),
        F.map_from_entries(F.collect_list(F.when(F.col("subgoal") != "page", F.struct("subgoal", "met")))).alias("subgoals"),
        F.coalesce(F.min(F.when(F.col("subgoal") != "page", F.col("met"))), F.lit(False)).alias("complete"),
    )
    return out
