"""Judges as rules: trees of tests on a step's screen, device state and answer, with what held before, in one plan.

A rule's tests (leaves) are rows of data; each task's leaves are numbered, and its conditions are lists of conjunctions of their
numbers. A step finds its task's rule by a broadcast join, works out the leaves over its page's nodes in one array expression,
and one window over a trace's steps carries what must have held before. No test is code of its own, so rules can be added.

Conditions are written with has(text) and the other leaf functions, and with all_of, any_of, not_, ever (held at this or an
earlier step) and before (held at an earlier step; not inside another of the two).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import screens as S
from .qa import rule_judge

RULE = (
    "task_id string, leaves array<struct<kind:string,scope:string,arg:string,asked:map<string,string>>>, "
    "latches array<struct<inclusive:boolean,when:array<array<int>>>>, goals array<struct<name:string,when:array<array<int>>,said:int>>"
)

Expr = tuple


def leaf(kind: str, arg: str = "", scope: str = "", **asked: str) -> Expr:
    if kind not in KINDS:
        raise ValueError(f"no test of this kind: {kind}")
    return ("leaf", kind, scope, arg, tuple(sorted(asked.items())))


def has(text: str) -> Expr:
    """Some node with a parent contains text."""
    return leaf("has", text)


def beside(scope: str, text: str) -> Expr:
    """Among the children of a parent of scope, one contains text."""
    return leaf("beside", text, scope)


def all_of(*of: Expr) -> Expr:
    return ("all", *of)


def any_of(*of: Expr) -> Expr:
    return ("any", *of)


def not_(x: Expr) -> Expr:
    return ("not", x)


def ever(x: Expr) -> Expr:
    return ("ever", x)


def before(x: Expr) -> Expr:
    return ("before", x)


def said(x: Expr) -> Expr:
    """A goal that is a text, the one that this leaf finds, and not a truth value."""
    return ("said", x)


def rule(page: Expr, *goals: Expr, complete: Expr | None = None, open_ended: bool = False) -> dict:
    """A task's rule: its gate, its numbered sub-goals, and what completes it (all sub-goals, if not given; with open_ended
    nothing does)."""
    return {"page": page, "goals": goals, "complete": None if open_ended else complete or all_of(*(g for g in goals if g[0] != "said"))}


# --- compiling conditions to numbered leaves


class _Task:
    """The numbers of one task's leaves and latches."""

    def __init__(self):
        self.leaves: dict[Expr, int] = {}
        self.latches: dict[Expr, int] = {}

    def terms(self, x: Expr, positive: bool = True, inner: bool = False) -> list[frozenset[int]]:
        """x as conjunctions of literals: n for leaf or latch n (from 1), -n for its contrary. Latches count from 10001."""
        head = x[0]
        if head == "not":
            return self.terms(x[1], not positive, inner)
        if head in ("all", "any"):
            parts = [self.terms(p, positive, inner) for p in x[1:]]
            if (head == "all") == positive:
                return list(dict.fromkeys(reduce(lambda a, b: a | b, c, frozenset()) for c in product(*parts)))
            return list(dict.fromkeys(t for p in parts for t in p))
        if head == "leaf":
            n = self.leaves.setdefault(x, len(self.leaves) + 1)
        elif inner:
            raise ValueError("a condition on earlier steps cannot hold another")
        else:
            n = 10_000 + self.latches.setdefault(x, len(self.latches) + 1)
        return [frozenset({n if positive else -n})]


def compiled(task: str, rule_: dict) -> tuple:
    """A row of RULE."""
    t, goals = _Task(), []
    named = [("page", rule_["page"]), *((str(i), g) for i, g in enumerate(rule_["goals"], 1))]
    if rule_["complete"] is not None:
        named.append(("complete", rule_["complete"]))
    for name, x in named:
        if x[0] == "said":
            goals.append((name, [], t.leaves.setdefault(x[1], len(t.leaves) + 1)))
        else:
            goals.append((name, t.terms(x), None))
    latches = [(x[0] == "ever", t.terms(x[1], inner=True)) for x in list(t.latches)]
    own = len(t.leaves)
    place = lambda n: n if abs(n) < 10_000 else (abs(n) - 10_000 + own) * (1 if n > 0 else -1)
    lists = lambda terms: [[place(n) for n in sorted(term)] for term in terms]
    leaves = [(kind, scope, arg, dict(asked)) for _, kind, scope, arg, asked in t.leaves]
    return task, leaves, [(i, lists(w)) for i, w in latches], [(n, lists(w), s) for n, w, s in goals]


#: Rules that register_rule added, by task; they replace the catalogue's.
_REGISTERED: dict[str, dict] = {}


def register_rule(task: str, rule_: dict) -> None:
    compiled(task, rule_)  # so that a wrong one raises here
    _REGISTERED[task] = rule_


def rules(spark: SparkSession, tasks: dict[str, dict] | None = None) -> DataFrame:
    """Rules as a table: of tasks, or else the catalogue's and the registered ones."""
    if tasks is None:
        from .rulebook import RULES

        tasks = RULES | _REGISTERED
    return spark.createDataFrame([compiled(k, v) for k, v in tasks.items()], RULE)


# --- leaves


def _bill_field(page: Column, leaf_: Column) -> Column:
    field = lambda b: F.when(leaf_["scope"] == "type", b["type"]).when(leaf_["scope"] == "date", b["date"]).when(leaf_["scope"] == "cash", b["cash"]).otherwise(F.lower(b["note"]))
    return S.once(S.bill(page), lambda b: F.array_contains(F.split(leaf_["arg"], r"\|"), field(b)))


def _tests(page: Column, leaf_: Column) -> dict[str, Column]:
    """Each kind of test of a screen. arg and scope are texts of the rule; several alternatives are split by |."""
    scope, arg = leaf_["scope"], leaf_["arg"]
    parts = F.split(arg, r"\|")
    heard = lambda k: F.contains(k, F.lit("hour")) & F.contains(k, F.lit("minute")) & F.contains(k, F.lit("second"))
    grand = lambda p: F.exists(S.children(page, p), lambda c: F.exists(S.children(page, c["pre"]), lambda g: S.tail(g["key"]) == arg))
    return {
        "has": S.has(page, arg),
        "beside": F.exists(S.family_keys(page, scope), lambda k: F.contains(k, arg)),
        "beside_is": F.exists(S.family_keys(page, scope), lambda k: S.tail(k) == arg),
        "beside_after": F.exists(S.family_keys(page, scope), lambda k: F.contains(k, F.element_at(parts, 1)) & (F.rtrim(F.split_part(k, F.element_at(parts, 1), F.lit(-1))) == F.element_at(parts, 2))),
        "beside_on": F.exists(S.family_keys(page, scope), lambda k: S.checked(k) & F.contains(k, arg)),
        "beside_miscounts": F.exists(S.family_keys(page, scope), lambda k: F.contains(k, scope) & F.contains(S.tail(k), F.element_at(parts, 1)) & ~F.contains(S.tail(k), F.element_at(parts, 2))),
        "below_is": F.exists(S.parents(page, scope), grand),
        "next_contains": S.once(S.family_keys(page, scope), lambda ks: F.exists(F.zip_with(F.slice(ks, F.lit(1), F.greatest(F.size(ks) - 1, F.lit(0))), F.slice(ks, F.lit(2), F.greatest(F.size(ks) - 1, F.lit(0))), lambda k, n: F.contains(k, scope) & F.contains(n, arg)), lambda x: x)),
        "next_on": S.next_checked(page, scope),
        "section": S.section_has(page, F.split_part(scope, F.lit("|"), F.lit(1)), F.split_part(scope, F.lit("|"), F.lit(2)), arg),
        "first_family": S.first_family_has(page, scope, arg),
        "last_share": S.last_family_tail(page, scope, F.lit("%")) == arg,
        "within": S.within(page, scope, arg),
        "first_tab": F.coalesce(F.contains(F.get(S.topmost(page, F.lit(S.SELECTED_TAB)), 0)["key"], arg), F.lit(False)),
        "single": F.size(S.topmost(page, arg)) == 1,
        "text": F.array_contains(S.texts(page), arg),
        "text_part": F.exists(S.texts(page), lambda t: F.forall(parts, lambda p: F.contains(t, p))),
        "text_every": F.forall(S.texts(page), lambda t: F.exists(parts, lambda p: F.contains(t, p))),
        "spoken": F.exists(S.keys(S.topmost(page, F.lit(S.TEXT_NODE))), lambda k: heard(k) & (S.spoken_number(k, scope) == arg)),
        "time_beside": S.time_beside(page, scope, F.element_at(parts, 1)) == F.element_at(parts, 2),
        "falling": S.durations_run(page, True),
        "rising": S.durations_run(page, False),
        "bill": _bill_field(page, leaf_),
        "bill_filled": S.once(S.bill(page), lambda b: (b["cash"] != "") | (b["note"] != "")),
        "sign": F.coalesce(S.sign(page) == arg, F.lit(False)),
        "alarm_list": S.alarm_list(page),
        "alarm": S.any_alarm(page, S.parents(page, F.lit("Alarm")), leaf_["asked"]),
        "alarm_below": S.any_alarm(page, F.transform(S.topmost(page, F.lit("Alarm")), lambda n: n["pre"].cast("int")), leaf_["asked"]),
        "size": F.exists(S.family_keys(page, scope), lambda k: F.exists(parts, lambda p: F.contains(k, p))),
    }


def _state_tests(leaf_: Column) -> dict[str, Column]:
    """Tests of device state (the output of command scope) and of the answer of a finished step."""
    output, arg = F.try_element_at(F.col("command"), leaf_["scope"]), leaf_["arg"]
    words = F.split(arg, r"\|")
    told = F.when(output == F.element_at(words, 1), F.element_at(words, 2)).otherwise(F.element_at(words, 3))
    return {
        "always": F.lit(True), "finished": F.col("finished"), "reported": output.isNotNull(),
        "state_equals": output == arg, "state_contains": F.contains(output, arg),
        "answer": F.col("finished") & rule_judge(F.col("answer"), arg), "answer_state": F.col("finished") & rule_judge(F.col("answer"), F.coalesce(output, F.lit(""))),
        "answer_told": F.col("finished") & rule_judge(F.col("answer"), told),
    }


KINDS = {
    *"has beside beside_is beside_after beside_on beside_miscounts below_is next_contains next_on section first_family last_share within first_tab single text text_part text_every".split(),
    *"spoken time_beside falling rising bill bill_filled sign alarm_list alarm alarm_below size always finished reported state_equals state_contains answer answer_state answer_told".split(),
}


def _choose(tests: dict[str, Column], kind: Column) -> Column:
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(kind == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def _said(page: Column, leaf_: Column) -> Column:
    """The text that a leaf finds: of the first child that fits, what follows the last ; of its key."""
    found = F.filter(S.family_keys(page, leaf_["scope"]), lambda k: F.exists(F.split(leaf_["arg"], r"\|"), lambda p: F.contains(k, p)))
    return S.tail(F.get(found, 0))


def _holds(terms: Column, bits: Column) -> Column:
    """Whether one of the conjunctions holds."""
    return F.exists(terms, lambda t: F.forall(t, lambda n: F.element_at(bits, F.abs(n)) == (n > 0)))


def judge(steps: DataFrame, nodes: DataFrame, rule_rows: DataFrame | None = None) -> DataFrame:
    """(trace_id, step, task_id, page, subgoals map<string,string>, complete) of every step whose task has a rule.

    steps: (trace_id, step, task_id, command map, answer, finished); nodes: (trace_id, step, node_id, last_id, parent_id, key). A
    step without nodes has an empty page. Sub-goals are 'true', 'false' or, where a rule asks for it, a text; on a page that does not pass
    the gate they are null, and so is complete, as for rules that nothing completes. Ties in step count as one time
    in no fixed order, so steps of a trace should differ. Nulls: a null answer or command has nothing in it, null finished is
    not finished, steps without trace_id are one trace. An empty table gives no row.

    Rules are a few hundred rows, counted before they are broadcast. Pages are aggregated from nodes once; a trace's steps meet
    in one task, as their order demands, but not their pages.
    """
    from ..plans.storage import bounded

    rule_rows = rules(steps.sparkSession) if rule_rows is None else rule_rows
    shown = S.pages(nodes, ["trace_id", "step"])
    empty = F.expr("cast(array() as array<struct<pre:int,last:int,parent:int,key:string>>)")
    own = steps.select("trace_id", "step", "task_id", "command", "answer", F.coalesce("finished", F.lit(False)).alias("finished")).join(bounded(rule_rows), "task_id")
    kinds = dict(shown.dtypes)["nodes"]
    rows = own.join(shown, ["trace_id", "step"], "left").withColumn("nodes", F.coalesce("nodes", empty.cast(kinds)))
    page = F.col("nodes")
    test = lambda x: _choose(_tests(page, x) | _state_tests(x), x["kind"])
    bits = F.transform("leaves", test)
    words = F.transform("goals", lambda g: F.when(g["said"].isNotNull(), _said(page, F.element_at(F.col("leaves"), g["said"]))))
    known = rows.select("trace_id", "step", "task_id", "goals", "latches", bits.alias("bits"), words.alias("words"))
    # what latches hold now, as bits of a number; the steps before or up to this one together
    now = F.aggregate(F.transform("latches", lambda x, i: F.when(_holds(x["when"], F.col("bits")), F.expr("1L") * F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    known = known.withColumn("now", now)
    w = Window.partitionBy("trace_id", "task_id").orderBy("step")
    known = known.withColumn("earlier", F.coalesce(F.bit_or("now").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    held = F.transform("latches", lambda x, i: F.expr("1L") * F.floor(F.when(x["inclusive"], F.col("earlier").bitwiseOR(F.col("now"))).otherwise(F.col("earlier")) / F.pow(F.lit(2), i)) % 2 == 1)
    known = known.withColumn("bits", F.concat("bits", held))
    results = F.transform("goals", lambda g, i: F.struct(g["name"].alias("name"), F.when(g["said"].isNull(), _holds(g["when"], F.col("bits")).cast("string")).otherwise(F.get("words", i)).alias("value")))
    done = known.withColumn("result", F.map_from_entries(results))
    gate, whole = F.element_at("result", "page") == "true", F.try_element_at("result", F.lit("complete"))
    goals = F.map_filter("result", lambda k, v: ~k.isin("page", "complete"))
    return done.select("trace_id", "step", "task_id", gate.alias("page"), F.when(gate, goals).alias("subgoals"), F.when(gate, whole == "true").alias("complete"))


def leaf_texts(tasks: Iterable[str] | None = None) -> list[tuple[str, str]]:
    """(task_id, text) of what rules look for, for building screens to test them with."""
    from .rulebook import RULES

    out = []
    for task, r in RULES.items():
        if tasks is None or task in tasks:
            _, leaves, _, _ = compiled(task, r)
            out += [(task, t) for _, scope, arg, _ in leaves for t in (*scope.split("|"), *arg.split("|")) if t]
    return list(dict.fromkeys(out))
