"""Trace windows against loops, and aggregates against arithmetic."""

import random

from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.operators import metrics as G
from veilframe.operators import ranks as K
from veilframe.operators import trace as T
from veilframe.operators import work as W


def traces(spark, n=40):
    rng = random.Random(7)
    rows = [(t, i, rng.choice("abc") if rng.random() < 0.25 else "a") for t in range(n) for i in range(rng.randint(1, 30))]
    return rows, spark.createDataFrame(rows, "trace int, index int, action string")


def by_trace(rows):
    out = {}
    for t, _, a in sorted(rows):
        out.setdefault(t, []).append(a)
    return out


def test_cutoff_and_autostop_equal_loops(spark):
    rows, df = traces(spark)
    kept = {r.trace: r.n for r in T.repeat_cutoff(df, "trace", ["index"], "action").groupBy("trace").agg(F.count(F.lit(1)).alias("n")).collect()}
    stop = {r.trace: r.stop_step for r in T.autostop(df, "trace", ["index"], "action").collect()}
    for t, actions in by_trace(rows).items():
        run, expect, last = 0, 0, None
        for a in actions:
            run, last = (run + 1 if a == last else 1), a
            if run >= 7:
                break
            expect += 1
        assert kept[t] == expect
        first = next((i for i in range(6, len(actions) + 1) if len(set(actions[i - 5 : i])) == 1), None)
        assert stop[t] == first


def test_null_actions_are_equal(spark):
    df = spark.createDataFrame([(1, i, None) for i in range(9)], "trace int, index int, action string")
    assert T.repeat_cutoff(df, "trace", ["index"], "action").count() == 6


def test_verdict_rules(spark):
    rows = [(1, 1, True, True, False), (1, 2, False, False, False), (2, 1, False, True, False), (3, 1, None, True, True), (4, 1, None, True, False)]
    df = spark.createDataFrame(rows, "trace int, index int, page boolean, done boolean, failed boolean")
    got = {r.trace: (r.complete, r.judged) for r in T.verdict(df, "trace", ["index"], F.col("page"), F.col("done"), F.col("failed")).collect()}
    assert got == {1: (True, 2), 2: (False, 1), 3: (False, 0), 4: (True, 1)}


def test_sticky_two_phase_and_order(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 2), (2, 1, 1)], "trace int, index int, v int")
    assert [r.hit for r in T.sticky(df, "trace", ["index"], {"hit": F.col("v") > 8}).orderBy("trace", "index").collect()] == [False, True, True, False]
    assert [r.v for r in T.after_first(df, "trace", ["index"], F.col("v") > 8).collect()] == [2]
    assert {r.trace: r.sorted for r in T.ordered(df, "trace", ["index"], "v").collect()} == {1: False, 2: True}


def test_instruction_and_no_ops(spark):
    df = spark.createDataFrame([(1, 1, None, "t1", "h"), (1, 2, "o2", "t2", "h"), (1, 3, None, None, "g"), (2, 1, None, "x", "h"), (2, 2, None, "y", "h")], "trace int, index int, original_instruction string, target string, screen string")
    assert {r.trace: r.instruction for r in T.instruction(df, "trace", ["index"]).collect()} == {1: "o2", 2: "x"}
    assert {r.trace: r.no_ops for r in T.no_ops(df, "trace", ["index"], "screen").collect()} == {1: 1, 2: 0}


def test_partial_accuracy_modes(spark):
    df = spark.createDataFrame([({"1": "true", "2": "false", "complete": "false"},), ({"1": "12 MB", "used": "x"},), ({},), (None,)], "g map<string,string>")
    got = df.select(T.partial_accuracy(F.col("g")), T.partial_accuracy(F.col("g"), "all_keys")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_image_order_and_tail(spark):
    names = ["z.png", "a-7-end.png", "a-2-5-before.png", "a-10-1-before.png", "a-2-3-before.png"]
    got = spark.range(1).select(T.image_order(F.array(*map(F.lit, names))), X.tail(F.array(*map(F.lit, "abbcd")), 2), X.tail(F.array(F.lit("a")), 0)).first()
    assert got[0][-2:] == ["a-7-end.png", "z.png"] and set(got[0][:3]) == set(names[2:])
    assert got[1] == ["c", "d"] and got[2] == ["a"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", True, 0.0, 0.5, 1.0), ("a", False, 0.5, None, 0.5), ("b", False, 0.0, None, None)], "app string, c boolean, p double, r double, o double")
    apps = G.app_metrics(df, "app", F.col("c"), F.col("p"), F.col("r"), F.col("o"))
    got = {r.app: r.asDict() for r in apps.collect()}
    assert got["a"]["acc"] == 0.5 and got["a"]["partial_acc"] == 0.75 and got["a"]["rrr"] == 0.5
    assert got["b"]["rrr"] == 0.0 and got["b"]["ror"] == 0.0
    total = G.global_metrics(apps).first()
    assert total.sr <= total.sub_sr and total.total == 3
    assert G.global_metrics(apps.filter("false")).first().sr == 0.0


def test_leakage_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.6, "x"), (0.61, "0"), (None, " ")], "s double, p string")
    row = G.leakage(df, F.col("s"), G.answered(F.col("p"))).first()
    assert (row.fields, row.leakage_rate, row.response_rate) == (2, 0.5, 0.5)
    assert G.leakage(df.filter("false"), F.col("s"), G.answered(F.col("p"))).first()[1:] == (0.0, 0.0, 0.0)


def test_running_equals_a_loop(spark):
    df = spark.createDataFrame([(i * 3, i % 4) for i in range(500)], "i long, v long")
    rows = K.running(df, "i", {"s": F.col("v")}).orderBy("i").collect()
    total = 0
    for k, r in enumerate(rows):
        total += k % 4
        assert r.s == total


def test_ratios(spark):
    row = spark.range(1).select(G.reasonable_ratio(F.lit(0), F.lit(1)), G.reasonable_ratio(F.lit(1), F.lit(3)), G.reasonable_ratio(F.lit(0), F.lit(0)), G.reward_ratio(F.lit(True), F.lit(None).cast("int"), F.lit(3)), G.reward_ratio(F.lit(True), F.lit(2), F.lit(4))).first()
    assert list(row) == [1.0, 0.5, 1.0, None, 0.5]


def test_layer_summary_uses_the_legacy_column(spark):
    df = spark.createDataFrame([("text", 10, None, 4), ("xml", 0, 0, None)], "type string, original_length int, anonymized_chars_count int, anonymized_length int")
    rows = {(r.type, r.overall): r for r in G.layer_summary(df, legacy="anonymized_length").collect()}
    assert rows["text", 0].masked_percent == 40.0 and rows["xml", 0].masked_percent == 0.0 and rows[None, 1].records == 2


def test_work_bookkeeping(spark):
    names = spark.createDataFrame([("a_1_x",), ("b",)], "n string")
    assert [r[0] for r in names.select(W.task_id_of(F.col("n"))).collect()] == ["a_1", None]
    tries = spark.createDataFrame([("t", 1, "abort"), ("t", 2, "success"), ("u", 1, "abort"), ("u", 2, "abort")], "task string, n int, status string")
    assert {(r.task, r.n) for r in W.last_attempt(tries, "task", "n", "status").collect()} == {("t", 2), ("u", 2)}
    tasks = spark.createDataFrame([("t",), ("u",), ("v",)], "task string")
    assert {r.task for r in W.to_run(tasks, tries, tries.filter("task = 'u'"), "task").collect()} == {"u", "v"}
    assert spark.range(1).select(W.name_list(F.lit("b, a,b,,"))).first()[0] == ["b", "a"]


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"status": "SUCCESS", "confidence": "sure"}\n```',), ("it is incorrect",), ('{"correct": true}',), (None,)], "r string")
    got = df.select(W.parse_verdict(F.col("r")).alias("v"), W.parse_correct(F.col("r")).alias("c")).collect()
    assert tuple(got[0].v) == ("success", "medium") and [r.c for r in got] == [False, False, True, False]


def test_actions_are_parsed_not_run(spark):
    df = spark.createDataFrame([("x\n```\ndo(action=\"Tap\", element=[007,2,3,4])\n```",), ("Action: finish(message=\"done\")",), ("import os",)], "r string")
    got = [r[0] for r in df.select(W.parse_action(F.col("r"))).collect()]
    assert (got[0].operation, got[0].action, got[0].box) == ("do", "Tap", [7, 2, 3, 4])
    assert (got[1].operation, got[1].action, got[1].message) == ("finish", "finish", "done") and got[2].operation == "error"


def test_gate_and_notice(spark):
    mapping = F.create_map(F.lit("A#1"), F.lit("x"))
    ok = F.lit('{"approved": true, "result": "7"}')
    rows = spark.range(1).select(
        W.gate(F.lit(True), F.lit(None).cast("string"), F.lit("use A#1"), mapping, ok).alias("a"), W.gate(F.lit(True), F.lit(""), F.lit("use B#2"), mapping, ok).alias("b"),
        W.gate(F.lit(False), F.lit(""), F.lit("A#1"), mapping, ok).alias("c"), W.gate(F.lit(True), F.lit("full"), F.lit("A#1"), mapping, ok).alias("d"), W.gate(F.lit(True), F.lit(""), F.lit("A#1"), mapping, F.lit("no")).alias("e"),
        W.with_notice(F.lit("p ANCHOR q"), "N ", "ANCHOR").alias("n"),
    ).first()
    assert rows.a.approved and rows.a.resolved == "use x" and rows.a.result == "7"
    assert not rows.b.approved and rows.b.missing_tokens == ["B#2"] and rows.c.reason == "disabled" and rows.d.reason == "unsupported" and rows.e.reason == "unreadable reply"
    assert rows.n == "p N ANCHOR q"


def test_durations(spark):
    row = spark.range(1).select(X.duration_seconds(F.lit("3:05")), X.duration_seconds(F.lit("1:00:01")), X.strip_leading_zeros(F.lit("f(007, 0.5, 10)")), X.first_words(F.lit("a b c"), 2)).first()
    assert list(row) == [185, 3601, "f(7, 0.5, 10)", "a b"]
