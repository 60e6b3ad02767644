"""Judges as rule rows, records, registries over screens, UI files and sinks."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.operators import catalogue, judges, mask, qa, ranks, records, registry, trace, uitree, work
from veilframe.sources import files

from .models import fold_task

NODES = "trace_id string, task_id string, step int, parent_id int, ord int, key string"


def judged(spark, task, *pages):
    """Verdicts of the catalogue's rules on pages, each a list of families of keys."""
    rows = [("t", task, step, parent, i, key) for step, page in enumerate(pages) for parent, family in enumerate(page) for i, key in enumerate(family)]
    out = judges.judge_pages(spark.createDataFrame(rows, NODES), judges.rules(spark)).orderBy("step").collect()
    return [(r.page, r.subgoals, r.complete) for r in out]


def test_text_rules(spark):
    assert judged(spark, "calendar_2", [["homework", "May 21", "10 minutes before "]], [["homework", "May 21"]], [["May 21"]]) == [
        (True, {"1": True, "2": True, "3": True}, True), (True, {"1": True, "2": True, "3": False}, False), (False, {"1": True, "2": True, "3": False}, False),
    ]
    assert judged(spark, "contacts_11", [["ABC ABC"]], [["ABC ABC", "AAA AAA "]]) == [(True, {"1": True}, True), (True, {"1": False}, False)]


def test_rules_beside_a_text(spark):
    label, other = "Text ;; ;;Battery percentage ", "Switch ;click ; unchecked ;;"
    assert judged(spark, "setting_5", [[label], [other]], [[label, other]])[0][2] and not judged(spark, "setting_5", [[label, other]])[0][2]
    assert judged(spark, "setting_1", [["Turn on Wi‑Fi automatically", "Switch;unchecked "]])[0][2]
    number = "Text ;; ;;Call Mobile 1 (234) 567-8 "
    page = ["Contact", "John Smith", number]
    assert judged(spark, "contacts_2", [[*page, "Text ;; ;;Email Work 123456@qq.com "]])[0][2] and not judged(spark, "contacts_2", [page, ["Text ;; ;;Email Work 123456@qq.com "]])[0][2]
    spanish = "Español (Estados Unidos)"
    assert [v[1] for v in judged(spark, "setting_15", [["Add a language", spanish, "no 2"]], [["Add a language", "2", spanish, "3"]])] == [{"1": True, "2": True}, {"1": True, "2": False}]


def test_state_and_answer_rules(spark):
    c = catalogue.STATES
    off, release, booking = c["setting_0"][1], c["setting_17"][1], c["setting_20"][1]
    rows = [
        ("a", "setting_0", 1, {off: "1"}, None, False, True), ("b", "setting_0", 1, {off: "0"}, None, False, False), ("c", "setting_0", 1, {}, None, False, None),
        ("d", "setting_17", 1, {release: "14"}, "It is Android 14", True, True), ("e", "setting_17", 1, {release: "14"}, "13", True, False),
        ("f", "setting_20", 1, {booking: ""}, None, False, True), ("g", "setting_20", 1, {booking: "package:com.booking"}, None, False, False),
        ("h", "bluecoins_2", 1, {}, "The note is buying CAKE.", True, True), ("i", "bluecoins_2", 1, {}, "buying cake", False, None), ("j", "unknown_1", 1, {}, "x", True, None),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "trace_id string, task_id string, step int, command map<string,string>, answer string, finished boolean")
    got = {r.trace_id: (r.complete if r.page else None) for r in judges.judge_state(df, judges.rules(spark)).collect()}
    assert {r[0]: got.get(r[0]) for r in rows} == {r[0]: r[6] for r in rows} and "j" not in got
    assert [r.trace_id for r in judges.bind(df, judges.rules(spark)).orderBy("trace_id").collect()] == list("abcdefghi")


def test_registered_judges(spark):
    before = list(judges._REGISTERED)
    try:
        judges.register_judge([("calendar_10", "1", "has", "", "own"), ("own_1", "1", "group", "", "a, b")])
        assert judged(spark, "calendar_10", [["own"]])[0] == (True, {"1": True}, True) and judged(spark, "own_1", [["a"], ["b"]])[0][2]
        with pytest.raises(ValueError):
            judges.register_judge([("x", "1", "guess", "", "")])
    finally:
        judges._REGISTERED[:] = before


def test_catalogue_is_whole():
    rows = catalogue.rows()
    tasks = {r[0] for r in rows}
    assert len(rows) == len(set(rows)) and {r[2] for r in rows} <= {*judges.PAGE_KINDS, *judges.STATE_KINDS}
    assert all(any(r[0] == t and r[1] == "1" for r in rows) for t in tasks) and {f"map_{i}" for i in range(1, 11)} <= tasks


def fold_alarms(keys):
    """The scan in plain Python."""
    out, now, opened = [], {"days": []}, False
    for key in keys:
        if "Collapse" in key:
            opened = now["expanded"] = True
        if ("Delete" in key or "Add alarm" in key) if opened else ("Switch" in key and "checked" in key):
            out.append({**now, "status": "unchecked" if "unchecked" in key else "checked"})
            now, opened = {"days": []}, False
        if "AM" in key or "PM" in key:
            now["time"] = key
        for field, word in (("label", "Label"), ("ringtone", "Ringtone")):
            if word in key:
                now[field] = key
        now["days"] += [d for d in records.DAYS if d in key and "TextView" in key]
        if "Vibrate" in key:
            now["vibrate"] = "unchecked" if "unchecked" in key else "checked"
    return out


def test_alarms_equal_a_scan(spark):
    rng = random.Random(4)
    words = ["8:30 AM ", "TextView ;; ;;Mon, Tue ", "TextView ;; ;;Every day ", "Switch ;; checked ;;", "Switch ;; unchecked ;;", "Collapse alarm", "Delete", "Add alarm", "Label x", "Ringtone Bell", "Vibrate ; unchecked ;", "Vibrate ; checked ;", "else"]
    pages = [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(40)]
    rows = [(p, i, k) for p, keys in enumerate(pages) for i, k in enumerate(keys)]
    df = records.keys_of(spark.createDataFrame(rows, "page int, ord int, key string").repartition(3), ["page"])
    for r in df.select("page", records.alarms(F.col("keys")).alias("a")).collect():
        got = [{k: v for k, v in x.asDict().items() if v is not None} for x in r.a]
        assert got == fold_alarms(pages[r.page]), pages[r.page]


def test_songs_bills_and_sets(spark):
    texts = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(
        records.songs(texts("Tracks", "A", "Ann", "3:10", "B", "Bob", "1:02:03", "C", "Cy", "none", "D", "Di", "2:00")).alias("s"),
        records.songs(texts("only", "two")).alias("none"),
        records.bill(texts("TextView ;; ;;An Expense ", "TextView ;; ;;May 1, 2024 "), texts("x ;click ; ;;CNY ", "EditText ;click long-click ; ;;512 "), texts("EditText ;; ;;512 ", "EditText ;; ;;Notes ")).alias("b"),
        records.text_set(texts("TextView ;; ;;b ", "TextView ;click ; ;;a ", "Button ;; ;;c ", "TextView ;; ;;b ")).alias("t"),
        records.descending(texts("3:10", "2:00", "2:00"), lambda x: F.length(x)).alias("d"),
    ).first()
    assert [tuple(x) for x in row.s] == [("A", "Ann", "3:10"), ("B", "Bob", "1:02:03")] and row.none == []
    assert row.b.asDict() == {"type": "Expense", "date": "May 1, 2024", "cash": "512", "note": "None"}
    assert row.t == ["TextView ;click ; ;;a", "b"] and row.d
    empty = F.expr("cast(array() as array<string>)")
    none = spark.range(1).select(records.bill(empty, empty, empty).alias("b")).first().b
    assert none.asDict() == {"type": "", "date": "", "cash": "", "note": ""}
    wanted = F.struct(F.lit("Expense").alias("type"), F.lit(None).cast("string").alias("date"), F.lit("512").alias("cash"), F.lit("LUNCH").alias("note"))
    found = F.struct(F.lit("Expense").alias("type"), F.lit("x").alias("date"), F.lit("512.00").alias("cash"), F.lit("lunch").alias("note"))
    assert tuple(spark.range(1).select(records.bill_matches(found, wanted).alias("m")).first().m) == (True, None, True, True)


def test_selected_tabs(spark):
    rows = [(1, "0", "list"), (1, "0.0", "tab ;; selected ; selected, ;"), (1, "0.0.0", "Clock"), (1, "0.1", "Timer"), (2, "0", "Clock")]
    got = {r.page: r.selected for r in records.selected(spark.createDataFrame(rows, "page int, path string, key string"), "page", "Clock").collect()}
    assert got == {1: True, 2: False}


def test_occurrences_of_a_value(spark):
    cases = [("aaaa", "aa"), ("xaxa", "xa"), ("", "a"), ("abc", ""), ("a.b\\Eca.b\\E", ".b\\E"), ("é😀é😀", "😀"), ("a\nb\na\nb", "a\nb"), ("zzz", "y"), ("end x", "x"), (None, "a")]
    df = spark.createDataFrame(cases, "t string, v string")
    for r in df.select("t", "v", S.occurrences(F.col("t"), F.col("v")).alias("o")).collect():
        want = [i for i in range(len(r.t)) if r.v and r.t.startswith(r.v, i)] if r.t is not None else []
        assert (r.o or []) == want, r
    long = spark.createDataFrame([("word " * 200_000 + "needle",)], "t string")
    begin = time.time()
    assert long.select(S.occurrences(F.col("t"), F.lit("needle")).alias("o")).first().o == [1_000_000] and time.time() - begin < 20


def test_chunks_only_for_long_markup(spark):
    text = "a" * 495 + " ann@ex.org"
    row = spark.range(1).select(S.detect_text(F.lit(text), F.lit(True)).alias("m"), S.detect_text(F.lit(text), F.lit(False)).alias("p"), S.detect_text(F.lit("ann@ex.org"), F.lit(True)).alias("s")).first()
    assert len(row.p) == 1 and row.m != row.p and len(row.s) == 1


def test_registry_finds_all_values():
    rng = random.Random(3)
    r = registry.Registry()
    for n in range(120):
        r.get("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))), "X")
        if n % 7 == 0:
            text = "".join(rng.choice("abc") for _ in range(200))
            want = sorted((i, k, v) for k, v in enumerate(r.token_of) for i in range(len(text)) if text.startswith(v, i))
            assert r.find(text) == [(i, i + len(v), v) for i, _, v in want]
    assert r._automaton is not None


def test_long_tasks_have_no_bound(spark):
    df = spark.range(1500).selectExpr("'t' as task", "id as step", "concat('call +1 555 0', lpad(id, 6, '0'), ' or mail a', id % 3, '@ex.org') as text")
    rows = registry.mask_with_registry(df.repartition(4), "task", "step").orderBy("step").collect()
    want = list(fold_task([r.text for r in df.orderBy("step").collect()]))
    assert [(r.masked, r.tokens, r.masked_chars) for r in rows] == want


def test_manual_entries_and_clearing(spark):
    known = spark.createDataFrame([("t", "Ann", "NAME", "NAME#1", 3), ("t", "Bob", "NAME", "NAME#2", 4), ("u", "Cy", "NAME", "NAME#3", 1)], "task string, value string, label string, token string, first_step int")
    manual = spark.createDataFrame([("t", "Ann", "PERSON", "PERSON#9"), ("t", "Dee", "NAME", "NAME#2")], "task string, value string, label string, token string")
    got = sorted((r.task, r.value, r.token) for r in registry.with_manual(known, manual).collect())
    assert got == [("t", "Ann", "PERSON#9"), ("t", "Dee", "NAME#2"), ("u", "Cy", "NAME#3")]
    assert [r.value for r in registry.cleared(known, manual).collect()] == ["Cy"]


def test_screens_are_masked_item_by_item(spark):
    box = [[0.0, 1.0], [9.0, 1.0], [9.0, 5.5], [0.0, 5.5]]
    rows = [("t", 1, ["hello", "mail ann@ex.org", ""], [box] * 3), ("t", 2, ["write to ann@ex.org or ann@ex.org", None], [box] * 2), ("u", 1, None, None)]
    df = spark.createDataFrame(rows, "task string, step int, texts array<string>, points array<array<array<double>>>")
    got = sorted(registry.mask_screens(df, "task", "step", "texts", "points").collect())
    token = registry.py_token("EMAIL_ADDRESS", "ann@ex.org")
    assert [tuple(r) for r in got] == [("t", 1, 1, f"mail [{token}]", 10, 0, 1, 9, 5), ("t", 2, 0, f"write to [{token}] or [{token}]", 20, 0, 1, 9, 5)]


def test_trees_are_unmasked_column_by_column(spark):
    df = spark.createDataFrame([("say NAME#1", ["[NAME#1]", "x"], {"NAME#1": "to NAME#1"}, {"NAME#1": "Ann"})], "a string, b array<string>, c map<string,string>, m map<string,string>")
    row = mask.unmask_columns(df, ["a", "b", "c"], "m").first()
    assert (row.a, row.b, row.c) == ("say Ann", ["Ann", "x"], {"Ann": "to Ann"})


def test_actions_and_fields(spark):
    m = F.create_map(F.lit("NAME#1"), F.lit("Ann"))
    row = spark.range(1).select(
        *(mask.rewrite_action(F.lit("ask NAME#1"), F.lit(x), m) for x in ("token_anonymization", "full_cover", None)),
        qa.tracked_fields(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(" "), F.lit("c"), F.lit(None).cast("string"))),
    ).first()
    assert list(row) == ["ask Ann", "ask NAME#1", "ask Ann", {"a": "x"}]
    df = spark.createDataFrame([("x",), ("y",), (None,)], "app string")
    assert qa.of_app(df, "app", "x").count() == 1 and qa.of_app(df, "app", None).count() == 3


def test_ui_files_and_rescued_finishes(spark):
    rows = [(1, "/run/xml/a.xml", "/run/xml/b.xml", False, "operation"), (2, None, "/run/xml/b.xml", True, "query_detect"), (3, None, None, True, "query_detect"), (4, None, "c.xml", True, "operation")]
    steps = spark.createDataFrame(rows, "step int, ac_xml string, xml string, finished boolean, metric_type string")
    kept, rescued = trace.with_ui(steps, spark.createDataFrame([("a.xml",), ("b.xml",)], "name string"))
    assert sorted((r.step, r.ui_file) for r in kept.collect()) == [(1, "a.xml"), (2, "b.xml")] and [r.step for r in rescued.collect()] == [3]


def boxed(i, parent, box):
    return {"node_id": i, "parent_id": parent, "bounds": "[%d,%d][%d,%d]" % box}


def test_overlap_removal_descends():
    rows = [boxed(0, None, (0, 0, 100, 100)), boxed(1, 0, (0, 0, 50, 50)), boxed(2, 1, (0, 0, 30, 30)), boxed(3, 2, (0, 0, 5, 5)), boxed(4, 0, (20, 20, 60, 60))]
    assert [(r["node_id"], r["parent_id"]) for r in uitree.drop_overlaps(rows)] == [(0, None), (3, 0), (4, 0)]
    rows = [boxed(0, None, (0, 0, 90, 90)), boxed(1, 0, (0, 0, 9, 9)), boxed(2, 0, (10, 10, 19, 19)), boxed(3, 2, (11, 11, 12, 12))]
    assert [r["node_id"] for r in uitree.drop_overlaps(rows)] == [0, 1, 2, 3]


def test_wide_pages_are_parsed_in_one_pass():
    begin = time.time()
    nodes = uitree.parse_nodes("<a>" + "<b></b>" * 40_000 + "</a>")
    assert len(nodes) == 40_001 and nodes[-1]["xpath"] == "/a[1]/b[40000]" and time.time() - begin < 10


XML = '<node class="a.b.ListView" resource-id="x:id/material_clock_face" bounds="[0,0][9,9]"><node class="a.widget.TextView" text="hello big\nworld" bounds="[0,0][5,5]"/><node class="android.view.View" content-desc="d" checkable="true" focusable="true"/><node class="w.EditText" password="true" selected="true" clickable="true" long-clickable="true" resource-id="p:id/field"/></node>'


def test_derived_attributes_and_trees(spark):
    df = spark.createDataFrame([(1, XML)], "page int, m string")
    rows = {r.node_id: r for r in uitree.derived(uitree.ui_nodes(df, "page", "m")).collect()}
    assert rows[1].key == "TextView ;click; ;;hello bigworld " and rows[1].name == "hello big world TextView"
    assert rows[2].key == ";check click; unchecked ;;d " and rows[2].kind == "" and rows[0].id_suffix == "material_clock_face"
    assert rows[3].key == "EditText ;click long-click click; password selected ; you can input password,  selected, ;" and rows[3].id_suffix == "field"
    nodes = uitree.ui_nodes(df, "page", "m")
    tree = json.loads(uitree.tree_json(nodes, "page").first().json)
    assert list(tree) == ["[n0] ListView ;; ;;"] and tree["[n0] ListView ;; ;;"]["bounds"] == "[0,0][9,9]" and len(tree["[n0] ListView ;; ;;"]) == 4
    listed = {r.node_id: r.full for r in uitree.bounds_listing(nodes.withColumn("key", F.concat(F.lit("k"), "node_id")), "page").collect()}
    assert listed == {0: "k0", 1: "k0/k1"}


def test_nodes_in_sql(spark):
    uitree.register_ui_nodes(spark)
    spark.createDataFrame([(1, XML), (2, None)], "page int, m string").createOrReplaceTempView("marked")
    rows = spark.sql("select page, n.node_id, n.parent_id, n.flags from marked, lateral ui_nodes(m) n order by 1, 2").collect()
    assert [(r.page, r.node_id, r.parent_id) for r in rows] == [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 0)] and "password" in rows[3].flags


def test_rules_of_an_app_drop_subtrees(spark):
    rows = [(1, "map", "0", "page"), (1, "map", "0.0", "advert"), (1, "map", "0.0.0", "below"), (1, "map", "0.1", "route"), (2, "map", "0", "advert"), (3, "chat", "0", "advert")]
    nodes = spark.createDataFrame(rows, "page int, app string, path string, key string")
    rules = spark.createDataFrame([("map", "route", "advert"), ("chat", None, "none")], "app string, on_page string, drop string")
    assert sorted((r.page, r.path) for r in uitree.drop_by_rules(nodes, rules, "page").collect()) == [(1, "0"), (1, "0.1"), (2, "0"), (3, "0")]


def test_mirror_keeps_status(spark, tmp_path):
    for name, body in (("a/x.png", b"1"), ("a/bad.png", b"2"), ("b.txt", b"3")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)

    def masked(raw):
        if raw == b"2":
            raise ValueError("unreadable")
        return raw + b"masked"

    source = files.read_files(spark, str(tmp_path / "in"))
    got = {r.relative: (r.status, r.error) for r in files.mirror(source, str(tmp_path / "out"), masked).collect()}
    assert got == {"a/x.png": ("masked", None), "a/bad.png": ("copied_after_error", "unreadable"), "b.txt": ("copied", None)}
    assert (tmp_path / "out/a/x.png").read_bytes() == b"1masked" and (tmp_path / "out/a/bad.png").read_bytes() == b"2"
    got = {r.relative: r.status for r in files.mirror(source, str(tmp_path / "safe"), masked, keep_failed=False).collect()}
    assert got["a/bad.png"] == "failed" and not (tmp_path / "safe/a/bad.png").exists()


def test_sinks_are_read_back(spark, tmp_path):
    known = spark.createDataFrame([("t", "Ann", "NAME", "NAME#1"), ("t", "Bo", "NAME", "NAME#2"), ("u", "Cy", "NAME", "NAME#3")], "task string, value string, label string, token string")
    files.write_mappings(known.coalesce(1), str(tmp_path / "maps"))
    lines = files.read_mapping_lines(spark, str(tmp_path / "maps"))
    assert sorted(tuple(r) for r in lines.collect()) == [("t", "NAME#1", "Ann", "NAME"), ("t", "NAME#2", "Bo", "NAME"), ("u", "NAME#3", "Cy", "NAME")]
    assert len(lines.inputFiles()) >= 2 and all("task_dir=u" in r.f for r in lines.filter("task_dir = 'u'").select(F.input_file_name().alias("f")).collect())
    stats = spark.createDataFrame([("t", "text", 9, 3, 1, 2.0), ("t", "xml", 5, None, 0, 1.0)], "task_dir string, type string, original_length int, anonymized_chars_count int, num_tokens int, timestamp double")
    files.write_stats(stats, str(tmp_path / "stats"))
    assert sorted((r.type, r.total_records, r.masked_chars) for r in files.read_stat_lines(spark, str(tmp_path / "stats")).collect()) == [("text", 2, 3), ("xml", 2, 0)]


def test_ranks_of_hot_and_null_groups(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int")
    want: dict = {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(k)
    for r in ranks.ranked(df, "g", "k").collect():
        assert want[r.g][r._rank] == r.k and r._size == len(want[r.g])
    for n in (1, 4, 7, 2000):
        chunks = {(r.g, r.k): r.chunk for r in work.even_chunks(df, "g", "k", n).collect()}
        for g, keys in want.items():
            q, m = divmod(len(keys), n)
            assert [chunks[g, k] for k in keys] == [c + 1 for c in range(n) for _ in range(q + (c < m))]


def test_values_are_normalised_once(spark):
    """The plan of the rule judge names the prediction once, however many candidates and variants there are."""
    df = spark.createDataFrame([("Tap the OK button", "ok")], "p string, t string")
    plan = df.select(qa.rule_judge(F.col("p"), F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bp#\d+", plan.split("LogicalRDD")[0].split("LocalRelation")[0])) == 1


def test_pages_are_parsed_in_bounded_batches(spark):
    """A worker's memory depends on a batch of markup and on BATCH_NODES rows, not on the number of pages."""
    df = spark.createDataFrame([(1, "<a>" + "<b></b>" * 4500 + "</a>"), (2, None), (3, "<c/>")], "page int, m string").coalesce(1)
    nodes = uitree.ui_nodes(df, "page", "m")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 2 << 20
    assert sorted((r.page, r.node_id) for r in nodes.collect()) == [*((1, i) for i in range(4501)), (3, 0)]
