"""Queries that take all rows of their tables, against their SQL."""

import duckdb

from veilframe.plans import queries as plans


def over(spark, tmp_path, name, tables):
    """Rows of a query over tables {name: (ddl, rows)}, sorted."""
    for table, (ddl, rows) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    return sorted(tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).collect())


def whole_sql(tmp_path, name, tables):
    """Rows of a query's SQL, sorted."""
    sql = plans.oracle_sql()[name]
    with duckdb.connect() as db:
        for table in tables:
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        return sorted(db.execute(sql).fetchall())


def test_grid_cells_of_every_part(spark, tmp_path):
    tables = {"part": ("p_partkey long, p_size int", [(i, i % 50 + 1) for i in range(1, 41)])}
    got = over(spark, tmp_path, "q48_grid_cells", tables)
    assert {r[0] for r in got} == set(range(1, 41))
    assert got == whole_sql(tmp_path, "q48_grid_cells", tables)


def test_every_turn_but_the_prompt_is_tested(spark, tmp_path):
    texts = ["go to Rome now", "ask Ann in Rome", "Toronto and Bonn", "see promenade", "nowhere else", None, "Bonn now"]
    tables = {"conversations": ("conv_id long, turn long, text string", [(c, t, x) for c in range(3) for t, x in enumerate(texts) if (c, t) != (2, 0)])}
    got = over(spark, tmp_path, "q11_whitelist_exempt", tables)
    assert {r[1] for r in got} == {1, 2, 3, 4, 6}
    assert got == whole_sql(tmp_path, "q11_whitelist_exempt", tables)


def test_every_item_is_judged_whole(spark, tmp_path):
    items = [(i, f"Item number{i} opens with words\nand the ending is finale{i}.") for i in range(50)]
    docs = [(i, [f"Says {items[i % 50][1].upper()} and more", items[i % 50][1][:24] + " only", f"finale{i % 50} ending and number{i % 50} Item opens with words is", "nothing"][i // 50 % 4]) for i in range(400)]
    tables = {"benchmark": ("item_id long, text string", items), "documents": ("doc_id long, text string", docs)}
    got = over(spark, tmp_path, "q24_rule_judge", tables)
    assert {r[1] for r in got} == set(range(50)) and len(got) == 400
    assert {r[2] for r in got if r[0] % 200 // 50 == 1 and r[0] % 3} == {False}  # the first 24 characters are not the answer
    assert got == whole_sql(tmp_path, "q24_rule_judge", tables)


def test_every_item_is_scored(spark, tmp_path):
    items = [(3 * i, f"item number{i} has five words") for i in range(90)] + [(None, "no id")]
    turns = [(i, 1, "assistant", items[i % 90][1]) for i in range(120)] + [(200, 1, "user", "no")]
    got = over(spark, tmp_path, "q29_rouge_bleu", {"benchmark": ("item_id long, text string", items), "conversations": ("conv_id long, turn long, role string, text string", turns)})
    assert got == [(i, 1, 3 * (i % 90), 1.0, 1.0) for i in range(120)]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _same(spark, tmp_path, name, tables):
    """A query's rows, which its SQL gives too."""
    key = lambda rows: sorted(rows, key=repr)
    for table, (ddl, rows) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    df = plans.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        for table in tables:
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        found = db.execute(plans.oracle_sql()[name])
        want = [dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert key(sorted(r.items()) for r in got) == key(sorted(r.items()) for r in want)
    return got


def test_steps_of_every_kind_are_written_and_read(spark, tmp_path):
    from datetime import datetime

    kinds = ["click", "view", "unheard of", "a/b=c d%", "Größe", None]
    rows = [(i, datetime(2024, 1, 1), i % 7, kinds[i % 6], i / 3) for i in range(600)]
    got = _same(spark, tmp_path, "q65_trace_files", {"events": (EVENTS, rows)})
    assert sum(r["steps"] for r in got) == 600 and {r["run"] for r in got} == {*(f"app_{k}_run" for k in kinds if k), None}


def test_questions_of_every_app_are_written_and_read(spark, tmp_path):
    langs = ["de", "en", "xx", "a/b", None]
    rows = [(i, "t", langs[i % 5], [f"src{i % 3}", "odd: source", None][i % 3], 3) for i in range(200)]
    got = _same(spark, tmp_path, "q68_question_files", {"documents": ("doc_id long, text string, lang string, source string, n_chars long", rows)})
    assert len(got) == 200 and {r["app"] for r in got} == set(langs)


def test_every_source_has_a_column(spark, tmp_path):
    rows = [(i, "t", ["de", None][i % 2], ["src0", "odd source", None][i % 3], 3) for i in range(60)]
    tables = {"documents": ("doc_id long, text string, lang string, source string, n_chars long", rows), "labels": ("doc_id long, quality int, toxic int", [(i, 1, 0) for i in range(60)])}
    got = _same(spark, tmp_path, "q21_leaderboard_detail", tables)
    assert sum(v for r in got for k, v in r.items() if k != "agent") == 60 and set(got[0]) == {"agent", "src0", "odd source", "none"}


def test_every_outcome_is_merged(spark, tmp_path):
    orders = [(i, i % 20, "FOPX"[i % 4] if i % 9 else None) for i in range(200)]
    got = _same(spark, tmp_path, "q22_incomplete_merge", {"orders": ("o_orderkey long, o_custkey long, o_orderstatus string", orders)})
    assert len([r for r in got if r["status"] == "max_step"]) == len([o for o in orders if o[2] == "O"])


def test_records_of_every_task_are_lines(spark, tmp_path):
    rows = [(i, f"mail a{i % 11}@ex.org or 415 555 01{i % 90 + 10}", ["de", None, "qq"][i % 3], ["src0", "new source", None][i % 3], 40) for i in range(300)]
    docs = {"documents": ("doc_id long, text string, lang string, source string, n_chars long", rows)}
    got = _same(spark, tmp_path / "stats", "q67_stats_files", docs)
    assert sum(r["records"] for r in got) == 300 and {r["task_dir"] for r in got} == {"src0", "new source", None}
    assert {r["task"] for r in _same(spark, tmp_path / "maps", "q66_mapping_files", docs)} == {"src0", "new source", None}
