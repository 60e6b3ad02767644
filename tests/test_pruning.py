"""App rules on pages made of markup."""

import duckdb
import pytest

from veilframe.operators import pruning, uitree
from veilframe.plans import queries as plans


def _left(spark, pages):
    """{page: texts or classes that are left} of [(page, app, markup)]."""
    df = spark.createDataFrame(pages, "page long, app string, html string")
    nodes = uitree.ui_nodes(df, "page", "html")
    kept = pruning.prune_by_rules(nodes, pruning.page_rules(df, pruning.app_rules(spark), "page", "app", "html"), "page")
    out = {}
    for r in kept.orderBy("page", "node_id").collect():
        out.setdefault(r.page, []).append(r.text or r.note or r.tag)
    return out


def _node(tag, inner="", **a):
    said = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in a.items())
    return f"<{tag}{said}>{inner}</{tag}>"


def test_rules_of_three_apps(spark):
    search = _node("r", _node("top", _node("x", text="清空") + _node("n", text="排序")) + _node("gone", _node("n", text="类型")) + _node("gone", text="时间 范围"))
    route = _node("r", _node("a", _node("b", _node("c", text="收起") + _node("n", text="驾车"))) + _node("gone", text="火车 步行"))
    home = _node("r", _node("p", _node("x", text="搜索框") , bounds="[0,0][10,10]") + _node("gone", text="我的 消息", bounds="[5,5][20,20]") + _node("stays", text="购物车 扫一扫", bounds="[10,10][20,20]"))
    service = _node("r", _node("a", _node("b", _node("c", _node("x", text="全部服务")))) + _node("gone", text="全部服务") + _node("stays", text="other"))
    feed = _node("r", _node("n", text="朋友圈 拍照分享") + '<i class="ImageView" NAF="true"></i><j class="TextView" NAF="true"></j>')
    pages = [
        (1, pruning.CHAT, search), (2, pruning.MAPS, route), (3, pruning.SHOP, home), (4, pruning.SHOP, service), (5, pruning.CHAT, feed), (6, "other.app", search),
        (7, pruning.SHOP, service.replace('text="全部服务"', 'text="x"', 1)), (8, None, None), (9, pruning.CHAT, _node("x", text="清空 排序 类型 时间 范围")),
    ]
    got = _left(spark, pages)
    assert got[1] == ["r", "top", "清空", "排序"]
    assert got[2] == ["r", "a", "b", "收起", "驾车"]
    assert got[3] == ["r", "p", "搜索框", "购物车 扫一扫"]
    assert got[4] == ["r", "a", "b", "c", "全部服务", "other"]
    assert got[5] == ["r", "朋友圈 拍照分享", pruning.NOTES["ImageView"], "j"]
    assert got[6] == ["r", "top", "清空", "排序", "gone", "类型", "时间 范围"]  # no rule for the app
    assert got[7] == ["r", "a", "b", "c", "x", "全部服务", "other"]  # the word is there once only
    assert got[9] == ["清空 排序 类型 时间 范围"] and 8 not in got


def test_filter_pages_lose_what_follows_and_the_largest_list(spark):
    deep = _node("x", text="品牌")
    for i in range(9):
        deep = _node(f"l{i}", deep)
    lists = _node("a", _node("small", scrollable="true", **{"class": "a.RecyclerView"}, bounds="[0,0][2,2]") + _node("large", _node("in", text="宾客类型"), scrollable="true", **{"class": "a.RecyclerView"}, bounds="[0,0][9,9]"))
    page = _node("r", deep + _node("gone", text="特色主题") + _node("gone") + lists)
    assert _left(spark, [(1, pruning.MAPS, page)])[1] == ["r", *(f"l{i}" for i in range(8, -1, -1)), "品牌", "a", "small"]


def test_menu_items_behind_tabs(spark):
    tabs = "".join(_node("t", text=w, bounds=f"[{20 * i},90][{20 * i + 10},100]", selected="true" if i == 0 else "false") for i, w in enumerate(("微信", "通讯录", "发现", "我")))
    items = _node("list", _node("i", text="over", bounds="[0,80][100,95]") + _node("i", text="clear", bounds="[0,0][100,80]"), **{"class": "x.ListView"})
    assert _left(spark, [(1, pruning.CHAT, _node("r", _node("body", items) + _node("bar", tabs)))])[1] == ["r", "body", "list", "clear", "bar", "微信", "通讯录", "发现", "我"]


def test_unknown_action_raises(spark):
    with pytest.raises(ValueError, match="no action"):
        pruning.app_rules(spark, [("a", "p", ["w"], [("w", False, 1)], "explode")])


def test_every_rule_against_sql(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(120)], "page_id long").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(plans.oracle_sql()["q72_app_pruning"]).fetchall()
    got = [tuple(r) for r in plans.queries()["q72_app_pruning"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) < 120 * 83
