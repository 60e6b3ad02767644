"""App-specific pruning: rules, as rows, that recognise a page by words of its markup and drop what covers or follows a place
found by its text.

A page is an array of nodes with interval labels (pre, last), so ancestors, subtrees and siblings are comparisons of numbers.
An anchor is found by text or description (of several the lower one, or where a rule says so the upper one), a number of levels
above it stands the node that a rule works on, and a rule's action names the nodes to drop with all that is below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import once
from .uitree import parse_box

RULE = "app string, ord int, page string, words array<struct<word:string,times:int>>, anchors array<struct<text:string,part:boolean,levels:int>>, upper boolean, action string"
#: next_one, next_two: the siblings after the node; rest: all after it; others: all but it; touching: those whose box meets its own;
#: inside: what lies wholly in its box, in such siblings; menu: list items behind a bar of tabs; note: nodes get a description.
ACTIONS = ("next_one", "next_two_and_scroller", "rest", "others", "touching", "inside", "menu", "note")

# Apps, the words of their pages, and the texts of anchors with the levels above them.
MAPS, CHAT, SHOP = "com.autonavi.minimap", "com.tencent.mm", "com.sankuai.meituan"
PAGES = [
    (MAPS, "推荐排序", ["距离优先", "推荐排序", "好评优先"], [("距离优先", False, 14)], "next_two_and_scroller"),
    (MAPS, "位置距离", ["距离", "km内"], [("km内", True, 8)], "next_two_and_scroller"),
    (MAPS, "全部分类", ["烤肉", "烧烤", "螺蛳粉"], [("烤肉", False, 14), ("火锅", False, 14)], "next_two_and_scroller"),
    (MAPS, "全部分类", ["烤肉", "烧烤", "蛋糕店"], [("烤肉", False, 14), ("火锅", False, 14)], "next_two_and_scroller"),
    (MAPS, "全部分类", ["水产海鲜", "火锅", "熟食"], [("烤肉", False, 14), ("火锅", False, 14)], "next_two_and_scroller"),
    (MAPS, "全部分类", ["水产海鲜", "火锅", "早餐"], [("烤肉", False, 14), ("火锅", False, 14)], "next_two_and_scroller"),
    (MAPS, "星级酒店", ["星级(可多选)", "价格"], [("星级(可多选)", False, 10)], "next_two_and_scroller"),
    (MAPS, "更多筛选", ["品牌", "宾客类型", "特色主题"], [("品牌", False, 9)], "next_two_and_scroller"),
    (MAPS, "油类型", ["92#", "95#", "98#", "0#"], [("95#", False, 14)], "next_two_and_scroller"),
    (MAPS, "全部品牌", ["全部品牌", "中国石化", "中国石油", "壳牌"], [("全部品牌", False, 14)], "next_two_and_scroller"),
    (MAPS, "出行方式", ["驾车", "火车", "步行", "收起"], [("收起", False, 2)], "others"),
    (MAPS, "选择日期", ["选择日期", "日", "一", "二", "三", "四", "五", "六"], [("选择日期", False, 5)], "others"),
    (MAPS, "选择出发时间", ["选择出发时间弹窗", "现在出发"], [("选择出发时间", False, 5)], "others"),
    (MAPS, "选择出发时间_taxi", ["选择出发时间", "确定"], [("选择出发时间", False, 3)], "others"),
    (MAPS, "周边收藏", ["周边", "收藏", "分享", "打车"], [("收藏按钮", True, 3)], "inside"),
    (CHAT, "搜索-全部", ["排序", "类型", "时间", "范围"], [("清空", False, 1)], "rest"),
    (CHAT, "朋友圈-全部", ["朋友圈", "拍照分享"], [], "note"),
    (CHAT, "朋友圈-全部", ["轻触更换封面", "拍照分享"], [], "note"),
    (CHAT, "首页", ["微信", "通讯录", "发现", "我"], [("微信", False, 1), ("通讯录", False, 1), ("发现", False, 1), ("我", False, 1)], "menu"),
    (SHOP, "首页", ["我的", "消息", "购物车", "扫一扫"], [("搜索框", True, 1)], "touching"),
    (SHOP, "全部服务", ["全部服务", "全部服务"], [("全部服务", False, 3)], "next_one"),
    (SHOP, "全部地区", ["全部地区", "全部地区"], [("全部地区", False, 3)], "next_one"),
    (SHOP, "综合排序", ["综合排序", "综合排序"], [("综合排序", False, 3)], "rest_upper"),
    (SHOP, "筛选", ["商家品质", "价格", "营业状态"], [("综合排序", False, 3)], "rest_upper"),
]
# What unlabelled pictures and rows of a feed offer, by class.
NOTES = {"ImageView": "选项：点赞/评论", "RelativeLayout": "选项：广告屏蔽"}


def app_rules(spark: SparkSession, pages: list[tuple] | None = None) -> DataFrame:
    """Rules as a table; the first of an app whose words a page has decides. A word that is listed twice must be there twice."""
    rows = []
    for i, (app, page, words, anchors, action) in enumerate(PAGES if pages is None else pages):
        if action.removesuffix("_upper") not in ACTIONS:
            raise ValueError(f"no action of this name: {action}")
        rows.append((app, i, page, [(w, words.count(w)) for w in dict.fromkeys(words)], anchors, action.endswith("_upper"), action.removesuffix("_upper")))
    return spark.createDataFrame(rows, RULE)


def page_rules(pages: DataFrame, rules: DataFrame, page: str, app: str, markup: str) -> DataFrame:
    """(page, rule) of the pages (page, app, markup) that a rule recognises. Rules are few and collected into one row an app."""
    own = rules.groupBy(F.col("app").alias(app)).agg(F.array_sort(F.collect_list(F.struct("ord", "page", "words", "anchors", "upper", "action"))).alias("_rules"))
    count = lambda w: (F.length(markup) - F.length(F.replace(F.col(markup), w["word"], F.lit("")))) / F.length(w["word"])
    fits = F.filter("_rules", lambda r: F.forall(r["words"], lambda w: F.contains(F.col(markup), w["word"]) & (count(w) >= w["times"])))
    return pages.join(F.broadcast(own), app).withColumn("rule", F.get(fits, 0)).filter("rule is not null").select(page, "rule")


def _meets(a: Column, b: Column) -> Column:
    return F.coalesce((a["x1"] < b["x2"]) & (a["x2"] > b["x1"]) & (a["y1"] < b["y2"]) & (a["y2"] > b["y1"]), F.lit(False))


def _inside(a: Column, b: Column) -> Column:
    return F.coalesce((a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] <= b["x2"]) & (a["y2"] <= b["y2"]), F.lit(False))


def _below(a: Column, b: Column) -> Column:
    """Whether b lies lower than a by both its edges."""
    return F.coalesce((a["y1"] < b["y1"]) & (a["y2"] < b["y2"]), F.lit(False))


def _fits(n: Column, anchor: Column) -> Column:
    equal = (n["text"] == anchor["text"]) | (n["content_desc"] == anchor["text"])
    return F.when(anchor["part"], F.contains(n["text"], anchor["text"]) | F.contains(n["content_desc"], anchor["text"])).otherwise(equal)


def _anchor(nodes: Column, rule: Column) -> Column:
    """struct(node, levels) of the anchor: of those that fit the last that lies beyond the one before it; null if none fits."""
    found = F.filter(F.transform(nodes, lambda n: F.struct(n.alias("node"), F.get(F.filter(rule["anchors"], lambda a: _fits(n, a)), 0)["levels"].alias("levels"))), lambda x: x["levels"].isNotNull())
    beyond = lambda a, x: F.when(rule["upper"], _below(x["node"]["box"], a["node"]["box"])).otherwise(_below(a["node"]["box"], x["node"]["box"]))
    return once(found, lambda xs: F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, 0), lambda a, x: F.when(beyond(a, x), x).otherwise(a)))


def _above(nodes: Column, node: Column, levels: Column) -> Column:
    """The ancestor so many levels above a node; null if there is none."""
    return F.get(F.filter(nodes, lambda n: (n["depth"] == node["depth"] - levels) & (n["pre"] <= node["pre"]) & (node["pre"] <= n["last"])), 0)


def _siblings(nodes: Column, node: Column) -> Column:
    return F.filter(nodes, lambda n: n["parent"] == node["parent"])


def _area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def _places(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["pre"])


def _scroller(nodes: Column) -> Column:
    """The place of the largest list that scrolls, if it is not the top (of equal ones the first)."""
    lists = F.filter(nodes, lambda n: F.contains(n["class"], F.lit("RecyclerView")) & n["scrolls"] & (F.coalesce(_area(n["box"]), F.lit(0)) > 0))
    largest = F.array_max(F.transform(lists, lambda n: F.struct(_area(n["box"]).alias("area"), (-n["pre"]).alias("first"), n["parent"].alias("parent"))))
    return F.when(largest["parent"].isNotNull(), F.array(-largest["first"]))


def _menu(nodes: Column, rule: Column) -> Column:
    """Items of the first list in the bar's first part that stand behind a tab. A tab is the lowest node of its text."""
    tabs = F.transform(rule["anchors"], lambda a: F.struct(_anchor(nodes, F.struct(F.array(a).alias("anchors"), F.lit(False).alias("upper")))["node"].alias("n")))
    tabs = F.filter(tabs, lambda t: t["n"].isNotNull())

    def behind(ts):
        idle = F.get(F.filter(F.array_sort(F.transform(ts, lambda t: F.struct(t["n"]["pre"].alias("pre"), t["n"].alias("n")))), lambda t: ~t["n"]["chosen"]), 0)["n"]
        first = lambda bar: F.get(F.filter(nodes, lambda n: n["parent"] == bar["pre"]), 0)
        lists = lambda part: F.filter(nodes, lambda n: (n["pre"] >= part["pre"]) & (n["pre"] <= part["last"]) & (F.contains(n["class"], F.lit("ListView")) | F.contains(n["class"], F.lit("RecyclerView"))))
        items = lambda shown: _places(F.filter(nodes, lambda n: (n["parent"] == shown["pre"]) & F.exists(ts, lambda t: _meets(n["box"], t["n"]["box"]))))
        bar = once(idle, lambda x: _above(nodes, x, F.lit(2)))
        return once(bar, lambda x: once(first(x), lambda y: once(F.get(lists(y), 0), items)))

    return once(tabs, behind)


def _drops(nodes: Column, rule: Column) -> Column:
    """Places whose subtrees a rule drops."""
    none = F.expr("cast(array() as array<int>)")

    def of(node):
        after = lambda: F.filter(_siblings(nodes, node), lambda n: n["pre"] > node["pre"])
        touching = lambda: F.filter(_siblings(nodes, node), lambda n: (n["pre"] != node["pre"]) & _meets(n["box"], node["box"]))
        inside = once(touching(), lambda ss: F.filter(nodes, lambda n: _inside(n["box"], node["box"]) & F.exists(ss, lambda s: (s["pre"] <= n["pre"]) & (n["pre"] <= s["last"]))))
        two = F.concat(F.slice(_places(after()), 1, 2), F.coalesce(_scroller(nodes), none))
        choice = {"next_one": F.slice(_places(after()), 1, 1), "next_two_and_scroller": two, "rest": _places(after()), "touching": _places(touching()), "inside": _places(inside)}
        out = F.when(rule["action"] == "others", _places(F.filter(_siblings(nodes, node), lambda n: n["pre"] != node["pre"])))
        for name, drops in choice.items():
            out = out.when(rule["action"] == name, drops)
        return F.when(node.isNotNull(), out)

    anchored = once(_anchor(nodes, rule), lambda a: once(_above(nodes, a["node"], a["levels"]), of))
    return F.coalesce(F.when(rule["action"] == "note", none).when(rule["action"] == "menu", _menu(nodes, rule)).otherwise(anchored), none)


def prune_by_rules(nodes: DataFrame, recognised: DataFrame, page: str) -> DataFrame:
    """nodes (page, node_id, last_id, parent_id, depth, text, content_desc, class, bounds, flags, ...) without what the rule of their page
    drops, and with note, what a rule says of a node without a label. recognised: (page, rule), as page_rules gives; other pages
    stay whole, as do those without the rule's anchor or without enough levels above it. Nodes without bounds meet nothing. Pages meet
    their nodes once; a page is one document."""
    one = F.struct(
        F.col("node_id").alias("pre"), F.col("last_id").alias("last"), F.col("parent_id").alias("parent"), "depth", "text", "content_desc", "class", parse_box(F.col("bounds")).alias("box"),
        F.array_contains("flags", "scrollable").alias("scrolls"), F.array_contains("flags", "selected").alias("chosen"),
    )
    held = nodes.join(recognised.select(page), page, "left_semi").groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("at"), one.alias("n")))).alias("_nodes"))
    places = F.transform("_nodes", lambda x: x["n"])
    ranges = once(places, lambda ns: F.transform(_drops(ns, F.col("rule")), lambda d: F.struct(d.alias("s"), F.get(F.filter(ns, lambda n: n["pre"] == d), 0)["last"].alias("e"))))
    drops = held.join(recognised, page).select(page, ranges.alias("_drops"), (F.col("rule.action") == "note").alias("_notes"))
    names = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    note = F.when(F.col("_notes") & F.array_contains("flags", "naf"), F.try_element_at(names, F.col("class")))
    kept = nodes.join(drops, page, "left").filter(~F.coalesce(F.exists("_drops", lambda r: F.col("node_id").between(r["s"], r["e"])), F.lit(False)))
    return kept.withColumn("note", note).drop("_drops", "_notes")
