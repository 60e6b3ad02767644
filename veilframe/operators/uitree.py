"""UI trees: markup to node rows, pruning, searches, boxes."""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import first_words
from ..plans.storage import small_batches

NODE = "node_id int, parent_id int, last_id int, ord int, depth int, path string, tag string, class string, resource_id string, text string, content_desc string, bounds string, actions array<string>, status array<string>, flags array<string>, xpath string"
#: Attributes that make a node worth keeping, and the words they read as.
ACTIONS = {"clickable": "click", "long-clickable": "long-click", "scrollable": "scroll", "focusable": "focus"}
STATUS = ("checked", "selected", "focused", "password")
FLAGS = ("naf", "checkable", "checked", "clickable", "enabled", "focusable", "focused", "scrollable", "long-clickable", "password", "selected")
DESCRIBED = {"clickable": "click ", "scrollable": "scroll ", "long-clickable": "long-click ", "checkable": "check "}
LAYOUTS = ("View", "FrameLayout", "LinearLayout", "RelativeLayout")
CLOCK_FACE = "material_clock_face"
#: Nodes of an Arrow batch.
BATCH_NODES = 2000
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.children: Counter = Counter()
        self.kinds: Counter = Counter()  # children of a parent by kind

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else None
        i, at = len(self.nodes), self.children[parent]
        self.children[parent] += 1
        kind = a.get("class") or tag
        self.kinds[parent, kind] += 1
        same = self.kinds[parent, kind]
        base = self.nodes[parent] if parent is not None else None
        self.nodes.append(
            {
                "node_id": i, "parent_id": parent, "ord": at, "depth": base["depth"] + 1 if base else 0, "path": f"{base['path']}.{at:05d}" if base else f"{at:05d}",
                "tag": tag, "class": a.get("class", ""), "resource_id": a.get("resource-id", a.get("id", "")), "text": a.get("text", ""), "content_desc": a.get("content-desc", a.get("alt", "")),
                "bounds": a.get("bounds", ""), "actions": [w for k, w in ACTIONS.items() if a.get(k) == "true"] or (["click"] if tag in ("a", "button") else []),
                "status": [k for k in STATUS if a.get(k) == "true"],
                "flags": [k for k in FLAGS if a.get(k) == "true"] + ([CLOCK_FACE] if base and CLOCK_FACE in base["resource_id"] else []), "xpath": f"{base['xpath'] if base else ''}/{kind}[{same}]",
            }
        )
        if tag not in _VOID:
            self.open.append(i)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            n = self.nodes[self.open[-1]]
            n["text"] = f"{n['text']} {' '.join(data.split())}".strip()


def parse_nodes(markup: str | None) -> list[dict]:
    """Nodes in page order, from XML or from markup that is not well formed."""
    p = _Tree()
    p.feed(markup or "")
    p.close()
    for n in p.nodes:
        n["tag"], n["last_id"] = n["tag"].lower(), n["node_id"]
    for n in reversed(p.nodes):  # the last node below each: children come after their parents
        if n["parent_id"] is not None:
            up = p.nodes[n["parent_id"]]
            up["last_id"] = max(up["last_id"], n["last_id"])
    return p.nodes


def _node_rows(df: DataFrame, page: str, markup: str, nodes_of) -> DataFrame:
    """A row for each of nodes_of(markup), of each page. A worker reads small batches and hands nodes on by BATCH_NODES, so it holds a
    batch of markup, one page's nodes and BATCH_NODES rows, however many pages there are."""
    small_batches(df.sparkSession)
    ddl = f"{page} {dict(df.dtypes)[page]}, {NODE}"
    types = to_arrow_schema(T.StructType.fromDDL(ddl))
    names = [f.split()[0] for f in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            for i, m in zip(b.column(0), b.column(1)):
                key = i.as_py()
                for n in nodes_of(m.as_py()):
                    held.append((key, *(n[f] for f in names)))
                    if len(held) == BATCH_NODES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.types)], schema=types)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.types)], schema=types)

    return df.select(page, markup).mapInArrow(run, ddl)


def ui_nodes(df: DataFrame, page: str, markup: str) -> DataFrame:
    """One row per node of each page's markup, parsed in Arrow batches. The nodes below one have the places (node_id) after its own
    up to last_id."""
    return _node_rows(df, page, markup, parse_nodes)


def _flag(name: str, text: str) -> Column:
    return F.when(F.array_contains("flags", name), text).otherwise("")


def words_of() -> Column:
    """What a node says: its text and its description, a space after each."""
    each = lambda c: F.when(F.col(c) != "", F.concat(c, F.lit(" "))).otherwise("")
    return F.concat(each("text"), each("content_desc"))


def action_of() -> Column:
    """What a node offers: a word and a space for each; focusable only where there is nothing else."""
    words = F.concat(*(_flag(k, v) for k, v in DESCRIBED.items()))
    return F.concat(F.when((words == "") & F.array_contains("flags", "focusable"), "focusable ").otherwise(words), _flag(CLOCK_FACE, "click"))


def kind_of() -> Column:
    """The last part of a node's class, empty for mere layouts; the tag of a node without a class."""
    last = F.substring_index("class", ".", -1)
    return F.when(F.col("class") == "", F.col("tag")).when(last.isin(*LAYOUTS), "").otherwise(last)


def key_of() -> Column:
    """A node's description line: class ;action; status ;extended;text."""
    kind = kind_of()
    status = F.concat(*(_flag(k, f"{k} ") for k in ("checked", "password", "selected")), F.when(F.array_contains("flags", "checkable") & ~F.array_contains("flags", "checked"), "unchecked ").otherwise(""))
    extended = F.concat(_flag("password", " you can input password, "), _flag("selected", " selected, "))
    line = F.concat(F.when(kind != "", F.concat(kind, F.lit(" "))).otherwise(""), F.lit(";"), action_of(), F.lit("; "), status, F.lit(";"), extended, F.lit(";"), words_of())
    return F.replace(line, F.lit("\n"), F.lit(""))


def derived(nodes: DataFrame) -> DataFrame:
    """nodes with what is made of their attributes: words, name (ten words of the text or description, and the class), kind,
    id_suffix (of the resource id, empty without one), action and key."""
    last = F.substring_index("class", ".", -1)
    said = F.when(F.col("text") != "", F.col("text")).when(F.col("content_desc") != "", F.col("content_desc"))
    name = F.when(F.col("class") != "", F.concat_ws(" ", F.when(said.isNotNull(), first_words(said)), last)).otherwise("")
    suffix = F.when(F.contains("resource_id", F.lit(":id/")), F.substring(F.col("resource_id"), F.locate(":id/", F.col("resource_id")) + 4, F.length("resource_id"))).otherwise("")
    return nodes.withColumns({"words": words_of(), "name": name, "kind": kind_of(), "id_suffix": suffix, "action": action_of(), "key": key_of()})


@F.udtf(returnType=NODE)
class UiNodes:
    """The nodes of one page's markup, for SQL: select * from pages, lateral ui_nodes(html)."""

    def eval(self, markup: str):
        for n in parse_nodes(markup):
            yield tuple(n[f.split()[0]] for f in NODE.split(", "))


def register_ui_nodes(spark: SparkSession, name: str = "ui_nodes") -> None:
    spark.udtf.register(name, UiNodes)


def parse_box(bounds: Column) -> Column:
    """[x1,y1][x2,y2], also negative, as a struct; null if it is not that."""
    n = [F.regexp_extract(bounds, r"^\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]$", i) for i in range(1, 5)]
    box = F.struct(*(x.try_cast("int").alias(k) for x, k in zip(n, ("x1", "y1", "x2", "y2"))))
    return F.when(n[0] != "", box)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def format_box(b: Column) -> Column:
    return F.format_string("[%d,%d][%d,%d]", b["x1"], b["y1"], b["x2"], b["y2"])


def valid(b: Column) -> Column:
    return (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x1"] <= inner["x1"]) & (outer["y1"] <= inner["y1"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def point_in(x: Column, y: Column, b: Column, slack: int = 0) -> Column:
    return (x >= b["x1"] - slack) & (x <= b["x2"] + slack) & (y >= b["y1"] - slack) & (y <= b["y2"] + slack)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def center(b: Column) -> Column:
    return F.struct(F.floor((b["x1"] + b["x2"]) / 2).alias("x"), F.floor((b["y1"] + b["y2"]) / 2).alias("y"))


def distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def attribute_counts(nodes: DataFrame, page: str) -> DataFrame:
    """How often each value of each attribute occurs on a page."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in ("tag", "resource_id", "text", "class", "content_desc")]))
    return nodes.select(page, pairs.alias("p")).filter("p.value <> ''").groupBy(page, "p.attribute", "p.value").count()


def find_nodes(nodes: DataFrame, page: str, key: str, needle: str) -> DataFrame:
    """Topmost nodes whose key contains needle: those below another match are left out."""
    hits = nodes.filter(F.contains(F.col(key), F.lit(needle)))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), 1, i), "."))
    ancestors = hits.select(page, "node_id", F.explode(above).alias("_up"), "path").filter("_up <> path")
    covered = ancestors.join(hits.select(page, F.col("path").alias("_up")), [page, "_up"]).select(page, "node_id").distinct()
    return hits.join(covered, [page, "node_id"], "left_anti")


def parents_of(nodes: DataFrame, page: str, key: str, needle: str) -> DataFrame:
    """(page, parent_id, first): parents with a matching child, and the first such child; a match at the root has none."""
    hits = nodes.filter(F.contains(F.col(key), F.lit(needle)) & F.col("parent_id").isNotNull())
    return hits.groupBy(page, "parent_id").agg(F.min_by("node_id", "ord").alias("first"))


def siblings_of(nodes: DataFrame, page: str, key: str, needle: str) -> DataFrame:
    """All children of the parents of matches, in order."""
    return nodes.join(parents_of(nodes, page, key, needle), [page, "parent_id"]).select(page, "parent_id", "node_id", "ord", key)


def prune(rows: list[dict]) -> list[dict]:
    """Nodes of one page worth keeping, their children moved up to the nearest kept one: dropped are nodes without area, those
    outside the parent, and those that neither do nor say anything."""
    import re

    def bounds(n):
        m = re.fullmatch(r"\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]", n["bounds"] or "")
        return tuple(map(int, m.groups())) if m else None

    kept: dict[int, dict] = {}
    up: dict[int, int | None] = {}
    for n in rows:  # top down
        parent = up.get(n["parent_id"], n["parent_id"]) if n["parent_id"] is not None else None
        b, p = bounds(n), bounds(kept[parent]) if parent in kept else None
        ok = b is None or (b[0] < b[2] and b[1] < b[3])
        if ok and b and p:
            ok = b[0] < p[2] and p[0] < b[2] and b[1] < p[3] and p[1] < b[3]
        ok = ok and bool(n["actions"] or n["status"] or n["text"] or n["content_desc"])
        if ok:
            kept[n["node_id"]] = {**n, "parent_id": parent}
            up[n["node_id"]] = n["node_id"]
        else:
            up[n["node_id"]] = parent
    return list(kept.values())


def drop_overlaps(rows: list[dict]) -> list[dict]:
    """Nodes of one page without those that a later sibling touches. What stands in such a node's place is, in order, every
    descendant that the sibling does not touch, down to the first on each branch, with all below it."""
    import re

    def bounds(n):
        m = re.fullmatch(r"\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]", n["bounds"] or "")
        return tuple(map(int, m.groups())) if m else None

    touch = lambda a, b: a and b and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    box = {n["node_id"]: bounds(n) for n in rows}
    up = {n["node_id"]: n["parent_id"] for n in rows}
    below: dict = {i: [] for i in [None, *up]}
    for i, parent in up.items():
        below[parent].append(i)

    def clear(node, over):
        found, stack = [], below[node][::-1]
        while stack:
            c = stack.pop()
            if touch(box[c], over):
                stack += below[c][::-1]
            else:
                found.append(c)
        return found

    queue = deque(below[None])
    while queue:  # by levels; what moves up waits behind what is there
        i = queue.popleft()
        level = below[up[i]]
        at = level.index(i)
        over = next((box[m] for m in level[at + 1 :] if touch(box[i], box[m])), None)
        if over is None:
            queue += below[i]
            continue
        level[at : at + 1] = found = clear(i, over)
        up |= dict.fromkeys(found, up[i])
        queue += found
    by_id, out, stack = {n["node_id"]: n for n in rows}, [], below[None][::-1]
    while stack:
        i = stack.pop()
        out.append({**by_id[i], "parent_id": up[i]})
        stack += below[i][::-1]
    return out


def compress(df: DataFrame, page: str, markup: str) -> DataFrame:
    """Node rows of each page after pruning and removal of overlaps; tags are places in page order."""
    return _node_rows(df, page, markup, lambda m: drop_overlaps(prune(parse_nodes(m))))


def drop_by_rules(nodes: DataFrame, rules: DataFrame, page: str) -> DataFrame:
    """nodes (page, app, path, key) without the subtrees that an app's rules name: rules (app, on_page, drop) drop the nodes
    whose key contains drop, on pages where some key contains on_page (null: on all). Pages without a rule stay whole."""
    pages = nodes.select(page, "app", "key").join(rules.filter("on_page is not null"), "app").filter(F.contains("key", F.col("on_page"))).select(page, "drop").distinct()
    pages = pages.unionByName(nodes.select(page, "app").distinct().join(rules.filter("on_page is null"), "app").select(page, "drop"))
    roots = nodes.select(page, "path", "key").join(pages, page).filter(F.contains("key", F.col("drop"))).select(page, F.col("path").alias("_up")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), 1, i), "."))
    gone = nodes.select(page, "path", F.explode(above).alias("_up")).join(roots, [page, "_up"], "left_semi").select(page, "path").distinct()
    return nodes.join(gone, [page, "path"], "left_anti")


def bounds_listing(nodes: DataFrame, page: str, key: str = "key") -> DataFrame:
    """(page, node_id, key, full, bounds) of the nodes that have bounds; full: the keys from the top down to the node."""
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), 1, i), "."))
    own = nodes.filter("bounds <> ''").select(page, "node_id", F.trim(key).alias("key"), "bounds", F.explode(above).alias("_up"))
    lines = own.join(nodes.select(page, F.col("path").alias("_up"), F.trim(key).alias("_k")), [page, "_up"])
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_up", "_k"))), lambda x: x["_k"]), "/")
    return lines.groupBy(page, "node_id", "key", "bounds").agg(full.alias("full"))


@F.pandas_udf(T.StringType())
def _nested(lists: pd.Series) -> pd.Series:
    import json

    out = []
    for rows in lists:
        trees: dict = {None: {}}
        for r in rows:  # in page order, so parents come first
            trees[r["node_id"]] = made = {}
            (trees[r["parent_id"]] if r["parent_id"] in trees else trees[None])[r["line"]] = made
            if r["bounds"]:
                made["bounds"] = r["bounds"]
        out.append(json.dumps(trees[None], ensure_ascii=False))
    return pd.Series(out)


def tree_json(nodes: DataFrame, page: str) -> DataFrame:
    """(page, json): nested objects with '[n<id>] <description>' as keys, and bounds as strings."""
    line = F.concat(F.lit("[n"), F.col("node_id").cast("string"), F.lit("] "), key_of())
    rows = F.array_sort(F.collect_list(F.struct("path", "node_id", "parent_id", line.alias("line"), "bounds")))
    return nodes.groupBy(page).agg(rows.alias("rows")).select(page, _nested("rows").alias("json"))


def plain_text(nodes: DataFrame, page: str) -> DataFrame:
    """(page, text): one line per node, four spaces for each level."""
    line = F.concat(F.repeat(F.lit("    "), F.col("depth")), F.lit("[n"), F.col("node_id").cast("string"), F.lit("] "), key_of())
    return nodes.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def som_elements(nodes: DataFrame, page: str, near: int = 5, far: int = 10) -> DataFrame:
    """(page, label, node_id, kind): clickable nodes, then focusable ones, without those whose centre is within near pixels of
    a listed one, or, if focusable, within far pixels of a clickable one. One page is one group, in which only nodes in near cells of a grid are compared."""
    b = parse_box(F.col("bounds"))
    rows = nodes.withColumn("_c", center(b)).filter(b.isNotNull() & (F.array_contains("actions", "click") | F.array_contains("actions", "focus")))
    rows = rows.select(page, "node_id", F.when(F.array_contains("actions", "click"), "clickable").otherwise("focusable").alias("kind"), F.col("_c.x").cast("double").alias("x"), F.col("_c.y").cast("double").alias("y"))
    kinds = dict(rows.dtypes)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        size = max(near, far, 1)
        cells: dict[tuple[int, int], list[tuple]] = defaultdict(list)  # what is listed, by cell of a grid; near ones are in the nine around
        out: list[tuple] = []
        for r in g.sort_values(["kind", "node_id"]).itertuples(index=False):  # clickable comes before focusable
            at = int(r.x // size), int(r.y // size)
            around = (x for i in (-1, 0, 1) for j in (-1, 0, 1) for x in cells.get((at[0] + i, at[1] + j), ()))
            if all((r.x - x) ** 2 + (r.y - y) ** 2 > (near if kind == r.kind else far) ** 2 for kind, x, y in around):
                cells[at].append((r.kind, r.x, r.y))
                out.append((getattr(r, page), len(out) + 1, r.node_id, r.kind))
        return pd.DataFrame(out, columns=[page, "label", "node_id", "kind"])

    return rows.groupBy(page).applyInPandas(pick, f"{page} {kinds[page]}, label int, node_id int, kind string")


def grid_unit(size: int) -> int:
    return next((u for u in range(120, 181) if size % u == 0), 120)


def grid_cells(df: DataFrame, width: str, height: str) -> DataFrame:
    """df with one row per cell of a grid over a screen: cell (from 1, by rows) and its box."""
    unit = lambda c: F.coalesce(F.get(F.filter(F.sequence(F.lit(120), F.lit(180)), lambda u: F.col(c) % u == 0), 0), F.lit(120))
    rows = df.withColumn("_u", unit(width)).withColumn("_v", unit(height)).withColumn("_n", F.floor(F.col(width) / F.col("_u")).cast("int"))
    rows = rows.withColumn("_m", F.floor(F.col(height) / F.col("_v")).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(1), F.col("_n") * F.col("_m"))))
    x, y = (F.col("cell") - 1) % F.col("_n") * F.col("_u"), F.floor((F.col("cell") - 1) / F.col("_n")).cast("int") * F.col("_v")
    return rows.withColumn("box", box(x, y, x + F.col("_u"), y + F.col("_v"))).drop("_u", "_v", "_n", "_m")


def subtree_keys(nodes: DataFrame, page: str, key: str = "key") -> DataFrame:
    """(page, node_id, parent_id, subtree): equal for nodes whose keys and descendants are equal in order and depth."""
    below = nodes.select(page, F.col("path").alias("_p"), F.col("depth").alias("_d"), F.col(key).alias("_k"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("_p", r"\."))), lambda i: F.array_join(F.slice(F.split("_p", r"\."), 1, i), "."))
    pairs = below.withColumn("path", F.explode(above)).join(nodes.select(page, "path", "node_id", "parent_id", "depth"), [page, "path"])
    listing = F.array_sort(F.collect_list(F.struct("_p", (F.col("_d") - F.col("depth")).alias("d"), "_k")))
    return pairs.groupBy(page, "node_id", "parent_id").agg(F.md5(F.to_json(F.transform(listing, lambda x: F.struct(x["d"].alias("d"), x["_k"].alias("k"))))).alias("subtree"))


def new_children(earlier: DataFrame, later: DataFrame, page: str) -> DataFrame:
    """Subtrees of a later screen that an earlier one of the page lacks (both as subtree_keys): what scrolling brought."""
    return later.join(earlier.select(page, "subtree").distinct(), [page, "subtree"], "left_anti")


@F.pandas_udf(T.DoubleType())
def pixel_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal values among those that are not white in both, of decoded pictures as bytes; 0 where sizes differ or a
    picture is missing. Decoding is a slot."""
    import numpy as np

    out = []
    for x, y in zip(a, b):
        if x is None or y is None or len(x) != len(y):
            out.append(0.0)
            continue
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        counted = (p != 255) | (q != 255)
        out.append(float(((p == q) & counted).sum() / counted.sum()) if counted.any() else 0.0)
    return pd.Series(out)
