"""Queries that judge screens by the rule book. Screens are made of the rules' own texts: an event is a step of its user's
trace, its user's number chooses the task, and its own number which of the task's texts stand where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pruning as P
from ..operators import treepaths as H
from ..operators import uitree as U
from ..operators import verdicts as V
from ..operators.rulebook import RULES

#: What keys of made-up screens begin with.
PREFIXES = (
    "TextView ;; ;;", "Switch ;click check ; checked ;;", "Switch ;click check ; unchecked ;;", "EditText ;click long-click ; ;;", "TextView ;click ; ;;",
    "RecyclerView ;; ;;", ";focusable ; selected ; selected, ;", "[n3] ;; ;;", ";click ; ;;CNY ",
)
#: Tests that the SQL of q70 has a relational form of; the rest (answers, records) are in q71.
RELATIONAL = set(
    "has beside beside_is beside_after beside_on beside_miscounts below_is next_contains next_on section first_family last_share within first_tab single text text_part text_every spoken time_beside size always finished reported state_equals state_contains".split()
)
_COMPILED = {task: V.compiled(task, r) for task, r in RULES.items()}
TASKS = [t for t, row in _COMPILED.items() if all(x[0] in RELATIONAL for x in row[1])]


def _texts(task: str) -> list[str]:
    row = _COMPILED[task]
    found = [t for _, scope, arg, asked in row[1] for t in (*scope.split("|"), *arg.split("|"), *(v.split("&")[0] for v in asked.values())) if t]
    return list(dict.fromkeys(found)) or ["text"]


def _command(task: str) -> str:
    return next((scope for kind, scope, _, _ in _COMPILED[task][1] if kind in ("reported", "state_equals", "state_contains", "answer_state", "answer_told")), "state")


def screens(spark: SparkSession, events: DataFrame, tasks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(steps, nodes) for verdicts.judge. A screen is a root with three families; a text stands in one as a child or, below an
    empty box, as a grandchild."""
    known = spark.createDataFrame([(i, t, _command(t), _texts(t)) for i, t in enumerate(tasks)], "at int, task_id string, cmd string, texts array<string>")
    own = events.select("event_id", "user_id", "event_type", F.pmod("user_id", F.lit(len(tasks))).cast("int").alias("at")).join(F.broadcast(known), "at")  # a row a task
    command = F.when(F.col("event_id") % 2 == 0, F.create_map("cmd", (F.col("event_id") % 3).cast("string")))
    answer = F.concat(F.lit("it is "), F.get("texts", (F.col("event_id") % F.size("texts")).cast("int")))
    steps = own.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"), "task_id", command.alias("command"), answer.alias("answer"), (F.col("event_type") == "purchase").alias("finished"))
    e = F.col("event_id")
    rows = own.select("user_id", "event_id", F.posexplode("texts").alias("j", "text")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("f"))
    rows = rows.filter((e * 31 + F.col("j") * 17 + F.col("f") * 7) % 5 < 2)
    key = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), ((e + F.col("j") * 3 + F.col("f")) % len(PREFIXES) + 1).cast("int")), "text")
    at, deep = F.col("f") * 100 + F.col("j") * 2 + 2, (e + F.col("j")) % 4 == 0
    node = lambda i, last, up, k: F.struct(i.cast("int").alias("node_id"), last.cast("int").alias("last_id"), up.cast("int").alias("parent_id"), k.alias("key"))
    placed = F.when(deep, F.array(node(at, at + 1, F.col("f") * 100, F.lit("box")), node(at + 1, at + 1, at, key))).otherwise(F.array(node(at, at, F.col("f") * 100, key)))
    frame = F.array(node(F.lit(0), F.lit(399), F.lit(None), F.lit("root")), *(node(F.lit(100 * f), F.lit(100 * f + 99), F.lit(0), F.lit(f"family {f}")) for f in (1, 2, 3)))
    nodes = rows.select("user_id", "event_id", F.explode(placed).alias("n")).unionByName(own.select("user_id", "event_id", F.explode(frame).alias("n")))
    return steps, nodes.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"), "n.*")


def _judged(spark: SparkSession, events: DataFrame, tasks: list[str]) -> DataFrame:
    out = V.judge(*screens(spark, events, tasks), V.rules(spark, {t: RULES[t] for t in tasks}))
    goals = F.array_join(F.transform(F.array_sort(F.map_entries("subgoals")), lambda g: F.concat_ws("=", g["key"], g["value"])), ";")
    return out.select(F.col("step").alias("event_id"), F.col("trace_id").alias("user_id"), "task_id", "page", goals.alias("subgoals"), "complete")


def rule_book(spark: SparkSession, d: str) -> DataFrame:
    """Every step judged by its task's rule: the tasks whose tests are of screens and state alone."""
    return _judged(spark, spark.read.parquet(f"{d}/events.parquet"), TASKS)


def rule_book_records(spark: SparkSession, d: str) -> DataFrame:
    """The same with all 138 tasks, those that read records (bills, alarms, songs) and answers among them."""
    return _judged(spark, spark.read.parquet(f"{d}/events.parquet"), list(RULES))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(terms: list[list[int]]) -> str:
    return "[" + ", ".join(f"[{', '.join(map(str, t))}]" for t in terms) + "]::int[][]"


def _holds(terms: str, bits: str) -> str:
    return f"len(list_filter({terms}, lambda t: len(list_filter(t, lambda n: {bits}[abs(n)] <> (n > 0))) = 0)) > 0"


def _rule_book_sql() -> str:
    texts = ", ".join(f"({i}, {_q(t)}, {j}, {_q(x)})" for i, t in enumerate(TASKS) for j, x in enumerate(_texts(t)))
    tasks = ", ".join(f"({i}, {_q(t)}, {_q(_command(t))})" for i, t in enumerate(TASKS))
    leaves = ", ".join(f"({_q(t)}, {n}, {_q(k)}, {_q(s)}, {_q(a)})" for t in TASKS for n, (k, s, a, _) in enumerate(_COMPILED[t][1], 1))
    latches = [f"({_q(t)}, {i}, {str(inc).lower()}, {_list(w)})" for t in TASKS for i, (inc, w) in enumerate(_COMPILED[t][2])]
    goals = ", ".join(f"({_q(t)}, {_q(n)}, {_list(w)}, {s or 0})" for t in TASKS for n, w, s in _COMPILED[t][3])
    prefixes = "[" + ", ".join(map(_q, PREFIXES)) + "]"
    tail, part = "regexp_extract(key, '[^;]*$')", "string_split(arg, '|')"
    on = "contains(key, 'checked') and not contains(key, 'unchecked')"
    said = "trim(string_split(key, ';; ;;')[-1])"
    return f"""
with tasks(place, task, cmd) as (values {tasks}), texts(place, task, j, text) as (values {texts}), leaves(task, n, kind, scope, arg) as (values {leaves}),
latches(task, i, inclusive, whens) as (values {", ".join(latches)}), goals(task, name, whens, said) as (values {goals}),
steps as materialized (select event_id as ev, user_id, place, task, case when event_id % 2 = 0 then cmd end as cmd, (event_id % 3)::varchar as output, event_type = 'purchase' as fin from events join tasks on user_id % {len(TASKS)} = place),
placed as (select ev, j, f, {prefixes}[((ev + j * 3 + f) % {len(PREFIXES)} + 1)::int] || text as key, (f * 100 + j * 2 + 2) as id, (ev + j) % 4 = 0 as deep from steps join texts using (place), (values (1), (2), (3)) t(f) where (ev * 31 + j * 17 + f * 7) % 5 < 2),
nodes as materialized (
  select ev, id, id + deep::int as last, f * 100 as parent, case when deep then 'box' else key end as key from placed union all select ev, id + 1, id + 1, id, key from placed where deep
  union all select ev, 0, 399, null, 'root' from steps union all select ev, f * 100, f * 100 + 99, 0, 'family ' || f from steps, (values (1), (2), (3)) t(f)),
s as materialized (select *, case kind when 'has' then arg when 'section' then split_part(scope, '|', 1) else scope end as sought,
  case when kind in ('text', 'text_part', 'text_every', 'spoken') then 'TextView' when kind = 'single' then arg when kind = 'first_tab' then 'focusable ; selected ; selected' end as top from steps join leaves using (task)),
m as materialized (select s.ev, s.n, x.id, x.parent, coalesce(p.last, 99999) as until from s join nodes x on x.ev = s.ev and contains(x.key, s.sought) left join nodes p on p.ev = s.ev and p.id = x.parent
  where kind in ('has', 'beside', 'beside_is', 'beside_after', 'beside_on', 'beside_miscounts', 'below_is', 'next_contains', 'next_on', 'section', 'first_family', 'last_share', 'time_beside', 'size')),
fam as materialized (select ev, n, parent, id as hit from m where parent is not null and not exists (select 1 from m y where y.ev = m.ev and y.n = m.n and y.id < m.id and m.id <= y.until)),
kids as materialized (select s.ev, s.n, s.kind, s.scope, s.arg, s.sought, f.hit, x.id, x.key, lead(x.key) over w as follows, row_number() over w as r, max(f.hit) over (partition by s.ev, s.n) as last_hit
  from s join fam f using (ev, n) join nodes x on x.ev = f.ev and x.parent = f.parent window w as (partition by s.ev, s.n order by f.hit, x.id)),
inside as (select *, coalesce(last_value(case when contains(key, split_part(scope, '|', 2)) then false when contains(key, split_part(scope, '|', 1)) then true end ignore nulls) over (partition by ev, n order by r rows between unbounded preceding and 1 preceding), false) as within_ from kids where kind = 'section'),
by_kids as (select ev, n, any_value(kind) as kind,
  bool_or(case kind when 'has' then true when 'beside' then contains(key, arg) when 'beside_is' then {tail} = arg when 'beside_on' then {on} and contains(key, arg) when 'size' then len(list_filter({part}, lambda p: contains(key, p))) > 0
    when 'beside_after' then contains(key, {part}[1]) and rtrim(string_split(key, {part}[1])[-1]) = {part}[2]
    when 'beside_miscounts' then contains(key, scope) and contains({tail}, {part}[1]) and not contains({tail}, {part}[2])
    when 'below_is' then exists (select 1 from nodes g where g.ev = kids.ev and g.parent = kids.id and regexp_extract(g.key, '[^;]*$') = kids.arg)
    when 'next_contains' then contains(key, scope) and contains(follows, arg) else false end) as hit,
  arg_min(follows, r) filter (contains(key, sought)) as after_first, arg_min({tail}, r) filter (kind = 'last_share' and hit = last_hit and contains(key, '%')) as share,
  arg_max(string_split(key, {part}[1])[-1], r) filter (kind = 'time_beside' and contains(key, {part}[1])) as timed, any_value(arg) as arg,
  arg_min({tail}, r) filter (kind = 'size' and len(list_filter({part}, lambda p: contains(key, p))) > 0) as said
  from kids group by ev, n),
tops as (select s.ev, s.n, s.kind, s.arg, s.scope, x.id, x.key from s join nodes x on x.ev = s.ev and contains(x.key, s.top)
  where s.top is not null and not exists (select 1 from nodes y where y.ev = x.ev and contains(y.key, s.top) and y.id < x.id and x.id <= y.last)),
by_tops as (select ev, n, count(*) as tops, arg_min(key, id) as first_key, bool_or({said} = arg) as is_text, bool_or(len(list_filter({part}, lambda p: not contains({said}, p))) = 0) as any_part, bool_and(len(list_filter({part}, lambda p: contains({said}, p))) > 0) as every_part,
  bool_or(contains(key, 'hour') and contains(key, 'minute') and contains(key, 'second') and string_split(rtrim(string_split(key, scope)[1]), ' ')[-1] = arg) as spoken from tops group by ev, n),
bits_ as materialized (select s.ev, s.task, s.n, k.said, coalesce(case s.kind
    when 'always' then true when 'finished' then fin when 'reported' then coalesce(cmd = s.scope, false) when 'state_equals' then cmd = s.scope and output = s.arg when 'state_contains' then cmd = s.scope and contains(output, s.arg)
    when 'single' then tops = 1 when 'first_tab' then contains(first_key, s.arg) when 'text' then is_text when 'text_part' then any_part when 'text_every' then coalesce(every_part, true) when 'spoken' then spoken
    when 'within' then exists (select 1 from nodes a join nodes b on b.ev = a.ev and b.id between a.id and a.last where a.ev = s.ev and contains(a.key, s.scope) and contains(b.key, s.arg))
    when 'section' then exists (select 1 from inside i join nodes c on c.ev = i.ev and c.parent = i.id where i.ev = s.ev and i.n = s.n and i.within_ and contains(c.key, s.arg))
    when 'first_family' then exists (select 1 from nodes p join nodes c on c.ev = p.ev and c.id > p.id and c.id <= p.last where p.ev = s.ev and p.id = (select arg_min(f.parent, f.hit) from fam f where f.ev = s.ev and f.n = s.n) and not contains(p.key, s.arg) and contains(c.key, s.arg))
    when 'next_on' then contains(after_first, 'checked') and not contains(after_first, 'unchecked') when 'last_share' then rtrim(share) = s.arg
    when 'time_beside' then array_to_string(list_filter(regexp_split_to_array(timed, '\\s+'), lambda w: w <> '')[1:2], ' ') = string_split(s.arg, '|')[2] else k.hit end, false) as bit
  from s left join by_kids k on k.ev = s.ev and k.n = s.n left join by_tops t on t.ev = s.ev and t.n = s.n),
own as materialized (select ev, task, list(bit order by n) as bits, list(said order by n) as said from bits_ group by ev, task),
now_ as (select o.ev, user_id, o.task, i, inclusive, {_holds("whens", "o.bits")} as holds from own o join steps using (ev) join latches l on l.task = o.task),
held as (select ev, task, list(coalesce(case when inclusive then bool_or_incl else bool_or_excl end, false) order by i) as held from (select *,
    bool_or(holds) over (partition by user_id, task, i order by ev rows unbounded preceding) as bool_or_incl, bool_or(holds) over (partition by user_id, task, i order by ev rows between unbounded preceding and 1 preceding) as bool_or_excl from now_) group by ev, task),
whole as (select o.ev, o.task, o.bits || coalesce(h.held, []) as bits, said from own o left join held h using (ev, task)),
results as (select w.ev, w.task, name, case when g.said > 0 then w.said[g.said] else ({_holds("whens", "w.bits")})::varchar end as value from whole w join goals g using (task))
select r.ev as event_id, any_value(st.user_id) as user_id, r.task as task_id, bool_or(name = 'page' and value = 'true') as page,
  case when bool_or(name = 'page' and value = 'true') then string_agg(name || '=' || value, ';' order by name) filter (name not in ('page', 'complete')) end as subgoals,
  case when bool_or(name = 'page' and value = 'true') then bool_or(value = 'true') filter (name = 'complete') end as complete
from results r join steps st on st.ev = r.ev group by r.ev, r.task
"""


# --- pruning by app. A page stands for a screen: a chain of fifteen nodes, at its end leaves with texts of a rule, and beside each
# node of the chain two siblings with a child each.

_RULES = P.PAGES
_LEAVES = [list(dict.fromkeys([*words, *(t for t, _, _ in anchors), "text"])) + (words[:1] if len(set(words)) < len(words) else []) for _, _, words, anchors, _ in _RULES]
_T, _C = 12, 14


def app_screens(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(screens (page_id, app, markup), nodes)."""
    known = spark.createDataFrame([(i, r[0], x) for i, (r, x) in enumerate(zip(_RULES, _LEAVES))], "at int, app string, words array<string>")
    own = pages.select("page_id", F.pmod("page_id", F.lit(len(_RULES))).cast("int").alias("at")).join(F.broadcast(known), "at")
    p, j = F.col("page_id"), F.col("j")
    leaves = own.select("page_id", "app", "words", F.explode(F.sequence(F.lit(0), F.lit(_T - 1))).alias("j"))
    said = F.when((p + j) % 7 == 0, "").otherwise(F.element_at("words", (j % F.size("words") + 1).cast("int")))
    leaves = leaves.select("page_id", "app", "j", said.alias("said"))
    screens = leaves.groupBy("page_id", "app").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "said"))), lambda x: x["said"]), " ").alias("markup"))
    num = lambda *xs: F.concat(F.lit("["), xs[0].cast("string"), F.lit(","), xs[1].cast("string"), F.lit("]["), xs[2].cast("string"), F.lit(","), xs[3].cast("string"), F.lit("]"))
    flags = lambda *fs: F.filter(F.array(*(F.when(c, n) for n, c in fs)), lambda x: x.isNotNull())
    x, y = (p * 3 + j * 11) % 100, (p + j * 37) % 200
    leaf_nodes = leaves.select(
        "page_id", (j + 15).alias("node_id"), (j + 15).alias("last_id"), F.lit(_C).alias("parent_id"), F.lit(15).alias("depth"), F.when(j % 2 == 0, F.col("said")).otherwise("").alias("text"),
        F.when(j % 2 == 1, F.col("said")).otherwise("").alias("content_desc"), F.when(j % 2 == 1, "ImageView").otherwise("RelativeLayout").alias("class"), num(x, y, x + 50, y + 30).alias("bounds"),
        flags(("naf", j % 5 == 0), ("selected", (p + j) % 3 == 0)).alias("flags"),
    )
    c, none = F.col("c"), F.lit("")
    chain = own.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(_C))).alias("c")).select(
        "page_id", c.alias("node_id"), (F.lit(14 + _T) + (F.lit(_C) - c) * 4).alias("last_id"), F.when(c > 0, c - 1).alias("parent_id"), c.alias("depth"), none.alias("text"), none.alias("content_desc"),
        F.when((c == _C) & (p % 2 == 0), "ListView").otherwise("View").alias("class"), num(F.lit(0), F.lit(0), c + 100, F.lit(200)).alias("bounds"), F.expr("cast(array() as array<string>)").alias("flags"),
    )
    k = F.col("k")
    first, left = F.lit(15 + _T) + (F.lit(_C) - c) * 4 + k, (c * 13 + p + k * 31) % 160
    sides = own.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(_C))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "page_id", first.alias("node_id"), (first + F.when(k % 2 == 0, 1).otherwise(0)).alias("last_id"), F.when(k % 2 == 0, c - 1).otherwise(first - 1).alias("parent_id"), (c + k % 2).alias("depth"), none.alias("text"), none.alias("content_desc"),
        F.when((p + c) % 3 == 0, "RecyclerView").otherwise("View").alias("class"), num(left, left, left + 20 + c, left + 30).alias("bounds"), flags(("scrollable", k == 0)).alias("flags"),
    )
    return screens, leaf_nodes.unionByName(chain).unionByName(sides)


def app_pruning(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each screen."""
    screens_, nodes = app_screens(spark, spark.read.parquet(f"{d}/pages.parquet"))
    recognised = P.page_rules(screens_, P.app_rules(spark), "page_id", "app", "markup")
    return P.prune_by_rules(nodes, recognised, "page_id").select("page_id", F.col("node_id").cast("long").alias("node_id"), "note")


def _pruning_sql() -> str:
    known = ", ".join(f"({i}, {_q(r[0])}, [{', '.join(map(_q, x))}])" for i, (r, x) in enumerate(zip(_RULES, _LEAVES)))
    words = ", ".join(f"({i}, {_q(w)}, {r[2].count(w)})" for i, r in enumerate(_RULES) for w in dict.fromkeys(r[2]))
    anchors = ", ".join(f"({i}, {n}, {_q(t)}, {str(part).lower()}, {levels})" for i, r in enumerate(_RULES) for n, (t, part, levels) in enumerate(r[3]))
    rules = ", ".join(f"({i}, {_q(r[0])}, {_q(r[4].removesuffix('_upper'))}, {str(r[4].endswith('_upper')).lower()})" for i, r in enumerate(_RULES))
    notes = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in P.NOTES.items())
    meets = "{a}.x1 < {b}.x2 and {a}.x2 > {b}.x1 and {a}.y1 < {b}.y2 and {a}.y2 > {b}.y1"
    lower = "list_reduce(list(struct_pack(id := n.id, y1 := n.y1, y2 := n.y2, lv := a.levels) order by n.id), lambda was, now: case when (case when {up} then now.y1 < was.y1 and now.y2 < was.y2 else was.y1 < now.y1 and was.y2 < now.y2 end) then now else was end)"
    fits = "case when a.part then contains(n.text, a.said) or contains(n.descr, a.said) else n.text = a.said or n.descr = a.said end"
    return f"""
with known(place, app, words) as (values {known}), words(rule, word, times) as (values {words}), anchors(rule, nr, said, part, levels) as (values {anchors}), rules(rule, app, action, upper) as (values {rules}),
own as (select page_id as p, app, words from pages join known on page_id % {len(_RULES)} = place),
leaves as materialized (select p, app, j, case when (p + j) % 7 = 0 then '' else words[(j % len(words) + 1)::int] end as said from own, range(0, {_T}) t(j)),
screens as (select p, app, string_agg(said, ' ' order by j) as markup from leaves group by p, app),
recognised as materialized (select p, min(r.rule) as rule from screens s join rules r using (app) where not exists (select 1 from words w where w.rule = r.rule and (length(markup) - length(replace(markup, word, ''))) // length(word) < times) group by p),
nodes as materialized (
  select p, j + 15 as id, j + 15 as last, {_C} as parent, 15 as depth, case when j % 2 = 0 then said else '' end as text, case when j % 2 = 1 then said else '' end as descr, case when j % 2 = 1 then 'ImageView' else 'RelativeLayout' end as class,
    (p * 3 + j * 11) % 100 as x1, (p + j * 37) % 200 as y1, (p * 3 + j * 11) % 100 + 50 as x2, (p + j * 37) % 200 + 30 as y2, j % 5 = 0 as naf, (p + j) % 3 = 0 as chosen, false as scrolls from leaves
  union all select p, c, {14 + _T} + ({_C} - c) * 4, case when c > 0 then c - 1 end, c, '', '', case when c = {_C} and p % 2 = 0 then 'ListView' else 'View' end, 0, 0, c + 100, 200, false, false, false from own, range(0, {_C + 1}) t(c)
  union all select p, f, f + (k % 2 = 0)::int, case when k % 2 = 0 then c - 1 else f - 1 end, c + k % 2, '', '', case when (p + c) % 3 = 0 then 'RecyclerView' else 'View' end, l, l, l + 20 + c, l + 30, false, false, k = 0
    from (select p, c, k, {15 + _T} + ({_C} - c) * 4 + k as f, (c * 13 + p + k * 31) % 160 as l from own, range(1, {_C + 1}) t(c), range(0, 4) u(k))),
hits as (select p, rule, n.id, n.y1, n.y2, min(nr) as nr from recognised join nodes n using (p) join anchors a using (rule) where {fits} group by all),
chosen as (select p, any_value(r.action) as action, {lower.format(up="r.upper")} as a from hits n join recognised using (p, rule) join rules r using (rule) join anchors a on a.rule = n.rule and a.nr = n.nr where r.action <> 'menu' group by p, r.upper),
bases as materialized (select c.p, action, n.id, n.parent, n.x1, n.y1, n.x2, n.y2 from chosen c join nodes b on b.p = c.p and b.id = c.a.id join nodes n on n.p = c.p and n.depth = b.depth - c.a.lv and n.id <= b.id and b.id <= n.last),
siblings as (select b.action, b.id as base, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2, n.*, row_number() over (partition by b.p order by case when n.id > b.id then n.id else 99999 end) as nth from bases b join nodes n on n.p = b.p and n.parent = b.parent and n.id <> b.id),
touching as (select * from siblings where x1 < bx2 and x2 > bx1 and y1 < by2 and y2 > by1),
scrollers as (select b.p, arg_max(n.id, struct_pack(a := (n.x2 - n.x1) * (n.y2 - n.y1), f := -n.id)) as id from bases b join nodes n using (p) where action = 'next_two_and_scroller' and contains(n.class, 'RecyclerView') and n.scrolls and (n.x2 - n.x1) * (n.y2 - n.y1) > 0 group by b.p),
tabs as materialized (select n.p, {lower.format(up="false")} as t from recognised r join rules u using (rule) join anchors a using (rule) join nodes n on n.p = r.p where u.action = 'menu' and ({fits}) group by n.p, a.nr),
idle as (select t.p, min(n.id) as id from tabs t join nodes n on n.p = t.p and n.id = t.t.id where not n.chosen group by t.p),
bars as (select i.p, (select min(f.id) from nodes f where f.p = i.p and f.parent = bar.id) as first from idle i join nodes n on n.p = i.p and n.id = i.id join nodes up on up.p = i.p and up.id = n.parent join nodes bar on bar.p = i.p and bar.id = up.parent),
shown as (select b.p, min(n.id) as id from bars b join nodes f on f.p = b.p and f.id = b.first join nodes n on n.p = b.p and n.id between f.id and f.last where contains(n.class, 'ListView') or contains(n.class, 'RecyclerView') group by b.p),
dropped as (
  select p, id from siblings where (action = 'others') or (id > base and ((action = 'rest') or (action = 'next_one' and nth = 1) or (action = 'next_two_and_scroller' and nth <= 2)))
  union all select p, id from touching where action = 'touching'
  union all select t.p, n.id from touching t join nodes n on n.p = t.p and n.id between t.id and t.last where action = 'inside' and n.x1 >= bx1 and n.y1 >= by1 and n.x2 <= bx2 and n.y2 <= by2
  union all select s.p, s.id from scrollers s join nodes n using (p, id) where n.parent is not null
  union all select n.p, n.id from shown s join nodes n on n.p = s.p and n.parent = s.id where exists (select 1 from tabs t join nodes k on k.p = t.p and k.id = t.t.id where t.p = n.p and {meets.format(a='n', b='k')}))
select n.p as page_id, n.id as node_id, case when u.action = 'note' and naf then case n.class {notes} end end as note
from nodes n left join recognised r using (p) left join rules u using (rule)
where not exists (select 1 from dropped x join nodes g using (p, id) where g.p = n.p and n.id between g.id and g.last)
"""


# --- paths and merges up a tree: a user's events are a page's nodes, each below the one before it or one half as far from the top.

_TREE = """ranked as (select user_id as page, row_number() over (partition by user_id order by event_id) - 1 as id, event_id, event_type from events),
tree as materialized (select page, id, case when id = 0 then null when id % 4 = 0 then id // 2 else id - 1 end as parent, 'node' as tag, event_type as class, case when event_id % 3 = 0 then 'id' || event_id % 40 else '' end as rid,
  case when event_id % 4 < 2 then event_type || ' ' || event_id % 9 else '' end as said, case when event_id % 5 = 0 then 'd' || event_id % 6 || ', x;y' else '' end as descr, event_id % 3 = 1 as acts from ranked)"""


def event_trees(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ranks import ranked

    rows = ranked(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type"), "user_id", "event_id")
    e, i = F.col("event_id"), F.col("_rank")
    some = lambda when, text: F.when(when, text).otherwise("")
    mod = lambda n: (e % n).cast("string")
    return rows.select(
        F.col("user_id").alias("page"), i.alias("node_id"), F.when(i == 0, None).when(i % 4 == 0, F.floor(i / 2)).otherwise(i - 1).alias("parent_id"), i.alias("ord"), F.lit("node").alias("tag"), F.col("event_type").alias("class"),
        some(e % 3 == 0, F.concat(F.lit("id"), mod(40))).alias("resource_id"), some(e % 4 < 2, F.concat_ws(" ", "event_type", mod(9))).alias("text"), some(e % 5 == 0, F.concat(F.lit("d"), mod(6), F.lit(", x;y"))).alias("content_desc"),
        F.when(e % 3 == 1, F.array(F.lit("click"))).alias("actions"),
    )


def shortest_xpaths(spark: SparkSession, d: str) -> DataFrame:
    return H.short_xpaths(event_trees(spark, d), "page")


def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.merge_idle(event_trees(spark, d), "page")


_XPATH_SQL = f"""with recursive {_TREE},
steps as materialized (select *, row_number() over (partition by page, parent, class order by id) as place, count(*) over (partition by page, tag) = 1 as one_tag, count(*) over (partition by page, rid) = 1 as one_rid, count(*) over (partition by page, said) = 1 as one_said,
  count(*) over (partition by page, descr) = 1 as one_descr, count(*) over (partition by page, class) = 1 as one_class from tree),
named as materialized (select *, case when one_tag then '*[@label="' || tag || '"]' when one_rid then '*[@resource-id="' || rid || '"]' when one_said then '*[@text="' || said || '"]' when one_descr then '*[@content-desc="' || descr || '"]' when one_class then class end as own from steps),
walk(page, id, up, path) as (
  select page, id, case when own is null then parent end, coalesce(own, case when parent is null then tag else class || '[' || place || ']' end) from named
  union all select w.page, w.id, case when n.own is null then n.parent end, coalesce(n.own, case when n.parent is null then n.tag else n.class || '[' || n.place || ']' end) || '/' || w.path from walk w join named n on n.page = w.page and n.id = w.up)
select page, id as node_id, '//' || path as xpath from walk where up is null"""

_MERGE_SQL = f"""with recursive {_TREE},
walk(page, id, up) as (
  select page, id, id from tree union all select w.page, w.id, t.parent from walk w join tree t on t.page = w.page and t.id = w.up where not t.acts and t.parent is not null),
homes as materialized (select w.page, w.id, w.up as home from walk w join tree t on t.page = w.page and t.id = w.up where t.acts or t.parent is null),
joins as (select t.page, h.home, list(list_filter(regexp_split_to_array(regexp_replace(said || ' ' || descr, '[;,.]', ' ', 'g'), '\\s+'), lambda w: w <> '') order by t.id) as joins from tree t join homes h using (page, id) where h.home <> t.id group by t.page, h.home)
select t.page, t.id as node_id, h.home as parent_id, case when joins is null then said else array_to_string(list_reduce([list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> '')] || joins, lambda known, x: known || list_filter(x, lambda w: not list_contains(known, w))), ' ') end as text
from tree t left join homes h on h.page = t.page and h.id = t.parent left join joins j on j.page = t.page and j.home = t.id where t.acts or t.parent is null"""


def labelled_elements(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are a page's nodes; their numbers are where they stand and what they offer."""
    e = F.col("event_id")
    x, y = e * 37 % 90, e * 53 % 90
    edges = [c.cast("string") for c in (x, y, x + 10, y + 10)]
    bounds = F.concat(F.lit("["), edges[0], F.lit(","), edges[1], F.lit("]["), edges[2], F.lit(","), edges[3], F.lit("]"))
    actions = F.when(e % 3 == 0, F.array(F.lit("click"))).when(e % 3 == 1, F.array(F.lit("focus"))).otherwise(F.expr("cast(array() as array<string>)"))
    nodes = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("page"), e.alias("node_id"), bounds.alias("bounds"), actions.alias("actions"))
    return U.som_elements(nodes.withColumn("node_id", F.col("node_id").cast("int")), "page")


_SOM_SQL = """with n as (select user_id as page, event_id as id, event_id % 3 as kind, (event_id * 37 % 90 + 5)::bigint as x, (event_id * 53 % 90 + 5)::bigint as y from events where event_id % 3 < 2),
s as (select page, list(struct_pack(id := id, kind := kind, x := x, y := y) order by kind, id) as xs from n group by page),
f as (select page, list_reduce(list_prepend([]::struct(id bigint, kind bigint, x bigint, y bigint)[], list_transform(xs, lambda v: [v])), lambda out, v: case when len(list_filter(out, lambda o: (o.x - v[1].x) ** 2 + (o.y - v[1].y) ** 2 <= case when o.kind = v[1].kind then 25 else 100 end)) = 0 then out || v else out end) as out from s)
select page, i::int as label, out[i].id::int as node_id, case when out[i].kind = 0 then 'clickable' else 'focusable' end as kind from (select page, out, unnest(range(1, len(out) + 1)) as i from f)"""


def queries() -> dict:
    return {"q70_rule_book": rule_book, "q71_rule_book_records": rule_book_records, "q72_app_pruning": app_pruning, "q73_short_xpaths": shortest_xpaths, "q74_merge_idle": merged_nodes, "q75_som_elements": labelled_elements}


def oracle_sql() -> dict[str, str]:
    return {"q70_rule_book": _rule_book_sql(), "q72_app_pruning": _pruning_sql(), "q73_short_xpaths": _XPATH_SQL, "q74_merge_idle": _MERGE_SQL, "q75_som_elements": _SOM_SQL}
