"""The engine's queries over the driver's tables, and for each the SQL that it must equal.

Stand-ins: documents are texts with personal information (a document's source is its app, 25 neighbouring ids a task),
events are traces of users, conversations hold prompts, labels hold verdicts, benchmark holds reference answers, pages hold
markup, embeddings hold vectors, and the order tables hold names and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions.constants import ACTION_PREFIXES, ACTION_SUFFIXES, DETECTORS, EXEMPT_PATTERNS, EXEMPT_WORDS, FUZZY_THRESHOLD, PLACEHOLDER, STOP_WORDS
from ..operators import judges as J
from ..operators import mask as M
from ..operators import metrics as G
from ..operators import ocr as O
from ..operators import qa as Q
from ..operators import ranks as K
from ..operators import records as N
from ..operators import registry as R
from ..operators import trace as T
from ..operators import uitree as U
from ..operators import work as W
from ..sources import files as D
from ..sources.files import write_json
from ..streaming import progress as P
from . import judging
from .storage import shared_path, stored

#: A fixed list of part types that names are looked up in.
TYPES = ["ECONOMY ANODIZED", "ECONOMY BRUSHED", "LARGE PLATED", "MEDIUM POLISHED", "PROMO BURNISHED", "SMALL PLATED", "STANDARD POLISHED"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans_cte(text: str, source: str, keys: str, where: str = "true") -> str:
    """SQL for spans(keys, text, s, ord, e, label) of source."""
    parts = []
    for i, (label, p) in enumerate(DETECTORS):
        parts.append(
            f"select {keys}, text, {i} as ord, '{label}' as label, unnest(range(1, len(ms) + 1)) as k, ms, gs from (select {keys}, {text} as text, regexp_extract_all({text}, {_q(p)}) as ms, regexp_split_to_array({text}, {_q(p)}) as gs from {source} where {where})"
        )
    # the i-th match begins after i gaps and i - 1 matches
    begin = "coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)"
    return f"raw as ({' union all '.join(parts)}), spans as (select {keys}, text, ord, label, ({begin})::int as s, ({begin} + length(ms[k]))::int as e from raw)"


_HASH = "lower(lpad(to_base(list_reduce(list_transform(range(0, 16), lambda i: ('0x' || substr(sha256({v}), (i * 4 + 1)::int, 4))::bigint), lambda a, h: (a * 65536 + h) % 60466176, 0::bigint), 36), 5, '0'))"


def _fold(surface: str, spans: str = "spans") -> str:
    """SQL for greedy replacement of the sorted spans of a document."""
    return f"""sorted as (select doc_id, any_value(text) as text, list(struct_pack(at := 0, out := '', n := 0, s := s, e := e, t := {surface}) order by s, ord, e, label) as xs from {spans} group by doc_id),
    folded as (select doc_id, text, list_reduce(xs, lambda a, x: case when x.s >= a.at and x.e > x.s then struct_pack(at := x.e, out := a.out || substr(text, a.at + 1, x.s - a.at) || x.t, n := a.n + x.e - x.s, s := 0, e := 0, t := '') else a end,
      struct_pack(at := 0, out := '', n := 0, s := 0, e := 0, t := '')) as r from sorted),
    masked as (select d.doc_id, case when r is null then d.text else r.out || substr(f.text, r.at + 1) end as masked, coalesce(r.n, 0)::bigint as masked_chars, d.text, d.lang, d.source from documents d left join folded f using (doc_id))"""


_TOKEN = "label || '#' || " + _HASH.format(v="label || ':' || substr(text, s + 1, e - s)")
_KNOWN_TOKEN = "label || '#' || " + _HASH.format(v="label || ':' || value")
_FULL = f"with {_spans_cte('text', 'documents', 'doc_id')}, {_fold(chr(39) + PLACEHOLDER + chr(39))}"
_TOKENS = f"with {_spans_cte('text', 'documents', 'doc_id')}, {_fold(_TOKEN)}"


def _documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("q01_pii_spans", f"with {_spans_cte('text', 'documents', 'doc_id')} select doc_id, s, e, label, substr(text, s + 1, e - s) as value from spans")
def pii_spans(spark, d):
    return R.spans_of(_documents(spark, d), "source", "doc_id").select(F.col("step").alias("doc_id"), "s", "e", "label", "value")


@query("q02_pii_full_cover", f"{_FULL} select doc_id, masked, masked_chars from masked")
def full_cover(spark, d):
    return M.mask_documents(_documents(spark, d), "full").select("doc_id", "masked", "masked_chars")


@query("q03_pii_token_mask", f"{_TOKENS} select doc_id, masked, masked_chars from masked")
def token_mask(spark, d):
    return M.mask_documents(_documents(spark, d), "token").select("doc_id", "masked", "masked_chars")


@query(
    "q04_pii_chunk_spans",
    f"with chunks as (select doc_id, substr(text, (c * 500 + 1)::int, 500) as piece, c from (select doc_id, text, unnest(range(0, greatest((length(text) - 1) // 500, 0) + 1)) as c from documents)), {_spans_cte('piece', 'chunks', 'doc_id, c')} select doc_id, (s + c * 500)::int as s, (e + c * 500)::int as e, label from spans",
)
def chunk_spans(spark, d):
    rows = _documents(spark, d).select("doc_id", F.explode(S.detect_chunked(F.col("text"))).alias("x"))
    return rows.select("doc_id", "x.s", "x.e", "x.label")


@query(
    "q05_anonymization_summary",
    f"{_FULL} select lang, source, count(*) as records, sum(length(text))::bigint as original_chars, sum(masked_chars)::bigint as masked_chars, round(case when sum(length(text)) = 0 then 0.0 else 100.0::double * sum(masked_chars) / sum(length(text)) end, 2) as masked_percent from masked group by grouping sets ((), (lang), (source))",
)
def summary(spark, d):
    rows = M.mask_documents(_documents(spark, d), "full").withColumn("n", F.length("text").cast("long"))
    return G.anonymization_summary(rows, "n", "masked_chars", ["lang", "source"])


@query(
    "q06_entity_registry",
    f"with {_spans_cte('text', 'documents', 'doc_id, source')}, v as (select *, substr(text, s + 1, e - s) as value from spans), m as (select source as task, value, arg_min(label, struct_pack(d := doc_id, s := s, o := ord)) as label, min(doc_id) as first_step from v group by all) select task, value, label, label || '#' || {_HASH.format(v="label || ':' || value")} as token, first_step from m",
)
def entity_registry(spark, d):
    return R.entities(R.spans_of(_documents(spark, d), "source", "doc_id"))


_DET = "struct(s integer, e integer, ord integer, value varchar, tok varchar)[]"
_OCC = "struct(s integer, e integer, value varchar)[]"


@query(
    "q07_registry_stateful_mask",
    f"""with recursive {_spans_cte('text', 'documents', 'doc_id')},
    v as (select *, substr(text, s + 1, e - s) as value, {_TOKEN} as tok from spans),
    det as (select doc_id, list(struct_pack(s := s, e := e, ord := ord, value := value, tok := tok) order by s, ord) as ds from v group by doc_id),
    every as (select distinct doc_id // 25 as task, value from v),
    found as (select d.doc_id, value, unnest(list_filter(range(0, length(d.text) - length(value) + 1), lambda i: substr(d.text, (i + 1)::int, length(value)) = value))::int as s
      from documents d join every on every.task = d.doc_id // 25 and contains(d.text, value)),
    occ as (select doc_id, list(struct_pack(s := s, e := (s + length(value))::int, value := value) order by s) as os from found group by doc_id),
    steps as (select doc_id // 25 as task, row_number() over (partition by doc_id // 25 order by doc_id) as k, doc_id, coalesce(text, '') as text, coalesce(ds, []::{_DET}) as ds, coalesce(os, []::{_OCC}) as os
      from documents left join det using (doc_id) left join occ using (doc_id)),
    r(task, k, vals, toks, doc_id, text, todo) as (
      select distinct task, 0::bigint, []::varchar[], []::varchar[], null::bigint, null::varchar, []::struct(s integer, p integer, e integer, t varchar)[] from steps
      union all
      select task, k, vals || list_transform(added, lambda d: d.value), toks || list_transform(added, lambda d: d.tok), doc_id, text,
        list_sort(list_transform(known, lambda o: struct_pack(s := o.s, p := list_position(vals, o.value)::int, e := o.e, t := toks[list_position(vals, o.value)]))
          || list_transform(fresh, lambda d: struct_pack(s := d.s, p := (1000000 + d.ord)::int, e := d.e, t := fresh[list_position(list_transform(fresh, lambda x: x.value), d.value)].tok)))
      from (select *, list_filter(fresh, lambda d, i: list_position(list_transform(fresh, lambda x: x.value), d.value) = i) as added
        from (select *, list_filter(ds, lambda d: len(list_filter(known, lambda o: d.e > o.s and d.s < o.e)) = 0) as fresh
          from (select steps.task, steps.k, vals, toks, steps.doc_id, steps.text, ds, list_filter(os, lambda o: list_contains(vals, o.value)) as known from r join steps on steps.task = r.task and steps.k = r.k + 1)))),
    folded as (select task, doc_id, text, list_reduce(list_transform(todo, lambda x: struct_pack(at := 0, out := '', n := 0, used := []::varchar[], s := x.s, e := x.e, t := x.t)),
      lambda a, x: case when x.s >= a.at then struct_pack(at := x.e, out := a.out || substr(text, a.at + 1, x.s - a.at) || x.t, n := a.n + x.e - x.s, used := a.used || [x.t], s := 0, e := 0, t := '') else a end,
      struct_pack(at := 0, out := '', n := 0, used := []::varchar[], s := 0, e := 0, t := '')) as f from r where k > 0)
    select task, doc_id, md5(f.out || substr(text, f.at + 1)) as masked_md5, array_to_string(f.used, ',') as tokens, f.n::bigint as masked_chars from folded""",
)
def registry_mask(spark, d):
    rows = _documents(spark, d).withColumn("task", F.floor(F.col("doc_id") / 25))
    return R.mask_with_registry(rows, "task", "doc_id").select("task", F.col("step").alias("doc_id"), F.md5("masked").alias("masked_md5"), F.array_join("tokens", ",").alias("tokens"), "masked_chars")


@query("q08_unmask_roundtrip", "select doc_id, text as restored from documents")
def unmask_roundtrip(spark, d):
    rows = M.mask_documents(_documents(spark, d), "token")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.when(F.col("used").isNull(), F.col("masked")).otherwise(M.unmask(F.col("masked"), M.mapping_of(text, F.col("used")))).alias("restored"))


@query("q09_unresolved_tokens", rf"{_TOKENS} select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(masked, '\[?([A-Z_]+#[A-Za-z0-9]+)\]?', 1))), ',') as tokens from masked where regexp_matches(masked, '[A-Z_]+#[A-Za-z0-9]+')")
def unresolved(spark, d):
    rows = M.mask_documents(_documents(spark, d), "token").withColumn("tokens", M.unresolved_tokens(F.col("masked")))
    return rows.filter(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", ",").alias("tokens"))


_WORDS = "words as (select distinct conv_id, word from (select conv_id, unnest(regexp_split_to_array(lower(g), '[^a-z0-9]+')) as word from (select conv_id, text as g from conversations where turn = 0)) where length(word) >= 2)"


@query("q10_whitelist_words", f"with {_WORDS} select conv_id, word from words")
def whitelist_words(spark, d):
    """Words of the prompts, which are turn 0: a prompt is what fills the whitelist."""
    rows = _t(spark, d, "conversations").filter("turn = 0")
    return rows.select("conv_id", F.explode(M.whitelist_words(F.col("text"), S.detect(F.col("text")))).alias("word")).distinct()


@query(
    "q11_whitelist_exempt",
    f"with {_WORDS}, v as (select distinct conv_id, turn, unnest(string_split(text, ' ')) as value from conversations where turn is distinct from 0) select v.conv_id, v.turn, v.value, coalesce(bool_or(contains(lower(v.value), w.word)), false) as exempt from v left join words w using (conv_id) group by all",
)
def whitelist_exempt(spark, d):
    rows = _t(spark, d, "conversations")
    words = rows.filter("turn = 0").select("conv_id", M.whitelist_words(F.col("text"), S.detect(F.col("text"))).alias("wl")).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("wl"))).alias("wl"))
    values = rows.filter("turn is distinct from 0").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("value")).distinct()
    return values.join(words, "conv_id", "left").select("conv_id", "turn", "value", M.whitelisted(F.col("value"), F.col("wl")).alias("exempt"))


_RUNS = """c as (select *, case when {a} is not distinct from lag({a}) over w and row_number() over w > 1 then 0 else 1 end as ch, row_number() over w as step from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(ch) over (partition by user_id order by step) as run from c), r as (select *, row_number() over (partition by user_id, run order by step) as place from g)"""


def _events(spark, d):
    return _t(spark, d, "events").withColumn("action", F.col("value") > 100)


@query("q12_trace_cutoff", f"with {_RUNS.format(a='(value > 100)')}, x as (select *, max(case when place >= 7 then 1 else 0 end) over (partition by user_id order by step) as o from r) select user_id, count(*) as kept, max(step) as last_step from x where o = 0 group by user_id")
def trace_cutoff(spark, d):
    kept = T.repeat_cutoff(_events(spark, d), "user_id", ["ts", "event_id"], "action")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max("step").cast("long").alias("last_step"))


@query("q13_trace_autostop", f"with {_RUNS.format(a='(value > 100)')} select user_id, min(step) filter (step >= 6 and place >= 5) as stop_step, max(step) as steps from r group by user_id")
def trace_autostop(spark, d):
    out = T.autostop(_events(spark, d), "user_id", ["ts", "event_id"], "action")
    return out.select("user_id", F.col("stop_step").cast("long").alias("stop_step"), F.col("steps").cast("long").alias("steps"))


@query("q14_trace_health", "select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as last_action, count(*) as steps, case when arg_max(event_type, struct_pack(t := ts, e := event_id)) = 'purchase' then 'ok' else 'unfinished' end as status from events group by user_id")
def trace_health(spark, d):
    return T.health(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "purchase")


@query("q15_verdict_fold", "select user_id, coalesce(arg_max(value > 50, struct_pack(t := ts, e := event_id)) filter (event_type <> 'view'), false) as complete, count(*) as judged from events group by user_id")
def verdict_fold(spark, d):
    return T.verdict(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "view", F.col("value") > 50)


@query("q16_sticky_flags", "select event_id, coalesce(bool_or(event_type = 'click') over w, false) as clicked, coalesce(bool_or(value > 90) over w, false) as high from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def sticky_flags(spark, d):
    rows = T.sticky(_t(spark, d, "events"), "user_id", ["ts", "event_id"], {"clicked": F.col("event_type") == "click", "high": F.col("value") > 90})
    return rows.select("event_id", "clicked", "high")


@query("q17_two_phase", "with s as (select *, max(case when value > 90 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as seen from events) select user_id, count(*) as after, max(value) as highest from s where seen = 1 group by user_id")
def two_phase(spark, d):
    rows = T.after_first(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 90)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("after"), F.max("value").alias("highest"))


@query("q18_next_sibling", "select l_orderkey, l_linenumber, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as next_partkey from lineitem")
def next_sibling(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return T.with_next(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "next_partkey").drop("l_partkey")


_VERDICTS = """v as (select d.source as app, l.quality = 1 as complete, (l.toxic + (n_chars % 3 = 0)::int) / 2.0::double as partial, 1 + d.n_chars % 16 as steps, case when d.doc_id % 10 <> 0 then 1 + d.doc_id % 7 end as human, d.doc_id % 3 as no_ops from labels l join documents d using (doc_id)),
 r as (select app, complete::int as c, case when complete then 1.0::double else partial end as p, case when complete and steps > 0 then human / steps::double end as rrr, case when steps <= 1 then 1.0::double else 1.0::double - no_ops / (steps - 1)::double end as ror from v),
 a as (select app, count(*) as total, sum(c)::bigint as complete_correct, avg(c)::double as acc, sum(p) as sum_partial_acc, avg(p) as partial_acc, coalesce(avg(rrr), 0.0) as rrr, coalesce(sum(rrr), 0.0) as sum_rrr, coalesce(avg(ror), 0.0) as ror, coalesce(sum(ror), 0.0) as sum_ror from r group by app)"""
_ROUNDED = ["acc", "sum_partial_acc", "partial_acc", "rrr", "sum_rrr", "ror", "sum_ror"]


def _apps(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    v = _t(spark, d, "labels").join(docs, "doc_id")
    complete, steps = F.col("quality") == 1, 1 + F.col("n_chars") % 16
    partial = (F.col("toxic") + (F.col("n_chars") % 3 == 0).cast("int")) / F.lit(2.0)
    human = F.when(F.col("doc_id") % 10 != 0, 1 + F.col("doc_id") % 7)
    return G.app_metrics(v, "source", complete, partial, G.reward_ratio(complete, human, steps), G.reasonable_ratio(F.col("doc_id") % 3, steps))


@query("q19_app_metrics", f"with {_VERDICTS} select app, total, complete_correct, {', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)} from a")
def app_metrics(spark, d):
    return _apps(spark, d).select("app", "total", "complete_correct", *(F.round(c, 6).alias(c) for c in _ROUNDED))


@query("q20_global_metrics", f"with {_VERDICTS} select sum(total)::bigint as total, sum(complete_correct)::bigint as correct, round(sum(complete_correct) / sum(total), 6) as sr, round(sum(sum_partial_acc) / sum(total), 6) as sub_sr, round(sum(sum_rrr) / sum(complete_correct), 6) as rrr, round(sum(sum_ror) / sum(total), 6) as ror from a")
def global_metrics(spark, d):
    return G.global_metrics(_apps(spark, d)).select("total", "correct", *(F.round(c, 6).alias(c) for c in ("sr", "sub_sr", "rrr", "ror")))


@query("q21_leaderboard_detail", "pivot (select d.lang as agent, coalesce(d.source, 'none') as source, l.quality from labels l join documents d using (doc_id)) on source using coalesce(sum(quality), 0)::bigint group by agent")
def leaderboard_detail(spark, d):
    """A column for each source that has labelled documents; those without one under none."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", F.col("lang").alias("agent"), F.coalesce("source", F.lit("none")).alias("source")), "doc_id")
    return G.leaderboard_detail(rows, "agent", "source", "quality")


@query("q22_incomplete_merge", "with o as (select o_custkey as task, case when o_orderstatus = 'O' then 'max_step' when o_orderstatus = 'F' then 'success' else 'previous' end as status, o_orderkey as run from orders), p as (select * from o where status = 'previous' and task not in (select task from o where status <> 'previous' and task is not null)), n as (select * from o where status = 'max_step') select * from p union all select * from n")
def incomplete_merge(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "max_step").when(F.col("o_orderstatus") == "F", "success").otherwise("previous")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("task"), status.alias("status"), F.col("o_orderkey").alias("run"))
    return W.incomplete(rows.filter("status = 'previous'"), rows.filter("status <> 'previous'"), "task", "status").select("task", "status", "run")


@query("q23_ordered_split", "select doc_id, source, case when row_number() over (partition by source order by doc_id) <= floor(count(*) over (partition by source) * 0.8) then 'train' else 'eval' end as split from documents")
def ordered_split(spark, d):
    return Q.ordered_split(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


def _dealt(rows: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """rows, each with one of items: its place in the order of item_id is key modulo their number, so all of them are used."""
    items = items.filter("item_id is not null")
    n = max(1, items.count())
    # stored, so that the join sees their size
    places = stored(K.running(items, "item_id", {"place": F.lit(1)}).withColumn("place", F.col("place") - 1), "items")
    return rows.withColumn("place", F.pmod(F.col(key), F.lit(n))).join(places, "place").drop("place")


def _normal(t: str) -> str:
    quotes = "'“”’', '" + '""' + "'''"
    plain = f"translate(lower({t}), {quotes})"
    return "trim(regexp_replace(regexp_replace(" + plain + r", '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PREFIX = "^(?:(?:go to)(?: |$)|(?:" + "|".join(p for p in ACTION_PREFIXES if " " not in p) + ")(?: |$))"  # the longer one first
_SUFFIX = "(?:^| )(?:" + "|".join(ACTION_SUFFIXES) + ")$"
_TIGHT = "replace({x}, ' ', '')"
_BARE = f"regexp_replace(case when regexp_matches(n, '^go to(?: |$)') then regexp_replace(n, '^go to(?: |$)', '') else regexp_replace(n, {_q(_PREFIX)}, '') end, {_q(_SUFFIX)}, '')"
_DEALT = "b as (select item_id, text, row_number() over (order by item_id) - 1 as place, count(*) over () as n from benchmark where item_id is not null)"


@query(
    "q24_rule_judge",
    f"""with {_DEALT},
    p as (select d.doc_id, b.item_id, {_normal("d.text || ' ' || case when d.doc_id % 3 = 0 then b.text else '' end")} as pred, b.text as truth from documents d join b on b.place = d.doc_id % b.n),
    c as (select item_id, {_normal("x")} as n from (select item_id, unnest(list_filter(list_transform(
        regexp_extract_all(text, '“([^”]+)”', 1) || regexp_extract_all(text, '"([^"]+)"', 1) || regexp_extract_all(text, '[(]([^)]+)[)]', 1)
        || case when contains(text, '(') then [string_split(text, '(')[1]] else [] end || [text], lambda v: trim(v)), lambda v: v <> '')) as x from benchmark)),
    v as (select item_id, n, {_BARE} as bare, list_filter(string_split(n, ' '), lambda w: length(w) >= 3 and w not in ({_STOP})) as content from c),
    l as (select item_id, list(struct_pack(n := n, vs := list_filter([n, bare, {_TIGHT.format(x="n")}, {_TIGHT.format(x="bare")}], lambda x: x <> ''), content := content)) as names from v group by item_id)
    select p.doc_id, p.item_id, len(list_filter(l.names, lambda c: c.n <> '' and (
        len(list_filter(c.vs, lambda x: contains(p.pred, x) or contains({_TIGHT.format(x="p.pred")}, x))) > 0
        or (len(c.content) > 0 and len(list_filter(c.content, lambda w: not list_contains(string_split(p.pred, ' '), w))) = 0)))) > 0 as correct
    from p join l using (item_id)""",
)
def rule_judge(spark, d):
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"), Q.truth_forms(F.col("text")).alias("forms"))  # once an item
    docs = _t(spark, d, "documents").select("doc_id", "text")
    pred = F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, F.col("ref")).otherwise(""))
    return _dealt(docs, "doc_id", items).select("doc_id", "item_id", Q.judge_forms(pred, F.col("forms")).alias("correct"))


@query("q25_text_normalize", f"select doc_id, {_normal('text')} as normal from documents")
def text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.answer_key(F.col("text")).alias("normal"))


_KEY = r"regexp_replace(lower({t}), '[^a-z0-9_]', '', 'g')"


@query(
    "q26_fuzzy_match",
    f"with p as (select p_partkey, p_brand, {_KEY.format(t='p_name')} as k from part), m as (select a.p_partkey as left_key, b.p_partkey as right_key, case when greatest(length(a.k), length(b.k)) = 0 then 1.0::double else 1.0::double - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k))::double end as sim from p a join p b on a.p_partkey + 1 = b.p_partkey) select left_key, right_key, round(sim, 6) as similarity, sim >= 0.8 as matches from m",
)
def fuzzy_match(spark, d):
    """Each part's name and the next part's: pairs to be matched are given, not searched for."""
    p = _t(spark, d, "part").select("p_partkey", X.fuzzy_key(F.col("p_name")).alias("k"))
    a, b = p.select(F.col("p_partkey").alias("left_key"), F.col("k").alias("ka"), (F.col("p_partkey") + 1).alias("right_key")), p.select(F.col("p_partkey").alias("right_key"), F.col("k").alias("kb"))
    sim = X.similarity(F.col("ka"), F.col("kb"))
    return a.join(b, "right_key").select("left_key", "right_key", F.round(sim, 6).alias("similarity"), (sim >= FUZZY_THRESHOLD).alias("matches"))


@query(
    "q27_nearest_name",
    "with n as (select unnest([" + ", ".join(f"struct_pack(i := {i}, n := '{n}', k := '{''.join(n.split()).lower()}')" for i, n in enumerate(TYPES)) + "]) as x), p as (select p_partkey, p_type, lower(regexp_replace(p_type, '\\s+', '', 'g')) as k from part) select p_partkey, arg_min(x.n, struct_pack(d := case when p_type = x.n then -2 when p.k = x.k then -1 else levenshtein(p.k, x.k) end, i := x.i)) as nearest from p, n group by p_partkey",
)
def nearest_name(spark, d):
    return Q.nearest_name(_t(spark, d, "part").select("p_partkey", "p_type"), "p_type", TYPES).select("p_partkey", "nearest")


def _name_pairs(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("true")).join(p.withColumnRenamed("p_name", "predicted"), "p_partkey")


@query("q28_field_similarity")
def field_similarity(spark, d):
    """A part's name as predicted, the one before it as true: each field has one prediction."""
    rows = _name_pairs(spark, d).withColumn("bound", Q.ratio_bound(F.col("true"), F.col("predicted")))
    return rows.select("p_partkey", F.round(Q.field_similarity("true", "predicted"), 6).alias("score"), F.round("bound", 6).alias("bound"))


_GRAMS = "select id, n, array_to_string({0}[i:i + n - 1], ' ') as g, count(*) as c from (select id, n, {0}, unnest(range(1, len({0}) - n + 2)) as i from t, (select unnest(range(1, 5)) as n)) group by all"


@query(
    "q29_rouge_bleu",
    f"""with {_DEALT}, p as (select row_number() over () as id, conv_id, turn, item_id, coalesce(c.text, '') as text, coalesce(b.text, '') as ref from conversations c join b on b.place = c.conv_id % b.n where role = 'assistant'),
    t as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as xs, list_filter(regexp_split_to_array(ref, '\\s+'), lambda w: w <> '') as ys, regexp_extract_all(lower(text), '[a-z0-9]+') as rx, regexp_extract_all(lower(ref), '[a-z0-9]+') as ry from p),
    coded as (select id, list_transform(ry, lambda w: list_position(ry, w)) as yc, list_transform(rx, lambda w: [coalesce(list_position(ry, w), 0)]) as xc from t),
    lcs as (select id, list_reduce(xc, lambda last, x: list_reduce(list_transform(range(1, len(yc) + 1), lambda j: [j::int]),
      lambda row, j: row || [case when x[1] = yc[j[1]] then last[j[1]] + 1 else greatest(last[j[1] + 1], row[len(row)]) end], [0::int]), list_transform(range(0, len(yc) + 1), lambda i: 0::int))[len(yc) + 1] as n from coded),
    a as ({_GRAMS.format('xs')}), r as ({_GRAMS.format('ys')}), h as (select id, n, sum(least(a.c, r.c)) as hits from a join r using (id, n, g) group by id, n),
    o as (select id, n, len(xs) - n + 1 as total, coalesce(hits, 0) as hits from (select t.*, n from t, (select unnest(range(1, 5)) as n)) left join h using (id, n) where len(xs) >= n),
    z as (select *, count(*) filter (hits = 0) over (partition by id order by n) as zeros from o),
    e as (select id, count(*) as used, sum(case when hits > 0 then ln(hits / total::double) else ln(1.0::double / (pow(2, zeros) * total)) end) as logs from z group by id)
    select conv_id, turn, item_id, round(case when len(xs) = 0 and len(ys) = 0 then null when len(rx) = 0 or len(ry) = 0 or lcs.n = 0 then 0.0 else 2.0::double * lcs.n / (len(rx) + len(ry)) end, 6) as rouge_l,
      round(case when len(xs) = 0 and len(ys) = 0 then null when len(xs) = 0 or len(ys) = 0 then 0.0 else case when len(xs) >= len(ys) then 1.0::double else exp(1 - len(ys) / len(xs)::double) end * exp(logs / used) end, 6) as bleu
    from t left join lcs using (id) left join e using (id)""",
)
def rouge_bleu(spark, d):
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"))
    """Turns of the assistant, which are what a model answered, against reference answers."""
    docs = _t(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return _dealt(docs, "conv_id", items).select("conv_id", "turn", "item_id", F.round(Q.rouge_l_column("text", "ref"), 6).alias("rouge_l"), F.round(Q.bleu_column("text", "ref"), 6).alias("bleu"))


_DOT = "list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::double * p[2]::double))"


@query("q30_cosine_sim", f"select a.vec_id, round({_DOT.format(x='a.embedding', y='b.embedding')} / (sqrt({_DOT.format(x='a.embedding', y='a.embedding')}) * sqrt({_DOT.format(x='b.embedding', y='b.embedding')})), 6) as cosine from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id")
def cosine_sim(spark, d):
    """Each vector and the next: a prediction's embedding beside its reference's."""
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(Q.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("q31_leakage_aggregate", "with f as (select *, (doc_id % 11) / 10.0::double as score from labels) select toxic, count(score) as fields, round(coalesce(avg(score), 0.0), 4) as average_match_score, round(sum((score > 0.6)::int) / count(score), 4) as leakage_rate, round(sum((quality = 1)::int) / count(score), 4) as response_rate from f group by toxic")
def leakage(spark, d):
    score = (F.col("doc_id") % 11) / F.lit(10.0)
    return G.leakage(_t(spark, d, "labels"), score, F.col("quality") == 1, ["toxic"])


@query("q32_progress_snapshot", "select doc_id, count(*) over w as items, sum(quality) over w::bigint as correct, round(avg(toxic) over w, 6) as mean_toxic from labels window w as (order by doc_id rows unbounded preceding)")
def progress(spark, d):
    rows = K.running(_t(spark, d, "labels"), "doc_id", {"items": F.lit(1).cast("long"), "correct": F.col("quality").cast("long"), "toxics": F.col("toxic").cast("long")})
    return rows.select("doc_id", "items", "correct", F.round(F.col("toxics") / F.col("items"), 6).alias("mean_toxic"))


@query("q33_timing_means", "select event_type, round(avg(value), 6) as mean_seconds, round(sum(value), 4) as total_seconds, count(*) as items, count(*) filter (value > 100) as failed, count(*) filter (value < 10) as copied from events group by event_type")
def timing(spark, d):
    rows = G.timing_means(_t(spark, d, "events"), ["event_type"], "value", F.col("value") > 100, F.col("value") < 10)
    return rows.withColumn("mean_seconds", F.round("mean_seconds", 6)).withColumn("total_seconds", F.round("total_seconds", 4))


def _nodes(spark, d):
    return U.ui_nodes(_t(spark, d, "pages").select("page_id", "html"), "page_id", "html")


@query("q34_ui_nodes")
def ui_nodes(spark, d):
    return _nodes(spark, d).select("page_id", "node_id", "parent_id", "ord", "depth", "tag", F.md5("text").alias("text_md5"), "xpath")


@query("q35_ui_key_search")
def ui_key_search(spark, d):
    nodes = stored(_nodes(spark, d).select("page_id", "node_id", "parent_id", "ord", "path", U.key_of().alias("key")), "nodes")  # parsed once
    found = U.find_nodes(nodes, "page_id", "key", "the").select("page_id", "node_id", F.lit("match").alias("kind"))
    return found.unionByName(U.parents_of(nodes, "page_id", "key", "the").select("page_id", F.col("first").alias("node_id"), F.lit("first_of_parent").alias("kind")))


_BOX = "(l_partkey % 100)::int as x1, (l_suppkey % 100)::int as y1, (l_partkey % 100 + l_linenumber * 10)::int as x2, (l_suppkey % 100 + l_quantity)::int as y2"


@query(
    "q36_bounds_algebra",
    f"with b as (select l_orderkey, l_linenumber, {_BOX} from lineitem), p as (select a.l_orderkey, a.l_linenumber, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber) select l_orderkey, l_linenumber, ax1 <= bx1 and ay1 <= by1 and ax2 >= bx2 and ay2 >= by2 as contains, ax1 < bx2 and bx1 < ax2 and ay1 < by2 and by1 < ay2 as intersects, (ax2 - ax1) * (ay2 - ay1) as area, ((ax1 + ax2) // 2)::bigint as cx, ((ay1 + ay2) // 2)::bigint as cy from p",
)
def bounds(spark, d):
    x, y = (F.col("l_partkey") % 100).cast("int"), (F.col("l_suppkey") % 100).cast("int")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", U.box(x, y, (x + F.col("l_linenumber") * 10).cast("int"), (y + F.col("l_quantity")).cast("int")).alias("a"))
    other = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.join(other, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", U.contains(a, b).alias("contains"), U.intersects(a, b).alias("intersects"), U.area(a).alias("area"), U.center(a)["x"].alias("cx"), U.center(a)["y"].alias("cy"))


@query(
    "q37_ocr_pack",
    """with l as (select doc_id, string_split(text, chr(10)) as xs from documents where text is not null),
    i as (select doc_id, list_transform(list_filter(list_zip(range(0, len(xs)), xs), lambda p: length(p[2]) > 0), lambda p: struct_pack(seg := 0::bigint, used := 0::bigint, out := [p[1]::bigint], n := length(p[2])::bigint)) as ys from l),
    f as (select doc_id, list_reduce(ys, lambda a, x: case when a.seg >= 0 and a.used + 5 + x.n <= 500 then struct_pack(seg := a.seg, used := a.used + 5 + x.n, out := a.out || [x.out[1], a.seg, a.used + 5], n := 0::bigint) else struct_pack(seg := a.seg + 1, used := x.n, out := a.out || [x.out[1], a.seg + 1, 0], n := 0::bigint) end,
      struct_pack(seg := -1::bigint, used := 501::bigint, out := []::bigint[], n := 0::bigint)) as r from i),
    u as (select doc_id, r.out as o, unnest(range(0, len(r.out) // 3)) as k from f)
    select doc_id, o[k * 3 + 1]::int as item, o[k * 3 + 2]::int as segment, o[k * 3 + 3]::int as at from u""",
)
def ocr_pack(spark, d):
    lines = F.split("text", "\n")
    return _t(spark, d, "documents").select("doc_id", F.explode(O.pack(lines)).alias("p")).select("doc_id", "p.item", "p.segment", "p.at")


@query("q38_even_chunks", "select c_custkey, c_nationkey, ntile(7) over (partition by c_nationkey order by c_custkey) as chunk from customer")
def even_chunks(spark, d):
    out = W.even_chunks(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 7)
    return out.withColumn("chunk", F.col("chunk").cast("long"))


@query(
    "q39_token_lookup",
    f"with {_spans_cte('text', 'documents', 'doc_id, source')}, v as (select *, substr(text, s + 1, e - s) as value from spans), m as (select source as task, value, arg_min(label, struct_pack(d := doc_id, s := s, o := ord)) as label from v group by all), r as (select task, value, label || '#' || {_HASH.format(v="label || ':' || value")} as token from m), w as (select task, token from r union select task, token || 'x' from r) select w.task, w.token, min(r.value) as value, min(r.value) is null as missing from w left join r using (task, token) group by all",
)
def token_lookup(spark, d):
    registry = R.entities(R.spans_of(_documents(spark, d), "source", "doc_id")).select("task", "value", "token")
    wanted = registry.select("task", "token").union(registry.select("task", F.concat("token", F.lit("x")))).distinct()
    return R.lookup(registry, wanted).select("task", "token", "value", "missing")


@query("q40_stream_progress", "select event_type, count(*) as events, round(sum(value), 4) as total, max(value) as highest from events group by event_type")
def stream_progress(spark, d):
    rows = P.drain(P.event_progress(P.table_stream(spark, d, "events")), "complete", "progress")
    return rows.select("event_type", "events", F.round("total", 4).alias("total"), "highest")


@query("q41_leaderboard", f"with {_VERDICTS} select round(100.0 * sum(complete_correct) / 138, 6) as sr, round(100.0 * sum(sum_partial_acc) / 138, 6) as sub_sr, round(100.0 * sum(sum_rrr) / sum(complete_correct), 6) as rrr, round(100.0 * sum(sum_ror) / 138, 6) as ror, round(sum(complete_correct) / sum(total), 6) as acc, 'agent' || (substr(app, 4)::int % 4)::varchar as agent from a group by 6")
def leaderboard(spark, d):
    apps = _apps(spark, d).withColumn("agent", F.concat(F.lit("agent"), (F.substring("app", 4, 9).cast("int") % 4).cast("string")))
    return G.leaderboard(apps, "agent").select("agent", *(F.round(c, 6).alias(c) for c in ("sr", "sub_sr", "rrr", "ror", "acc")))


@query("q42_layer_summary", "select lang as type, grouping(lang)::int as overall, count(*) as records, sum(n_chars)::bigint as original_chars, sum(case when doc_id % 3 = 0 then doc_id % 7 else doc_id % 5 end)::bigint as masked_chars, round(case when sum(n_chars) = 0 then 0.0 else 100.0::double * sum(case when doc_id % 3 = 0 then doc_id % 7 else doc_id % 5 end) / sum(n_chars) end, 6) as masked_percent from documents group by rollup (lang)")
def layer_summary(spark, d):
    rows = _t(spark, d, "documents").select(F.col("lang").alias("type"), F.col("n_chars").alias("original_length"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7).alias("anonymized_chars_count"), (F.col("doc_id") % 5).alias("anonymized_length"))
    out = G.layer_summary(rows, legacy="anonymized_length").withColumn("overall", F.col("overall").cast("int"))
    return out.withColumn("masked_percent", F.round("masked_percent", 6))


@query("q43_last_attempt", "with a as (select o_custkey as task, row_number() over (partition by o_custkey order by o_orderkey) as attempt, case when o_orderstatus = 'F' then 'success' else 'abort' end as status from orders) select task, attempt, status from a where attempt <= 3 qualify row_number() over (partition by task order by (status = 'abort')::int, case when status = 'abort' then -attempt else attempt end) = 1")
def last_attempt(spark, d):
    from pyspark.sql import Window

    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("abort")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("attempt"), status.alias("status"))
    return W.last_attempt(rows, "task", "attempt", "status")


@query("q44_work_selection", "select c_custkey from customer where c_custkey not in (select o_custkey from orders) union select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def work_selection(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return W.to_run(_t(spark, d, "customer").select("c_custkey"), orders, orders.filter("o_orderstatus = 'P'"), "c_custkey")


@query("q45_instruction_pick", "with t as (select *, case when event_id % 5 = 0 then event_type end as original, 'user ' || user_id::varchar as target from events) select user_id, coalesce(arg_min(original, struct_pack(t := ts, e := event_id)) filter (original is not null), arg_min(target, struct_pack(t := ts, e := event_id))) as instruction from t group by user_id")
def instruction_pick(spark, d):
    rows = _t(spark, d, "events").withColumn("original_instruction", F.when(F.col("event_id") % 5 == 0, F.col("event_type"))).withColumn("target", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return T.instruction(rows, "user_id", ["ts", "event_id"])


@query("q46_no_ops", "with s as (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as n from events) select user_id, case when count(*) > 2 then count(*) filter (event_type = n) else 0 end as no_ops, count(*) as steps from s group by user_id")
def no_ops(spark, d):
    return T.no_ops(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("q47_partial_accuracy", "select doc_id, round(((quality = 1)::int + (toxic = 1)::int + 1) / 3.0::double, 6) as partial from labels")
def partial_accuracy(spark, d):
    goals = F.create_map(F.lit("1"), (F.col("quality") == 1).cast("string"), F.lit("2"), (F.col("toxic") == 1).cast("string"), F.lit("3"), F.lit("12 MB"), F.lit("complete"), F.lit("true"))
    return _t(spark, d, "labels").select("doc_id", F.round(T.partial_accuracy(goals), 6).alias("partial"))


@query("q48_grid_cells", "with p as (select p_partkey, 240 + p_size * 6 as w, 360 as h from part), u as (select *, coalesce(list_filter(range(120, 181), lambda u: w % u = 0)[1], 120) as u, 120 as v from p), c as (select *, unnest(range(1, (w // u) * (h // v) + 1)) as cell from u) select p_partkey, cell::int as cell, (((cell - 1) % (w // u)) * u)::int as x1, (((cell - 1) // (w // u)) * v)::int as y1, (((cell - 1) % (w // u)) * u + u)::int as x2, (((cell - 1) // (w // u)) * v + v)::int as y2 from c")
def grid_cells(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", (240 + F.col("p_size") * 6).cast("int").alias("w"), F.lit(360).alias("h"))
    return U.grid_cells(rows, "w", "h").select("p_partkey", F.col("cell").cast("int").alias("cell"), *(F.col(f"box.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("q49_verdict_override", "select doc_id, case when source in ('src0', 'src1') then coalesce(toxic = 1, quality = 1) when source in ('src2', 'src3') and doc_id % 2 = 0 then toxic = 1 else quality = 1 end as complete, case when source in ('src0', 'src1') then 'vision' when source in ('src2', 'src3') and doc_id % 2 = 0 then 'model' else 'rule_fallback' end as verdict_source from labels join documents using (doc_id)")
def verdict_override(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    kind = F.when(F.col("source").isin("src0", "src1"), "operation").when(F.col("source").isin("src2", "src3"), "query_detect").otherwise("operations")
    final = W.final_verdict(kind, F.col("quality") == 1, F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, F.col("toxic") == 1))
    return rows.select("doc_id", final["complete"].alias("complete"), final["source"].alias("verdict_source"))


def _near_cte(text: str, source: str, keys: str, patterns: tuple[str, ...]) -> str:
    """SQL for near(keys): rows of source whose cs and ce lie within three characters of a match of a pattern in text."""
    begin = "coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)"
    parts = [
        f"select {keys}, cs, ce, ({begin}) as m, length(ms[k]) as n from (select {keys}, cs, ce, ms, gs, unnest(range(1, len(ms) + 1)) as k from (select {keys}, cs, ce, regexp_extract_all({text}, {_q('(?i)' + p)}) as ms, regexp_split_to_array({text}, {_q('(?i)' + p)}) as gs from {source}))"
        for p in patterns
    ]
    return f"near as (select distinct {keys} from ({' union all '.join(parts)}) where ce >= m - 3 and cs <= m + n + 3)"


_MARKUP_WORDS = "[" + ", ".join(_q(w) for w in EXEMPT_WORDS) + "]"


@query(
    "q50_markup_mask",
    f"""with p as (select page_id, coalesce(html, '') as t from pages),
    chunks as (select page_id, substr(t, (c * 500 + 1)::int, 500) as piece, c from (select page_id, t, unnest(range(0, greatest((length(t) - 1) // 500, 0) + 1)) as c from p)),
    {_spans_cte('piece', 'chunks', 'page_id, c')},
    x as (select page_id, ord, label, (s + c * 500)::int as s, (e + c * 500)::int as e, t, substr(t, (s + c * 500 + 1)::int, e - s) as value, greatest(s + c * 500 - 50, 0)::int as b from spans join p using (page_id)),
    y as (select *, substr(t, b + 1, least(length(t), e + 50) - b) as ctx, s - b as cs, e - b as ce, trim(value) as v from x),
    {_near_cte('ctx', 'y', 'page_id, s, e, ord', EXEMPT_PATTERNS)},
    z as (select *, strpos(ctx, ';;') - 1 as zone, strpos(ctx, ':') - 1 as colon, case when strpos(ctx, ';;') > 0 then strpos(substr(ctx, strpos(ctx, ';;')), ':') + strpos(ctx, ';;') - 2 end as after from y),
    k as (select page_id as doc_id, ord, label, s, e, t as text, value from z where not (v <> '' and (list_contains({_MARKUP_WORDS}, v) or exists (select 1 from near where near.page_id = z.page_id and near.s = z.s and near.e = z.e and near.ord = z.ord)
      or (zone >= 0 and colon >= 0 and coalesce(after, -1) >= zone and zone < cs and cs < after and length(v) < 20 and not contains(v, ' ') and len(list_filter({_MARKUP_WORDS}, lambda w: contains(lower(v), lower(w)) or contains(lower(w), lower(v)))) > 0)))),
    documents as (select page_id as doc_id, t as text, null as lang, null as source from p), {_fold("'[' || " + _KNOWN_TOKEN + " || ']'", "k")}
    select doc_id as page_id, md5(masked) as masked_md5, masked_chars from masked""",
)
def markup_mask(spark, d):
    """Page markup masked as compressed UI text: chunks, markup exemption and bracketed tokens."""
    pages = _t(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t"))
    rows = pages.withColumn("spans", S.detect_chunked(F.col("t")))
    masked = F.when(F.size("spans") > 0, M.token_mask(F.col("t"), F.col("spans"), wrap=True, markup=True))
    return rows.withColumn("m", masked).select("page_id", F.md5(F.coalesce("m.text", "t")).alias("masked_md5"), F.coalesce("m.chars", F.lit(0)).cast("long").alias("masked_chars"))




@query(
    "q51_global_registry_mask",
    f"""with {_spans_cte('text', 'documents', 'doc_id')}, v as (select doc_id // 25 as task, *, substr(text, s + 1, e - s) as value from spans),
    m as (select task, value, arg_min(label, struct_pack(d := doc_id, s := s, o := ord)) as label from v group by task, value),
    k as (select d.doc_id, d.text, m.value, m.label, unnest(list_filter(range(0, length(d.text) - length(m.value) + 1), lambda i: substr(d.text, (i + 1)::int, length(m.value)) = m.value)) as s
      from documents d join m on m.task = d.doc_id // 25 and contains(d.text, m.value)),
    found as (select doc_id, text, -1 as ord, label, value, s::int as s, (s + length(value))::int as e from k), {_fold(_KNOWN_TOKEN, 'found')}
    select doc_id // 25 as task, doc_id, md5(masked) as masked_md5, masked_chars from masked""",
)
def global_registry(spark, d):
    rows = _documents(spark, d).withColumn("task", F.floor(F.col("doc_id") / 25))
    return R.global_mask(rows, "task", "doc_id").select("task", F.col("step").alias("doc_id"), F.md5("masked").alias("masked_md5"), "masked_chars")


@query("q52_windowed_stream", "with w as (select floor(epoch(ts) / 21600)::bigint * 21600 as begin_second, event_type, count(*) as events from events group by all) select * from w where begin_second + 21600 <= (select max(epoch(ts)) - 43200 from events)")
def windowed_stream(spark, d):
    rows = P.drain(P.windowed(P.table_stream(spark, d, "events"), "6 hours", "12 hours"), "append", "windows")
    return rows.select(F.unix_timestamp("window.start").alias("begin_second"), "event_type", "events")


@query(
    "q63_session_stream",
    "with o as (select user_id, epoch(ts) as t, case when epoch(ts) - lag(epoch(ts)) over w < 43200 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), r as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as run from o), s as (select user_id, min(t) as a, max(t) + 43200 as b, count(*) as events from r group by user_id, run) select user_id, floor(a)::bigint as begin_second, events from s where b <= (select max(epoch(ts)) - 86400 from events)",
)
def session_stream(spark, d):
    rows = P.drain(P.sessions(P.table_stream(spark, d, "events"), "user_id", "12 hours", "24 hours"), "append", "sessions")
    return rows.select("user_id", F.unix_timestamp("window.start").alias("begin_second"), "events")


@query(
    "q64_sliding_stream",
    "with w as (select unnest([floor(epoch(ts) / 10800)::bigint * 10800, floor(epoch(ts) / 10800)::bigint * 10800 - 10800]) as begin_second, event_type from events), c as (select begin_second, event_type, count(*) as events from w group by all) select * from c where begin_second + 21600 <= (select max(epoch(ts)) - 43200 from events)",
)
def sliding_stream(spark, d):
    rows = P.drain(P.windowed(P.table_stream(spark, d, "events"), "6 hours", "12 hours", "3 hours"), "append", "sliding")
    return rows.select(F.unix_timestamp("window.start").alias("begin_second"), "event_type", "events")


@query("q53_ui_compress")
def ui_compress(spark, d):
    return U.compress(_t(spark, d, "pages").select("page_id", "html"), "page_id", "html").select("page_id", "node_id", "parent_id", "tag", F.md5("text").alias("text_md5"))


#: Rules over lineitem as pages: an order is a page, its lines are nodes with the key flag;status;number.
PAGE_RULES = [
    ("t0", "page", "has", "", "R;"), ("t0", "1", "absent", "", "A;F;3"), ("t0", "2", "sibling", "N;O", "R;"), ("t0", "3", "always", "", ""),
    ("t1", "1", "next", "N;", ";5"), ("t1", "2", "group", "", "R;,A;"), ("t1", "3", "sibling_is", "F;", "2"),
    ("t2", "page", "absent", "", ";6"), ("t2", "1", "sibling_lacks", ";0", "R;"),
]  # fmt: skip
_HAS = "coalesce(bool_or(contains(key, '{0}')), false)"
_NEAR = "coalesce(bool_or(contains(family, '{0}') and {1}), false)"


def _goals(names: dict[str, str]) -> str:
    return " || ',' || ".join(f"'{k}=' || {v}" for k, v in names.items())


@query(
    "q54_judge_pages",
    f"""with n as (select l_orderkey as trace_id, 't' || (l_orderkey % 3) as task_id, l_partkey % 2 as parent_id, struct_pack(a := l_linenumber, b := l_partkey, c := l_returnflag, d := l_linestatus) as ord, l_returnflag || ';' || l_linestatus || ';' || (l_partkey % 7) as key from lineitem),
    w as (select *, lead(key) over (partition by trace_id, parent_id order by ord) as next_key, string_agg(key, chr(10) order by ord) over (partition by trace_id, parent_id rows between unbounded preceding and unbounded following) as family from n),
    j as (select trace_id, task_id, {_HAS.format('R;')} as r, {_HAS.format('A;F;3')} as af3, {_HAS.format('A;')} as a, {_HAS.format(';6')} as six,
      {_NEAR.format('N;O', "contains(key, 'R;')")} as rn, {_NEAR.format(';0', "contains(key, 'R;')")} as r0, {_NEAR.format('F;', "string_split(key, ';')[-1] = '2'")} as two,
      coalesce(bool_or(contains(key, 'N;') and coalesce(contains(next_key, ';5'), false)), false) as five from w group by all)
    select trace_id, task_id, case task_id when 't0' then r when 't1' then true else not six end as page,
      case task_id when 't0' then {_goals({'1': '(not af3)', '2': 'rn', '3': 'true'})} when 't1' then {_goals({'1': 'five', '2': '(r and a)', '3': 'two'})} else {_goals({'1': '(not r0)'})} end as subgoals,
      case task_id when 't0' then not af3 and rn when 't1' then five and r and a and two else not r0 end as complete from j""",
)
def judge_pages(spark, d):
    key = F.concat_ws(";", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 7).cast("string"))
    task = F.concat(F.lit("t"), (F.col("l_orderkey") % 3).cast("string"))
    nodes = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), task.alias("task_id"), F.lit(1).alias("step"), (F.col("l_partkey") % 2).alias("parent_id"), F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("ord"), key.alias("key"))
    return J.judge_pages(nodes, J.rules(spark, PAGE_RULES)).select("trace_id", "task_id", "page", _listed(F.col("subgoals")).alias("subgoals"), "complete")


def _listed(goals: F.Column) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(goals)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")


#: Rules over events as steps: the device's command v reports the value's whole part, and a purchase is a finish.
STATE_RULES = [
    ("t0", "1", "state_equals", "v", "50"), ("t0", "2", "state_lacks", "v", "7"), ("t1", "1", "answer", "", "Tap purchase button"),
    ("t2", "page", "state_contains", "v", "1"), ("t2", "1", "state_differs", "v", "11"), ("t3", "1", "answer_state", "w", ""),
]  # fmt: skip


@query(
    "q55_judge_state",
    f"""with s as (select event_id, 't' || (event_id % 4) as task_id, floor(value)::bigint::varchar as v, event_type, event_type = 'purchase' as fin, user_id % 2 = 0 as has_w from events)
    select event_id, task_id, case task_id when 't0' then true when 't1' then fin when 't2' then contains(v, '1') else fin and has_w end as page,
      case task_id when 't0' then {_goals({'1': "(v = '50')", '2': "(not contains(v, '7'))"})} when 't1' then {_goals({'1': 'fin'})} when 't2' then {_goals({'1': "(v <> '11')"})} else {_goals({'1': '(fin and has_w)'})} end as subgoals,
      case task_id when 't0' then v = '50' and not contains(v, '7') when 't1' then fin when 't2' then v <> '11' else fin and has_w end as complete from s""",
)
def judge_state(spark, d):
    value = F.floor("value").cast("string")
    command = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("v"), value, F.lit("w"), F.col("event_type"))).otherwise(F.create_map(F.lit("v"), value))
    task = F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string"))
    steps = _t(spark, d, "events").select(F.col("event_id").alias("trace_id"), task.alias("task_id"), F.lit(1).alias("step"), command.alias("command"), F.col("event_type").alias("answer"), (F.col("event_type") == "purchase").alias("finished"))
    return J.judge_state(steps, J.rules(spark, STATE_RULES)).select(F.col("trace_id").alias("event_id"), "task_id", "page", _listed(F.col("subgoals")).alias("subgoals"), "complete")


_DURATION = "'^([0-9]+:)?[0-5]?[0-9]:[0-5]?[0-9]$'"


@query(
    "q56_record_songs",
    f"""with t as (select l_orderkey, list(case when (l_linenumber + l_orderkey) % 3 = 0 and l_partkey % 11 <> 0 then (l_partkey % 60) || ':' || lpad((l_suppkey % 60)::varchar, 2, '0') else l_returnflag || l_partkey end order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as xs from lineitem group by l_orderkey),
    f as (select *, coalesce(list_filter(range(0, 4), lambda i: i + 2 < len(xs) and regexp_matches(xs[i + 3], {_DURATION}))[1], 0) as first from t),
    p as (select *, list_filter(range(first, len(xs), 3), lambda i: i + 2 < len(xs)) as places from f),
    e as (select *, coalesce(list_filter(places, lambda i: not regexp_matches(xs[i + 3], {_DURATION}))[1], 1000000) as stop from p)
    select l_orderkey, array_to_string(list_transform(list_filter(places, lambda i: i < stop), lambda i: xs[i + 1] || '/' || xs[i + 2] || '/' || xs[i + 3]), ';') as songs from e""",
)
def record_songs(spark, d):
    rows = _t(spark, d, "lineitem")
    timed = ((F.col("l_linenumber") + F.col("l_orderkey")) % 3 == 0) & (F.col("l_partkey") % 11 != 0)
    text = F.when(timed, F.concat_ws(":", (F.col("l_partkey") % 60).cast("string"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"))).otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    nodes = rows.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("ord"), F.concat(F.lit(N.PLAIN_TEXT), text, F.lit(" ")).alias("key"))
    found = N.songs(F.transform("keys", lambda k: N.text_part(k)))
    return N.keys_of(nodes, ["l_orderkey"]).select("l_orderkey", F.array_join(F.transform(found, lambda x: F.concat_ws("/", x["song"], x["artist"], x["duration"])), ";").alias("songs"))


@query(
    "q57_scalar_checklist",
    r"""select doc_id, upper(replace(lang || ' of ' || source, ' ', '_')) as label, (doc_id % 3) * 3600 + (doc_id % 60) * 60 + n_chars % 60 as seconds, n_chars % 20 <= 10 as near,
      'do(' || doc_id || ', ' || n_chars || ')' as code, regexp_matches(text, '[一-鿿]') as cjk, source || '|' || lang as names, lang || '|x' as tail, source || '_' || doc_id as task,
      case when doc_id % 5 = 0 then 'success' when doc_id % 5 = 1 then 'abort' when doc_id % 5 = 2 then 'max_step' else 'abort' end as outcome, '{"a": ' || doc_id || '}' as json,
      coalesce(case when doc_id % 2 = 0 then lang end, source) as answer, (n_chars % 1000) * 1080 // 1000 as x1, 500 * 1920 // 1000 as y2,
      array_to_string(list_filter(regexp_split_to_array(text, '[ 	

]+'), lambda w: w <> '')[1:10], ' ') as first_words from documents""",
)
def scalar_checklist(spark, d):
    number = lambda c, n: (F.col(c) % n).cast("string")  # noqa: E731
    duration = F.concat_ws(":", number("doc_id", 3), F.lpad(number("doc_id", 60), 2, "0"), F.lpad(number("n_chars", 60), 2, "0"))
    code = F.concat(F.lit("do("), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(", 0"), F.col("n_chars").cast("string"), F.lit(")"))
    box = W.absolute_box(F.array((F.col("n_chars") % 1000).cast("int"), F.lit(0), F.lit(0), F.lit(500)), F.lit(1080), F.lit(1920))
    three = F.array("source", "lang", "source", F.lit("x"))
    return _t(spark, d, "documents").select(
        "doc_id", X.normalize_label(F.concat_ws(" of ", "lang", "source")).alias("label"), X.duration_seconds(duration).alias("seconds"),
        X.within_seconds(F.timestamp_seconds("doc_id"), F.timestamp_seconds(F.col("doc_id") + F.col("n_chars") % 20)).alias("near"), X.strip_leading_zeros(code).alias("code"), X.has_cjk(F.col("text")).alias("cjk"),
        F.array_join(W.name_list(F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit(",,"), F.col("source"))), "|").alias("names"), F.array_join(X.tail(three, 2), "|").alias("tail"),
        W.task_id_of(F.concat_ws("_", "source", F.col("doc_id").cast("string"), F.lit("run"))).alias("task"), T.outcome(F.col("doc_id") % 5 == 0, F.col("doc_id") % 5 == 1, F.col("doc_id") % 5 == 2).alias("outcome"),
        X.salvage_json(F.concat(F.lit('said {"a": '), F.col("doc_id").cast("string"), F.lit("} so"))).alias("json"), T.answer(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("answer"),
        box["x1"].cast("long").alias("x1"), box["y2"].alias("y2"), X.first_words(F.col("text")).alias("first_words"),
    )  # fmt: skip


@query(
    "q58_span_algebra",
    f"""with {_spans_cte('text', 'documents', 'doc_id')}, g as (select *, coalesce(max(e) over (partition by doc_id order by s, e, ord rows between unbounded preceding and 1 preceding), -1) as reach from spans),
    r as (select doc_id, count(*) filter (s > reach) as ranges from g group by doc_id),
    c as (select doc_id, count(*) as n_spans, count(*) filter (not exists (select 1 from spans p where p.doc_id = spans.doc_id and p.label = 'PHONE_NUMBER' and spans.e > p.s and spans.s < p.e)) as clear from spans group by doc_id)
    select d.doc_id, coalesce(n_spans, 0)::int as n_spans, coalesce(clear, 0)::int as clear, coalesce(ranges, 0)::int as ranges, case when d.doc_id % 2 = 0 then 1 else coalesce(n_spans, 0) end::int as cascaded
    from documents d left join c using (doc_id) left join r using (doc_id)""",
)
def span_algebra(spark, d):
    rows = _documents(spark, d).withColumn("spans", S.detect(F.col("text")))
    phones = F.filter("spans", lambda x: x["label"] == "PHONE_NUMBER")
    model = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("ord"), F.lit(3).alias("e"), F.lit("NAME").alias("label")))).otherwise(F.expr(S.NO_SPANS))
    return rows.select("doc_id", F.size("spans").alias("n_spans"), F.size(S.without_overlaps(F.col("spans"), phones)).alias("clear"), F.size(S.merged_ranges(F.col("spans"))).alias("ranges"), F.size(S.cascade(model, F.col("spans"))).alias("cascaded"))


@query(
    "q59_run_bookkeeping",
    "with r as (select 'cust_' || o_custkey as task, 'cust_' || o_custkey || '_' || lpad(o_orderkey::varchar, 10, '0') as run from orders) select task, max(run) as run, 'latest' as kind from r group by task union all select 'cust_' || c_custkey, null, 'missing' from customer where c_custkey not in (select o_custkey from orders)",
)
def run_bookkeeping(spark, d):
    runs = _t(spark, d, "orders").select(F.concat_ws("_", F.lit("cust"), F.col("o_custkey").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("run")).withColumn("task", W.task_id_of(F.col("run")))
    wanted = _t(spark, d, "customer").select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("task"))
    latest = W.latest_run(runs, "task", "run").select("task", "run", F.lit("latest").alias("kind"))
    return latest.unionByName(W.missing_names(wanted, runs, "task").select("task", F.lit(None).cast("string").alias("run"), F.lit("missing").alias("kind")))


@query(
    "q60_reply_parsing",
    """select doc_id, case doc_id % 5 when 0 then 'success' when 1 then 'failure' else 'failure' end as status, case doc_id % 5 when 0 then 'high' when 1 then 'low' else 'medium' end as confidence,
      doc_id % 5 = 2 as correct, case doc_id % 5 when 3 then 'do' when 4 then 'finish' else 'error' end as operation, case doc_id % 5 when 3 then 'Tap' when 4 then 'finish' end as action,
      case doc_id % 5 when 4 then 'done ' || lang end as message, case doc_id % 5 when 3 then doc_id % 100 + 7 end as x2 from documents""",
)
def reply_parsing(spark, d):
    n = F.col("doc_id") % 5
    reply = (
        F.when(n == 0, '```json\n{"status": "Success", "confidence": "HIGH"}\n```').when(n == 1, 'I think {"status": "failure", "confidence": "low"}.').when(n == 2, "That is correct")
        .when(n == 3, F.format_string('Well.\nAction: do(action="Tap", element=[%d,2,%d,4])', F.col("doc_id") % 100, F.col("doc_id") % 100 + 7))
        .otherwise(F.concat(F.lit('```\nfinish(message="done '), F.col("lang"), F.lit('")\n```')))
    )  # fmt: skip
    verdict, action = W.parse_verdict(reply), W.parse_action(reply)
    return _t(spark, d, "documents").select("doc_id", verdict["status"].alias("status"), verdict["confidence"].alias("confidence"), W.parse_correct(reply).alias("correct"), action["operation"].alias("operation"), action["action"].alias("action"), action["message"].alias("message"), F.get(action["box"], 2).cast("long").alias("x2"))


@query(
    "q61_question_shapes",
    """select doc_id, case doc_id % 3 when 0 then 'name: ' || source || ', ' || lang || '; id: ' || doc_id when 1 then source else '' end as flat, case doc_id % 3 when 0 then lang when 1 then source else '' end as picked,
      case doc_id % 3 when 0 then source || ', ' || lang end as name, case when doc_id % 2 = 0 then 'name,email' else 'name,emailAddress,username,address,phonenumber,Xiaohongshu ID,nationality,Weixin ID' end as fields,
      array_to_string(['quoted ' || lang, 'in brackets', 'say "quoted ' || lang || '"', 'say "quoted ' || lang || '" (in brackets)'], '|') as candidates, doc_id % 3 = 0 or doc_id % 2 = 0 as judged from documents""",
)
def question_shapes(spark, d):
    three = F.col("doc_id") % 3
    answers = F.when(three == 0, F.create_map(F.lit("name"), F.array("source", "lang"), F.lit("empty"), F.expr("cast(array() as array<string>)"), F.lit("id"), F.array(F.col("doc_id").cast("string"))))
    plain = F.when(three == 1, F.col("source"))
    flat = Q.flatten_answers(answers, plain)
    question = F.when(F.col("doc_id") % 2 == 0, "Which?\n- name (full): x\n- email").otherwise("Which?")
    truth = F.concat(F.lit('say "quoted '), F.col("lang"), F.lit('" (in brackets)'))
    return _t(spark, d, "documents").select(
        "doc_id", flat.alias("flat"), Q.pick_answer(F.when(three == 0, F.array("lang")), plain).alias("picked"), F.try_element_at(Q.extract_fields(F.when(three == 0, flat), F.array(F.lit("name"))), F.lit("name")).alias("name"),
        F.array_join(Q.expected_fields(question), ",").alias("fields"), F.array_join(Q.candidates(truth), "|").alias("candidates"), Q.combine_judges(three == 0, F.col("doc_id") % 2 == 0).alias("judged"),
    )  # fmt: skip


@query("q62_sortedness", "with o as (select l_orderkey, l_quantity, lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as before from lineitem) select l_orderkey, bool_and(coalesce(l_quantity >= before, true)) as ascending, bool_and(coalesce(l_quantity <= before, true)) as descending from o group by l_orderkey")
def sortedness(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    up, down = (T.ordered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity", x) for x in (False, True))
    return up.select("l_orderkey", F.col("sorted").alias("ascending")).join(down.select("l_orderkey", F.col("sorted").alias("descending")), "l_orderkey")


@query(
    "q65_trace_files",
    "select 'app_' || event_type as task_id, 'app_' || event_type || '_run' as run, user_id::varchar as trace_id, count(*) as steps, sum(event_id)::bigint as indexes, count(*) filter (event_id % 4 = 0)::bigint as commands, min(event_id) % 3 = 0 as tokens from events group by event_type, user_id",
)
def trace_files(spark, d):
    """Steps written as JSON lines below a folder for each run, and read back as traces."""
    command = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("state"), F.col("value").cast("string")))
    method = F.when(F.col("event_id") % 3 == 0, "token_anonymization")
    run = F.concat(F.lit("app_"), "event_type", F.lit("_run"))
    steps = _t(spark, d, "events").select(run.alias("run"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("int").alias("index"), command.alias("command"), method.alias("privacy_method"))
    root = shared_path(spark, "runs")
    D.write_traces(steps, root)
    rows = D.read_traces(spark, root, "*.json", by_run=True).withColumn("key", F.concat_ws("|", "run", "trace_id"))
    counts = rows.groupBy("task_id", "run", "trace_id", "key").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.col("index").cast("long")).alias("indexes"), F.count("command").alias("commands"))
    peeked = D.privacy_method(rows, "key").select("key", F.col("method").isNotNull().alias("tokens"))
    return counts.join(peeked, "key").drop("key")


@query(
    "q66_mapping_files",
    f"with {_spans_cte('text', 'documents', 'doc_id, source')}, v as (select *, substr(text, s + 1, e - s) as value from spans), m as (select source as task, value, arg_min(label, struct_pack(d := doc_id, s := s, o := ord)) as label from v group by all), r as (select task, value, label || '#' || {_HASH.format(v="label || ':' || value")} as token from m) select task, token, min(value) as value from r group by task, token",
)
def mapping_files(spark, d):
    """The registry written as lines in a folder a task, and read back."""
    path = shared_path(spark, "mappings")
    D.write_mappings(R.entities(R.spans_of(_documents(spark, d), "source", "doc_id")), path)
    return D.read_mapping_lines(spark, path).groupBy(F.col("task_dir").alias("task"), "token").agg(F.min("value").alias("value"))


@query(
    "q67_stats_files",
    "select source as task_dir, lang as type, count(*) as records, sum(n_chars)::bigint as original, sum(case when doc_id % 2 = 0 then doc_id % 7 else 0 end)::bigint as masked, any_value(total)::int as total from (select *, count(*) over (partition by source) as total from documents) group by source, lang",
)
def stats_files(spark, d):
    """Statistics written as a line a record in a folder a task, and read back."""
    rows = _t(spark, d, "documents").select(
        F.col("source").alias("task_dir"), F.col("lang").alias("type"), F.col("n_chars").cast("int").alias("original_length"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 7).cast("int")).alias("anonymized_chars_count"),
        F.lit(0).alias("num_tokens"), F.col("doc_id").cast("double").alias("timestamp"),
    )  # fmt: skip
    path = shared_path(spark, "stats")
    D.write_stats(rows, path)
    read = D.read_stat_lines(spark, path).groupBy("task_dir", "type")
    return read.agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("original_length").cast("long")).alias("original"), F.sum(F.col("masked_chars").cast("long")).alias("masked"), F.max("total_records").alias("total"))


@query(
    "q68_question_files",
    "select lang as app, 'shot' || doc_id || '.png' as image, 'Which source?' as question, case when doc_id % 2 = 0 then 'name: ' || concat_ws(', ', source, 'x') else coalesce(source, '') end as flat from documents",
)
def question_files(spark, d):
    """Questions written as JSON in a folder for each app, and read back and flattened."""
    even = F.col("doc_id") % 2 == 0
    answers = F.when(even, F.create_map(F.lit("name"), F.array("source", F.lit("x"))))
    one = F.struct(F.lit("Which source?").alias("question"), answers.alias("answers"), F.when(~even, F.col("source")).alias("answer"))
    rows = _t(spark, d, "documents").select("lang", F.concat(F.lit("shot"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), F.array(one).alias("qa"))
    root = shared_path(spark, "questions")
    write_json(rows.withColumnRenamed("lang", "app"), root, by="app")
    return D.read_questions(spark, root, lines=True, by_app=True).select("app", "image", "question", Q.flatten_answers(F.col("answers"), F.col("answer")).alias("flat"))


@query(
    "q69_ui_files",
    """with s as (select event_id, user_id, case when event_id % 3 = 0 then '/ac/' || (event_id % 50) || '.xml' end as ac, case when event_id % 5 <> 0 then '/xml/' || (event_id % 50) || '.xml' end as xml, event_type = 'purchase' as fin from events),
    n as (select *, regexp_replace(coalesce(ac, xml), '.*/', '') as ui_file from s)
    select event_id, ui_file, 'page' as judged_by, lower(regexp_extract(ui_file, '[.]([^./]+)$', 1)) in ('png', 'jpg') as image from n where ui_file is not null and split_part(ui_file, '.', 1)::int < 40
    union all select event_id, ui_file, 'answer', coalesce(ui_file = 'x', false) from n where fin and user_id % 2 = 0 and (ui_file is null or split_part(ui_file, '.', 1)::int >= 40)""",
)
def ui_files(spark, d):
    number = (F.col("event_id") % 50).cast("string")
    steps = _t(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/ac/"), number, F.lit(".xml"))).alias("ac_xml"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("/xml/"), number, F.lit(".xml"))).alias("xml"),
        (F.col("event_type") == "purchase").alias("finished"), F.when(F.col("user_id") % 2 == 0, "query_detect").otherwise("operation").alias("metric_type"),
    )  # fmt: skip
    kept, rescued = T.with_ui(steps, spark.range(40).select(F.concat(F.col("id").cast("string"), F.lit(".xml")).alias("name")))
    both = kept.withColumn("judged_by", F.lit("page")).unionByName(rescued.withColumn("judged_by", F.lit("answer")))
    return both.select("event_id", "ui_file", "judged_by", F.coalesce(D.is_image(F.col("ui_file")), F.lit(False)).alias("image"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Spans, masking and the summary over all, by language and by source."""
    return summary(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | judging.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | judging.oracle_sql()
