"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: sources share a budget by weight; those above their cap (a number of epochs) are clamped to it and what they leave
is shared by the rest, until none is above. Each round is one aggregate over the table of sources, of which the driver sees
two sums.

Repetitions: a source's documents are all taken as often as the target holds the whole source, and what is left is filled by
documents in a seeded order. They are dealt into classes of size (by hexadecimal digits), from the longest to the shortest;
each class gets its share and what the class before left, so that a source misses its target by less than its shortest
documents, however long its longest are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, materialize, table
from .running import running

#: Fixed values of the query: weights by place, the budget as a share of all words, and the most epochs of a source.
WEIGHTS, BUDGET, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
SEED, CLASSES = 11, 16
FEW_SOURCES = 10_000  # sources whose targets and quotas may be broadcast (a few hundred bytes each)


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _by_place(rows: DataFrame, lookup: DataFrame, heavy: DataFrame | None, few: bool) -> DataFrame:
    """rows join lookup on place, a source's number. One source may hold a large share of rows: where sources were counted and
    are few the lookup is broadcast, else rows of heavy sources are salted."""
    return rows.join(F.broadcast(lookup), "place") if few else join_heavy(rows, lookup, "place", "draw", heavy)


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """sources (weight, cap, ...) with target: shares of the budget by weight, none above its cap. If all caps together are below
    the budget, targets are the caps. Sources without weight (or a null one) get nothing.

    Clamped sources stay clamped, as the level only rises, so rounds end; they are counted by sums that stay exact for whole
    sizes below 2^53, in any order."""
    weight = F.coalesce("weight", F.lit(0.0))
    left, weights, clamped = float(budget), sources.agg(F.sum(weight)).first()[0] or 0.0, -1
    while True:
        if weights <= 0:
            return sources.withColumn("target", F.when(weight > 0, F.col("cap")).otherwise(0.0))
        level = F.lit(left) * weight / F.lit(weights)
        above = (level > F.col("cap")) & (weight > 0)
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(weight)), F.count_if(above)).first()
        if row[2] == clamped or not row[2]:
            return sources.withColumn("target", F.when(above, F.col("cap")).otherwise(level))
        left, weights, clamped = float(budget) - row[0], row[1], row[2]


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, ...) with place (from 0, by code point, null last) and weight, which repeats the cycle."""
    placed = running(sources.withColumn("_all", F.lit(0).cast("long")).withColumn("_null", F.col("source").isNull()), "_all", ["_null", "source"])
    at = F.col("rank") - 1
    return placed.withColumn("place", at).withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (at % len(cycle) + 1).cast("int"))).drop("_all", "_null", "rank")


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, epochs: float = EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, *keep) for every row of docs.

    size: words of the whole text (null: none). budget: a share of all sizes together. weights: (source, weight), a null source
    is one too, sources that it lacks get nothing; by default WEIGHTS repeat in the order of sources. copies: how often the mix
    takes the document, epochs at most (rounded up); taken: copies times size. Documents are ordered by a digest of seed and doc_id, then doc_id (null
    first), size and a hash of the text, so that reruns agree in whatever partitions; rows that repeat are documents of their
    own. A null source is one of its own. Documents without words fill nothing. An empty table gives no row. Other columns of
    docs are ignored unless kept. A row of what the fill needs is shuffled once, with what is kept.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), draw.alias("draw"), F.xxhash64("text").alias("tie"), *keep)
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = cyclic_weights(materialize(sources, "sources"))
    if weights is not None:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_s", "_w")
    sources = materialize(sources.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = water_fill(sources, budget * total).withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    few, longest = targets.count() <= FEW_SOURCES, rows.agg(F.max("size")).first()[0] or 0
    if few:
        placed = rows.join(F.broadcast(targets.select(F.col("source").alias("_s"), "place")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        heavy = None
    else:
        key = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("s"), F.coalesce(c, F.lit("")))
        names = targets.select(key("source").alias("_k"), "place", "n")
        placed = join_heavy(rows.withColumn("_k", key("source")), names.drop("n"), "_k", "draw", heavy_keys(names, "_k", "n")).drop("_k")
        heavy = heavy_keys(targets, "place", "n")
    # a group is a source's class of sizes
    size_class = F.length(F.hex("size"))
    filled = running(placed.withColumn("class", size_class).withColumn("group", F.col("place") * (CLASSES + 1) + size_class), "group", ["draw", "doc_id", "size", "tie"], sums=["size"])
    held = filled.groupBy("place", "class").agg(F.sum("size").alias("held")).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("class", "held"))).alias("held"))  # CLASSES entries at most
    state = targets.select("place", "source_size", "target", "whole", "extra").join(held, "place").withColumn("quotas", F.create_map().cast("map<int,double>")).withColumn("carry", F.lit(0.0))
    # the quota of each class: its share of what is to fill, and what longer documents left of theirs
    carried = ("source_size", "target", "whole", "extra", "held", "quotas", "quota")
    for k in range(len(f"{longest:x}"), 0, -1):
        share = F.when(F.col("source_size") > 0, F.col("extra") * F.coalesce(F.try_element_at("held", F.lit(k)), F.lit(0)) / F.col("source_size")).otherwise(0.0)
        state = state.withColumn("quota", share + F.col("carry")).withColumn("quotas", F.map_concat("quotas", F.create_map(F.lit(k), F.col("quota"))))
        if k > 1:
            sums = filled.filter(F.col("class") == k).select("place", "draw", "run_size").unionByName(targets.select("place", F.lit(0).cast("long").alias("draw"), F.lit(0).cast("long").alias("run_size")))
            reached = F.max(F.when(F.col("run_size") <= F.col("quota"), F.col("run_size")).otherwise(0))
            state = _by_place(sums, state, heavy, few).groupBy("place").agg(*(F.first(c).alias(c) for c in carried), reached.alias("reached")).withColumn("carry", F.col("quota") - F.col("reached"))
    done = _by_place(filled, state.select("place", "source_size", "target", "whole", "quotas"), heavy, few)
    copies = F.col("whole") + F.when(F.col("run_size") <= F.try_element_at("quotas", F.col("class")), 1).otherwise(0)
    return done.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: (doc_id, source, text, epoch), a row for each copy that mix takes, epochs from 1."""
    rows = mix(docs, weights, budget, epochs, seed, keep=("text",))
    return rows.filter("copies > 0").select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _op11_sql() -> str:
    """Clamping in the order of cap over weight reaches the same level as rounds do; one pair of tables for each class."""
    levels = []
    for k in range(CLASSES, 0, -1):
        before = "0.0::double" if k == CLASSES else f"(select q.quota - coalesce((select max(run) from runs r where r.place = t.place and r.class = {k + 1} and r.run <= q.quota), 0) from q{k + 1} q where q.place = t.place)"
        levels.append(
            f"q{k} as materialized (select t.place, case when t.source_size > 0 then t.extra * coalesce((select sum(size) from rows_ r where r.place = t.place and r.class = {k}), 0)::double / t.source_size::double else 0.0 end + {before} as quota from targets t)"
        )
    every = " union all ".join(f"select place, {k} as class, quota from q{k}" for k in range(1, CLASSES + 1))
    return (
        r"""
with sized as materialized (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('11:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as draw from documents),
sources as materialized (
  select *, [5.0, 2.0, 1.0][(place % 3 + 1)::int]::double as weight, 2.0::double * source_size as cap, sum(source_size) over () * 1.5::double as budget
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source)),
clamps as (
  select *, budget - sum(cap) over w + cap as left_, sum(weight) over () - sum(weight) over w + weight as weights
  from sources window w as (order by cap / weight, place)),
level as (
  select left_, weights from clamps where left_ * weight / weights <= cap order by cap / weight, place limit 1),
targets as materialized (
  select place, source, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole,
    target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as extra
  from (select s.*, coalesce((select case when left_ * weight / weights > cap then cap else left_ * weight / weights end from level), cap) as target from sources s)),
rows_ as materialized (select d.*, t.place, length(printf('%x', d.size)) as class from sized d join targets t on d.source is not distinct from t.source),
runs as materialized (select *, sum(size) over (partition by place, class order by draw, doc_id nulls first, size rows unbounded preceding) as run from rows_),
"""
        + ",\n".join(levels)
        + f",\nquotas as ({every})\n"
        + """select r.doc_id, r.size, t.source_size, t.target, (t.whole + (r.run <= q.quota)::bigint) * r.size as taken, r.source, t.whole + (r.run <= q.quota)::bigint as copies
from runs r join targets t using (place) join quotas q on q.place = r.place and q.class = r.class
"""
    )


OP11_SQL = _op11_sql()
