"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are dealt by range of length, longest first, and in a task fall into buckets of about equal length. A query's
k-th best score so far, divided by its length and a bucket's greatest length, is the least cosine a vector of that bucket
needs. Above 1 no vector of the bucket or of a shorter one can enter. Each bucket chooses its pruning by that local
threshold: by length, where its shortest vector is too short for it, and by coordinate: of the coordinates that carry
most of the bucket and the queries as many are taken as make the rest's lengths small beside the threshold; their partial
products plus the rest's lengths (Cauchy-Schwarz) bound the products. Only what is left is verified by the whole integer
product.

Queries start with the k-th best of a small sample of the longest candidates, so that a query goes only to the ranges that
its threshold leaves. A task holds one range's candidates, of bounded size, and queries stream past it in blocks; nothing
but the sample is collected or broadcast. Each range gives k rows per query, and the best k of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, released, small_batches, table

K, QUERY_STEP, SCALE = 5, 50, 256
#: Vectors in a norm bucket, and queries in a block.
BUCKET, BLOCK = 512, 256
#: Bytes of candidates for which there is a range, and most bytes of the sample that gives the first thresholds.
RANGE_BYTES, SEED_BYTES = 4 << 20, 1 << 20
#: Doubles hold whole numbers below this exactly; products that may reach it are taken in whole numbers of any size.
EXACT = 2.0**53
_SLACK = 1e-9


class Buckets:
    """Candidates of one range, by falling length in buckets, each with its coordinates in the order of what they carry."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.rows: list[tuple] = []
        whole = vectors.astype(np.float64)
        norms = np.sqrt((whole**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        for b in range(0, len(order), BUCKET):
            at = order[b : b + BUCKET]
            mass = (whole[at] ** 2).mean(0)
            self.rows.append((ids[at], norms[at], mass, whole[at], vectors[at]))
        self.longest = float(norms.max(initial=0.0))

    def search(self, ids: np.ndarray, queries: np.ndarray, start: np.ndarray, k: int) -> Search:
        out = Search(ids, queries, start, k, self.longest)
        for bucket in self.rows:
            if not out.see(*bucket):
                break
        return out


class Search:
    """The k best of each query of a block over the buckets that it sees, and how many pairs it met and verified."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, start: np.ndarray, k: int, longest: float):
        self.ids, self.whole, self.k = ids, queries, k
        self.q = queries.astype(np.float64)
        self.norm = np.sqrt((self.q**2).sum(1))
        self.exact = float(self.norm.max(initial=0.0)) * max(longest, 1.0) < EXACT and float(self.norm.max(initial=0.0)) < EXACT and longest < EXACT
        self.worst = start.astype(np.float64).copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending
        self.met = self.verified = 0

    def see(self, ids: np.ndarray, norms: np.ndarray, mass: np.ndarray, x: np.ndarray, whole: np.ndarray) -> bool:
        """Whether a later, shorter bucket may still hold anything."""
        reach = self.norm * norms[0] * (1 + _SLACK)
        live = np.flatnonzero(reach >= self.worst)
        self.met += len(ids) * len(self.ids)
        if not len(live):
            return False
        pairs = np.ones((len(live), len(ids)), bool)
        needed = self.worst[live] / np.maximum(reach[live], 1e-300)  # the local cosine thresholds
        q = self.q[live]
        if float(norms[-1]) < float(norms[0]) * float(needed.max(initial=0.0)):
            pairs &= self.norm[live, None] * norms[None, :] * (1 + _SLACK) >= self.worst[live, None]
        # focus coordinates: so many that the rest's lengths are half of the threshold that a query of the middle has
        carried = mass * (q**2).mean(0)
        order = np.argsort(-carried, kind="stable")
        mine, theirs = (1 - np.cumsum(v[order]) / max(v.sum(), 1e-300) for v in ((q**2).mean(0), mass))
        small = np.sqrt(np.maximum(mine, 0) * np.maximum(theirs, 0)) <= np.median(needed) / 2
        focus = int(np.argmax(small)) + 1 if small.any() else len(order)
        f, g = order[:focus], order[focus:]
        part = None
        if len(g):
            part = q[:, f] @ x[:, f].T
            rest = np.sqrt((q[:, g] ** 2).sum(1))[:, None] * np.sqrt((x[:, g] ** 2).sum(1))[None, :]
            pairs &= part + (rest + self.norm[live, None] * norms[None, :]  * _SLACK) * (1 + _SLACK) >= self.worst[live, None]
        pairs &= self.ids[live][:, None] != ids[None, :]
        row, col = np.nonzero(pairs)
        self.verified += len(row)
        for i in range(0, len(row), 1 << 15):
            self._verify(live, row[i : i + (1 << 15)], col[i : i + (1 << 15)], ids, x, whole, part, q, g)
        return True

    def _verify(self, live, row, col, ids, x, whole, part, q, g) -> None:
        if not self.exact:
            scores = [sum(a * b for a, b in zip(self.whole[live[r]].tolist(), whole[c].tolist())) for r, c in zip(row.tolist(), col.tolist())]
        elif part is None:
            scores = np.einsum("ij,ij->i", q[row], x[col]).astype(np.int64).tolist()
        else:
            scores = (part[row, col] + np.einsum("ij,ij->i", q[row][:, g], x[col][:, g])).astype(np.int64).tolist()
        touched = set()
        found = ids[col].tolist()
        for r, name, score in zip(live[row].tolist(), found, scores):
            if score >= self.worst[r] * (1 - _SLACK if self.worst[r] > 0 else 1 + _SLACK) or not self.exact:
                self.best[r].append((-score, name))
                touched.add(r)
        for r in touched:
            self.best[r] = sorted(self.best[r])[: self.k]
            if len(self.best[r]) == self.k:
                self.worst[r] = max(self.worst[r], float(-self.best[r][-1][0]))

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """query, vector and score; a score that a long cannot hold is the nearest that it can."""
        low, high = -(2**63), 2**63 - 1
        out = [(int(q), name, min(max(-minus, low), high)) for q, best in zip(self.ids, self.best) for minus, name in best]
        return tuple(list(c) for c in zip(*out)) if out else ([], [], [])


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<long>) with floor(scale * x); vectors null or with null or non-finite components, and rows
    without a vec_id, are left out, as the contract asks."""
    d = F.col("embedding").cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(d, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled with zeros (which leaves products as they are)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _stacked(parts: list[np.ndarray], width: int = 0) -> np.ndarray:
    width = max([width, *(x.shape[1] for x in parts)])
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]) if parts else np.zeros((0, width), np.int64)


def _distinct(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) without repeated ones. Unique ids, the common case, cost a count of the ids only."""
    rows = rows.select("vec_id", "v")
    return rows.distinct() if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count() else rows


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k highest inner products of each query over all candidates but itself.

    candidates, queries: (vec_id, v: array<long>). Ties go to the smaller vec_id; equal vectors are candidates of their
    own; rows that repeat a vec_id count once per distinct vector. Vectors of other sizes are filled with zeros. Queries
    without any candidate give no row. Products are exact at any size; a score beyond a long is the nearest long.
    """
    spark = candidates.sparkSession
    small_batches(spark)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows, asked = _distinct(candidates).withColumn("norm", length), _distinct(queries).withColumn("norm", length)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 24)).first()
    ranges = max(1, -(-(size or 0) // RANGE_BYTES))
    dealt = rows.repartitionByRange(ranges, F.desc("norm"), "vec_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "vectors")
    reach = {r["part"]: r["norm"] for r in dealt.groupBy("part").agg(F.max("norm").alias("norm")).collect()}  # one row a range
    if not reach:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = max(1, (size or 0) // max(1, n))
    first = dealt.filter(F.col("part") == min(reach)).select("vec_id", "v").limit(int(max(k + 1, min(2 * BUCKET, SEED_BYTES // wide)))).collect()
    seeds = np.array([r[0] for r in first], np.int64), _matrix(pa.array([r[1] for r in first], pa.list_(pa.int64())))
    names, lengths = np.array(list(reach)), np.array(list(reach.values()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, q, norm = b.column("vec_id").to_numpy(), _matrix(b.column("v")), b.column("norm").to_numpy()
            width = max(q.shape[1], seeds[1].shape[1])
            scores = _stacked([q], width).astype(np.float64) @ _stacked([seeds[1]], width).astype(np.float64).T
            scores[ids[:, None] == seeds[0][None, :]] = -np.inf
            worst = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
            worst = np.where(np.isfinite(worst), worst - np.abs(norm) * lengths.max() * 2 * _SLACK, -np.inf)  # below the true one
            parts = [names[x * lengths * (1 + _SLACK) >= w] for x, w in zip(norm, worst)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(worst), pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "v", "worst", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, buckets, width = None, [], None, 0
        waiting: list[tuple] = []

        def answer() -> pa.RecordBatch:
            ids, q, worst = np.concatenate([w[0] for w in waiting]), _stacked([w[1] for w in waiting], width), np.concatenate([w[2] for w in waiting])
            waiting.clear()
            # the same width for both: vectors are filled with zeros
            if q.shape[1] > width:
                found = Buckets(np.concatenate([h[0] for h in held]), _stacked([h[1] for h in held], q.shape[1])).search(ids, q, worst, k)
            else:
                found = buckets.search(ids, q, worst, k)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found.rows()], names=["query_id", "vec_id", "score"])

        for b in batches:
            part, worst = b.column("part").to_numpy(), b.column("worst")
            ids, x, asks = b.column("vec_id").to_numpy(), _matrix(b.column("v")), ~np.asarray(worst.is_null())
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(part)]):
                if s == e:
                    continue
                if part[s] != at:
                    if waiting:
                        yield answer()
                    at, held, buckets = part[s], [], None
                if not asks[s]:
                    held.append((ids[s:e], x[s:e]))
                    continue
                if buckets is None and held:
                    vectors = _stacked([h[1] for h in held])
                    width, buckets = vectors.shape[1], Buckets(np.concatenate([h[0] for h in held]), vectors)
                for i in range(s, e, BLOCK) if held else ():
                    j = min(e, i + BLOCK)
                    waiting.append((ids[i:j], x[i:j], worst.slice(i, j - i).to_numpy()))
                    if sum(len(w[0]) for w in waiting) >= BLOCK:
                        yield answer()
        if waiting:
            yield answer()

    sent = asked.mapInArrow(released(begin), "vec_id long, v array<long>, worst double, parts array<int>")
    sent = sent.select(F.explode("parts").alias("part"), "vec_id", "v", "worst")
    every = dealt.select("part", "vec_id", "v").unionByName(sent, allowMissingColumns=True).repartition(max(ranges, partitions(spark)), "part")
    found = every.sortWithinPartitions("part", F.col("worst").isNotNull()).mapInArrow(released(run), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
