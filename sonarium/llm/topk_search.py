"""Exact top-k search by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task.
CHUNK = 16_384
QUERIES = 256
#: Quantised impact levels of a dimension.
LEVELS = 16

_HIT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"
_PACK_SCHEMA = "part int, ids binary, vectors binary, dims int"


def scaled(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


class ImpactIndex:
    """Postings of each dimension in segments of equal quantised value, the segments in order of value."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        low, high = vectors.min(0), vectors.max(0)
        step = np.maximum(1, -(-(high - low + 1) // levels))
        level = (vectors - low) // step
        self.segments = []
        for j in range(dims):
            order = np.argsort(level[:, j], kind="stable")
            cuts = np.flatnonzero(np.diff(level[order, j])) + 1
            for rows in np.split(order.astype(np.int32), cuts):
                values = vectors[rows, j]
                self.segments.append((j, int(values.min()), int(values.max()), rows))
        self.dim = np.array([s[0] for s in self.segments])
        self.low = np.array([s[1] for s in self.segments])
        self.high = np.array([s[2] for s in self.segments])
        self.edges = np.searchsorted(self.dim, np.arange(dims + 1))

    def search(self, query: np.ndarray, k: int, least: int | None, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of every possible member of the top ``k`` that scores at least ``least``.

        A dimension adds between 0 and its span above ``floor``, the sum of the smallest contributions. Segments are
        taken by descending upper contribution; a row not yet met in a dimension has at most that dimension's next
        segment. Processing ends when that proves all but a few rows unable to reach the k-th place.
        """
        n = len(self.vectors)
        coefficient = query[self.dim]
        one, two = coefficient * self.low, coefficient * self.high
        lower, upper = np.minimum(one, two), np.maximum(one, two)
        base = np.minimum.reduceat(lower, self.edges[:-1])
        floor = int(base.sum())
        gain, most = lower - base[self.dim], upper - base[self.dim]
        order = np.argsort(-most, kind="stable")
        # What an unmet row can still add per dimension: the upper contribution of the next segment in order.
        ahead = np.zeros(len(base), np.int64)
        np.maximum.at(ahead, self.dim, most)
        waiting = {j: [] for j in range(len(base))}
        for s in order[::-1]:
            waiting[int(self.dim[s])].append(int(most[s]))
        known = np.full(n, floor, np.int64)
        known[barred] = np.iinfo(np.int64).min // 2
        open_ = int(ahead.sum())
        slack = 0
        check, few = max(1, len(order) // 8), max(4 * k, n // 16)
        worst_gap = most - gain
        possible = np.arange(n)
        for done, s in enumerate(order, 1):
            j = int(self.dim[s])
            if gain[s]:
                known[self.segments[s][3]] += gain[s]
            waiting[j].pop()
            left = waiting[j][-1] if waiting[j] else 0
            # A met row may exceed its counted gain by the segment's width; an unmet one by what is next.
            slack = max(slack, 0)
            open_ += left - ahead[j]
            ahead[j] = left
            if done % check == 0 or done == len(order):
                widths = np.zeros(len(base), np.int64)
                np.maximum.at(widths, self.dim[order[:done]], worst_gap[order[:done]])
                room = int(np.maximum(widths, ahead).sum())
                place = np.partition(known, n - k)[n - k] if n > k else known.min()
                bound = place if least is None else max(place, least)
                possible = np.flatnonzero(known + room >= bound)
                if len(possible) <= few:
                    break
        possible = possible[known[possible] > np.iinfo(np.int64).min // 4]
        return possible, self.vectors[possible] @ query


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """All queries of one part against all vectors of one part."""
        out_q, out_v, out_s = [], [], []
        for mine in right.to_pylist():
            ids, dims = np.frombuffer(mine["ids"], np.int64), mine["dims"]
            index = ImpactIndex(np.frombuffer(mine["vectors"], np.int64).reshape(len(ids), dims))
            for asked in left.to_pylist():
                query_ids = np.frombuffer(asked["ids"], np.int64)
                for query_id, query in zip(query_ids, np.frombuffer(asked["vectors"], np.int64).reshape(len(query_ids), asked["dims"])):
                    # Missing components count as 0.
                    fitted = np.zeros(dims, np.int64)
                    fitted[: len(query)] = query[:dims]
                    rows, scores = index.search(fitted, k, None, np.flatnonzero(ids == query_id))
                    best = _best(ids[rows], scores, k)
                    out_q += [query_id] * len(best)
                    out_v += ids[rows[best]].tolist()
                    out_s += scores[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def _packed(frame: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``part, ids, vectors, dims``: about ``rows`` vectors of one length to a part, as arrays of 64-bit integers."""
    count = frame.count()
    parts = max(1, -(-count // rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.table({
            "part": table.column("part")[:1].combine_chunks(), "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([flat.tobytes()], pa.binary()), "dims": table.column("dims")[:1].combine_chunks(),
        })

    placed = frame.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int")).withColumn("dims", F.size("vector"))
    return placed.groupBy("part", "dims").applyInArrow(pack, _PACK_SCHEMA), parts


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of every query, ties to smaller ids.

    Vectors and queries are packed into parts; the grid of parts is dealt over the cluster, so no task holds more than
    one part of each. A task builds an impact-ordered index of its vectors, stops a query only when no other row can be
    in the part's top k, and rescores the possible members exactly. The parts' lists are merged by rank.

    Vectors that are null, empty, or hold null or non-finite components, and rows with a null key, take no part. A row
    with the query's key is the query's own. Repeated candidate rows rank as rows of their own; of queries with one key
    the first by vector counts. Vectors of unequal length are padded with zeros. Scores must fit 64 bits. No rows in
    either table, no rows out; other columns are not carried.
    """
    def clean(frame: DataFrame) -> DataFrame:
        good = frame.where(F.col(key).isNotNull() & usable(F.col(vector)))
        return good.select(F.col(key).cast("bigint").alias("id"), scaled(F.col(vector), scale).alias("vector"))

    asked = clean(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    right, right_parts = _packed(clean(vectors), CHUNK)
    left, left_parts = _packed(asked, QUERIES)
    left = left.select(F.col("part").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(right_parts - 1))).alias("v"), "ids", "vectors", "dims")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(left_parts - 1))).alias("q"), F.col("part").alias("v"), "ids", "vectors", "dims")
    hits = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(_search(k), _HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 10
"""
