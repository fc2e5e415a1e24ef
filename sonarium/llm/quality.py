"""Document quality from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import hashing
from sonarium.llm.language_id import fold

#: Words are hashed to so many buckets, each with a vector of so many components: the model's size, whatever the input.
BUCKETS, DIMS = 1 << 13, 64
#: Places of the sparse index vectors that are not zero, half of them negative.
PLACES = 4
#: Words to either side that make a word's context.
REACH = 3
#: Labelled rows that the network is fitted on, those with the smallest digests of their keys; more are not needed.
TRAIN_ROWS = 20_000
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SHAPES = 64
_BLOCK = 512
_PIECE = 1 << 19
#: Texts whose word counts are multiplied with the vectors at a time.
_POOLED = 128


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's random index vector is not zero, and its sign there."""
    seed = hashing.mix(np.arange(BUCKETS * PLACES, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, PLACES)
    return (seed % np.uint64(DIMS)).astype(np.int64), np.where(np.arange(PLACES) % 2, -1, 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word: runs of letters, digits or signs, each followed by a word for its shape."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    code = hashing.mix(hashing.span_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, hashing.BASES[0]))
    bucket = (code % np.uint64(BUCKETS - _SHAPES)).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capital = capitals[ends] - capitals[starts]
    size = ends - starts
    case = np.where(capital == 0, 0, np.where(capital == size, 2, 1)) + np.where(kind[starts] == 1, 0, np.where(kind[starts] == 2, 3, 4)) * (capital == 0)
    shape = BUCKETS - _SHAPES + np.minimum(case, 7) * 8 + np.minimum(np.log2(size).astype(np.int64), 7)
    both = np.empty(2 * len(bucket), np.int64)
    both[0::2], both[1::2] = bucket, shape
    return both, np.repeat(np.searchsorted(offsets[1:], starts, side="right"), 2)


def _runs(batches: Iterator[pa.RecordBatch], text: str = "body") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about half a megabyte of text: the rows, their bytes and offsets."""
    for batch in batches:
        data, offsets = hashing.texts_buffer(batch.column(text).cast(pa.binary()))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's sums of neighbours' index vectors for every bucket; whole numbers, so their order is no matter."""
    total = np.zeros(BUCKETS * DIMS, np.int64)
    places, signs = index_vectors()
    for _, data, offsets in _runs(batches):
        bucket, text = words(data, offsets)
        plus, minus = [], []
        for step in range(1, 2 * REACH + 1):
            near = np.flatnonzero(text[step:] == text[:-step]) if len(text) > step else np.zeros(0, np.int64)
            left, right = bucket[near], bucket[near + step]
            for k in range(PLACES):
                sums = plus if signs[k] > 0 else minus
                sums += [left * DIMS + places[right, k], right * DIMS + places[left, k]]
        if plus:
            total += np.bincount(np.concatenate(plus), minlength=len(total))
            total -= np.bincount(np.concatenate(minus), minlength=len(total))
    total = total.reshape(-1, _BLOCK * DIMS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["block", "sums"]
    )


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK * DIMS, np.int64)
    for blob in table.column("sums"):
        total += np.frombuffer(blob.as_py(), np.int64)
    return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A unit vector for every bucket from the contexts of all words of all texts."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    sums = rows.mapInArrow(_contexts, "block int, sums binary")
    # A partition's tables meet in two steps: first by a part of the partitions, then all.
    some = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = some.groupBy("block", "part").applyInArrow(_add, "block int, sums binary")
    table = np.zeros((BUCKETS, DIMS))
    for row in some.groupBy("block").applyInArrow(_add, "block int, sums binary").collect():
        table[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.sums, np.int64).reshape(_BLOCK, DIMS)
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's words; zeros for a text without words."""
    n = len(offsets) - 1
    bucket, text = words(data, offsets)
    sizes = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    table = np.concatenate([vectors, vectors * vectors], axis=1)
    out = np.zeros((n, 2 * DIMS), np.float32)
    for at in range(0, n, _POOLED):
        to = min(n, at + _POOLED)
        own = slice(begin[at], begin[to])
        # Counts of words by text, times the table of vectors: one product for many texts.
        counts = np.bincount((text[own] - at) * BUCKETS + bucket[own], minlength=(to - at) * BUCKETS).reshape(to - at, BUCKETS)
        sums = counts.astype(np.float32) @ table / np.maximum(sizes[at:to, None], 1)
        mean = sums[:, :DIMS]
        out[at:to] = np.concatenate([mean, np.sqrt(np.maximum(sums[:, DIMS:] - mean * mean, 0))], axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the logit is divided by a temperature fitted on rows of their own."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the logistic loss of four fifths of the rows; the temperature minimises that of the last fifth."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, order = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, y = ((x - mean) / scale).astype(np.float64), y.astype(np.float64)
    weights = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            a = np.tanh(z[part] @ weights[0] + weights[1])
            gap = 1 / (1 + np.exp(-np.clip(a @ weights[2] + weights[3], -40, 40))) - y[part]
            back = np.outer(gap, weights[2]) * (1 - a * a)
            slopes = [z[part].T @ back, back.sum(0), a.T @ gap, gap.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                g = g / len(part) + decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]))
    if len(held):
        raw = network.logits(x[held])
        candidates = np.exp(np.linspace(-2, 3, 101))
        losses = [np.logaddexp(0, np.where(y[held] > 0, -raw, raw) / t).mean() for t in candidates]
        network.temperature = float(candidates[int(np.argmin(losses))])
    return network


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> Network | float:
    """A network fitted on at most ``rows`` labelled documents; with one class or no rows, the share of label 1."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.md5(F.col("key").cast("string")), "key", "y").limit(rows)
    # At most `rows` narrow rows are broadcast.
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).join(F.broadcast(chosen), "key")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _runs(batches):
            x = pool(shared.value, data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.int64()), batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], names=["key", "y", "x"])

    got = found.mapInArrow(run, "key bigint, y int, x binary").toPandas().sort_values(["key", "x"])
    y = (got.y.to_numpy() > 0).astype(int)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit(np.array([np.frombuffer(v, np.float32) for v in got.x]), y)


def score(docs: DataFrame, vectors: np.ndarray, network: Network | float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the calibrated probability of label 1.

    Every whole text is pooled, in runs of bounded size; nothing is shuffled. Null and empty texts pool to zeros and
    are scored like any other. Rows that repeat get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch, data, offsets in _runs(batches, text):
            x = pool(vectors, data, offsets)
            p = np.full(len(x), network) if isinstance(network, float) else network.probability(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p.astype(float))], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, *[text] * (text not in keep))
    return rows.mapInArrow(run, f"{kinds}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; three quarters of the labels may be learned from, the others are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    vectors = word_vectors(docs)
    network = train(docs, labels, vectors)
    scored = score(docs, vectors, network, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
