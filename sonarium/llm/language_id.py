"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.hashing import mix

#: Letter trigrams are hashed to so many buckets; the model holds this many numbers per language.
BUCKET_BITS = 15
#: Log-likelihood that another language must gain, times the logarithm of the number of n-grams. Overlapping n-grams
#: are not independent, so this is more than the 1/2 of independent draws.
PENALTY = 4.0
ROUNDS = 12
_BATCH_CHARS = 1 << 20
_UND = "und"


@cache
def _letters() -> np.ndarray:
    """The character for every code point below 0x33480: itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x33480)], np.uint32)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams, word borders included, and how many each text has."""
    joined = "".join(f"\0 {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(codes == 0) - 1
    # A NUL inside a text would shift the count: texts are cleaned of it by the caller.
    table = _letters()
    codes = np.where(codes == 0, 0, table[np.minimum(codes, len(table) - 1)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, text = codes[keep].astype(np.uint64), text[keep]
    if len(codes) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    whole = (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)
    key = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    bucket = (mix(key[whole]) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    return bucket, np.bincount(text[2:][whole], minlength=len(texts))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in runs of bounded length, with their texts."""
    for batch in batches:
        texts = [(t or "").replace("\0", " ") for t in batch.column("text").to_pylist()]
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _BATCH_CHARS or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, size = i + 1, 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's n-gram counts by language, non-zero ones only."""
    found: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"]
            )
        found.clear()

    for batch, texts in _runs(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        buckets, sizes = ngrams(texts)
        of = np.repeat(langs, sizes)
        for lang in dict.fromkeys(langs.tolist()):
            if lang not in found and len(found) >= 256:
                yield from flush()
            counts = np.bincount(buckets[of == lang], minlength=1 << BUCKET_BITS)
            found[lang] = found[lang] + counts if lang in found else counts
    yield from flush()


@dataclass(frozen=True)
class Model:
    """Languages in order and the probability of every bucket, one row per bucket."""

    langs: tuple[str, ...]
    likelihood: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Count the n-grams of every labelled text. The driver gets languages x buckets numbers, whatever the input."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted.lang.unique())
    table = np.zeros((1 << BUCKET_BITS, len(langs)))
    for i, name in enumerate(langs):
        own = counted[counted.lang == name]
        table[own.bucket.to_numpy(), i] = own.n.to_numpy()
    table = (table + smoothing) / (table.sum(0) + smoothing * len(table))
    return Model(tuple(langs), table.astype(np.float32))


def _maximise(p: np.ndarray, counts: np.ndarray, text: np.ndarray, begin: np.ndarray, theta: np.ndarray, rounds: int):
    """Rounds of expectation-maximisation for all texts at once: proportions and log-likelihoods."""
    total = np.add.reduceat(counts, begin)
    for _ in range(rounds):
        joint = p * theta[text]
        weight = counts / joint.sum(1)
        theta = np.add.reduceat(joint * weight[:, None], begin) / total[:, None]
    return theta, np.add.reduceat(counts * np.log((p * theta[text]).sum(1)), begin)


def infer(model: Model, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Language proportions of every text, zero outside its selected set; rows of zeros for texts without n-grams.

    All languages together bound the likelihood of any set: where they gain less over the best single language than a
    second one costs, that language is the set. Else sets of the 1, 2, ... most frequent languages compete.
    """
    out = np.zeros((len(sizes), len(model.langs)))
    live = np.flatnonzero(sizes)
    if not len(live) or not model.langs:
        return out
    ends = np.cumsum(sizes)
    which, counts = [], []
    for i in live:
        own = np.sort(buckets[ends[i] - sizes[i] : ends[i]])
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        which.append(own[new])
        counts.append(np.diff(np.append(new, len(own))))
    lengths = np.array([len(w) for w in which])
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(live)), lengths)
    p, counts = model.likelihood[np.concatenate(which)], np.concatenate(counts).astype(np.float32)
    langs = len(model.langs)
    single = np.add.reduceat(np.log(p) * counts[:, None], begin)
    best = single.max(1)
    chosen = np.zeros((len(live), langs))
    chosen[np.arange(len(live)), single.argmax(1)] = 1
    if langs > 1:
        even = np.full((len(live), langs), 1 / langs, np.float32)
        theta, reached = _maximise(p, counts, text, begin, even, ROUNDS)
        cost = PENALTY * np.log(1 + np.add.reduceat(counts, begin))
        mixed = np.flatnonzero(reached - best > cost)
        if len(mixed):
            chosen[mixed] = _select(p, counts, begin, lengths, theta, chosen, best, cost, mixed)
    out[live] = chosen
    return out


def _select(p, counts, begin, lengths, theta, chosen, best, cost, mixed) -> np.ndarray:
    """Proportions over the set of the most frequent languages whose penalised likelihood is largest."""
    rows = np.concatenate([np.arange(begin[i], begin[i] + lengths[i]) for i in mixed])
    p, counts, lengths = p[rows], counts[rows], lengths[mixed]
    text, begin = np.repeat(np.arange(len(mixed)), lengths), np.cumsum(lengths) - lengths
    rank = np.argsort(np.argsort(-theta[mixed], 1, kind="stable"), 1)
    result, value = chosen[mixed], best[mixed].astype(float)
    for k in range(2, p.shape[1] + 1):
        start = np.where(rank < k, theta[mixed] + 1e-6, 0)
        now, reached = _maximise(p, counts, text, begin, (start / start.sum(1)[:, None]).astype(np.float32), ROUNDS)
        better = reached - cost[mixed] * (k - 1) > value
        result[better], value[better] = now[better], (reached - cost[mixed] * (k - 1))[better]
    return result


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (its share) and ``languages`` (all of the set with shares).

    Null texts and texts without a letter are ``und`` with score 0 and no languages; so is everything if the model has
    learned no language. Whole texts count, in runs of bounded size; no shuffle. The model is languages x buckets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in _runs(batches):
            shares = infer(model, *ngrams(texts))
            if shares.shape[1] == 0:
                shares = np.zeros((len(texts), 1))
            known = shares.sum(1) > 0
            top = shares.argmax(1)
            names = [model.langs[t] if k else _UND for t, k in zip(top, known)]
            sets = [[{"lang": model.langs[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)] for row in shares]
            score = np.clip(shares[np.arange(len(top)), top], 0, 1).astype(float)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(sets, _SET)], names=[*keep, "lang_pred", "score", "languages"]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


_SET = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document; two thirds of the labels are learned from, the others held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = train(docs.where("NOT held_out"))
    return identify(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
