"""Removal of passages that an earlier document already holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import blocks, hashing

OUT_SCHEMA = "key bigint, n_words bigint, spans array<struct<start:bigint,length:bigint>>, kept string"


class _Block:
    """The windows of one block of texts: hashes named once each, and whose they are."""

    def __init__(self, table: pa.Table, width: int):
        keys = table.column("key").to_numpy(zero_copy_only=False)
        if table.column("key").null_count:
            missing = np.asarray(table.column("key").is_null())
            keys = np.where(missing, hashing.NO_ID, np.nan_to_num(np.asarray(table.column("key").fill_null(0))))
        keys = keys.astype(np.int64)
        # Rows come in any order, which differs between two reads: ties of keys go by content, so both number entries alike.
        order = pc.sort_indices(pa.table({"key": keys, "body": table.column("body")}), [("key", "ascending"), ("body", "ascending")]).to_numpy()
        self.table = table.take(pa.array(order))
        self.keys = keys[order]
        self.ids, rank = np.unique(self.keys, return_inverse=True)
        data, offsets = hashing.texts_buffer(self.table.column("body"))
        starts, ends, text = hashing.word_spans(data, offsets)
        self.n_words = np.bincount(text, minlength=len(self.keys))
        words = hashing.word_hashes(data, starts, ends)
        at = np.arange(max(0, len(text) - width + 1))
        self.at = at[text[: len(at)] == text[width - 1 :]] if len(at) else at
        first, second = hashing.window_hashes(words, self.at, self.at + width)
        self.rank = rank[text[self.at]]
        order, begin = blocks.groups_of(first)
        sizes = np.diff(np.append(begin, len(order)))
        # Texts come in ascending key order and the sort is stable: the first of a group has the smallest key.
        head = order[begin]
        # Entries go in text order, so the owners that travel with them are sorted and compress to little.
        by_place = np.argsort(head)
        number = np.empty(len(head), np.int64)
        number[by_place] = np.arange(len(head))
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(number, sizes)
        head = head[by_place]
        self.first, self.second, self.owner = first[head], second[head], self.rank[head]
        self.text, self.width = text, width


def _ask(width: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, width)
        small = np.uint16 if len(block.ids) <= 1 << 16 else np.uint32
        ids = block.ids.tobytes()
        head = np.int64(len(block.ids)).tobytes() + ids
        return blocks.ask(
            table.column("block")[0].as_py(), block.first, block.second, bits,
            lambda part: head + block.owner[part].astype(small).tobytes(),
        )

    return run


def _smaller_elsewhere(keys: np.ndarray, extras: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether another block has the window in a document with a smaller key."""
    owners = []
    for extra, n in zip(extras, sizes):
        known = int(np.frombuffer(extra, np.int64, 1)[0])
        ids = np.frombuffer(extra, np.int64, known, 8)
        owners.append(ids[np.frombuffer(extra, np.uint16 if known <= 1 << 16 else np.uint32, n, 8 * (known + 1))])
    owners = np.concatenate(owners)
    order, begin = blocks.groups_of(keys)
    least = np.minimum.reduceat(owners[order], begin)
    out = np.empty(len(keys), np.uint8)
    out[order] = owners[order] > np.repeat(least, np.diff(np.append(begin, len(order))))
    return out


def _cut(width: int, bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({"key": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "spans": pa.array([], _SPANS), "kept": pa.array([], pa.string())})
        block = _Block(table, width)
        repeated = blocks.answers_in_order(answers, block.second, bits, np.uint8)
        hit = block.at[(repeated[block.group] > 0) | (block.rank > block.owner[block.group])]
        # Windows that overlap or touch merge into one interval of words.
        edge = np.zeros(len(block.text) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        new_text = np.concatenate([[True], block.text[1:] != block.text[:-1]]) if len(gone) else np.zeros(0, bool)
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        begins = np.flatnonzero(gone & (~before | new_text))
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        last_of_text = np.concatenate([new_text[1:], [True]]) if len(gone) else gone
        stops = np.flatnonzero(gone & (~after | last_of_text)) + 1
        first_word = np.concatenate([[0], np.cumsum(block.n_words)])
        owner = block.text[begins] if len(begins) else begins
        per_text = np.searchsorted(owner, np.arange(len(block.keys) + 1))
        spans, kept = [], []
        for i, body in enumerate(block.table.column("body")):
            mine = range(per_text[i], per_text[i + 1])
            words = body.as_py().split()
            cuts = [(int(begins[j] - first_word[i]), int(stops[j] - begins[j])) for j in mine]
            for start, length in reversed(cuts):
                del words[start : start + length]
            spans.append([{"start": s, "length": n} for s, n in cuts])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table({"key": block.table.column("key").combine_chunks(), "n_words": pa.array(block.n_words, pa.int64()),
                         "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.string())})

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13,
                    block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``key, n_words, spans, kept``: maximal intervals of words that repeat a window of a document with a smaller key.

    A window is ``width`` consecutive words (runs of anything but ``[\\x20\\x09-\\x0D]``) of one document. Windows are
    judged on the input; a word goes if any window that covers it also starts in a document with a smaller key. ``kept``
    joins the other words by one space. Windows are compared by 56 bits of one hash and, through the number of the
    range, 6 or more bits of another; the number of bits grows with the corpus.

    Null texts are empty. A null key counts as larger than every key, and rows with equal keys do not remove each
    other's windows. Each input row gives one row; other columns are not carried. Block size: see ``blocks``.
    """
    layout = blocks.block_layout(docs, text, block_bytes)
    texts = blocks.dealt(docs, key, text, layout)
    asked = texts.groupBy("block").applyInArrow(_ask(width, layout.range_bits), blocks.ASK_SCHEMA)
    answers = blocks.resolve(asked, _smaller_elsewhere)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(width, layout.range_bits), OUT_SCHEMA)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest after repeated passages of 13 words are removed."""
    cut = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return cut.select(F.col("key").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
  SELECT h, min(doc_id) AS owner FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (h) WHERE owner < doc_id
), cuts AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS m,
         array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ') AS t
  FROM words LEFT JOIN cuts USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
