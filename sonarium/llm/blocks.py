"""Counting hashes over a whole corpus with one compact shuffle.

Texts are dealt to blocks of a few megabytes by a hash. A block names each of its hashes once, so a hash that one block
or one hot passage repeats a million times costs one entry. Entries travel as packed arrays, one row per block and hash
range; a task holds one range and answers every block in the order in which it asked. The block then meets its answers
in a co-group that reads the same shuffled texts, so neither texts nor hashes are shuffled twice. Every step is a
function of the rows alone: a lost executor's work is redone with the same result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block. A larger block makes fewer, longer rows of entries: raise it with the corpus, as memory allows.
BLOCK_BYTES = int(os.environ.get("SONARIUM_BLOCK_BYTES", 6 << 20))
#: Rows in a block, for corpora of very short texts.
BLOCK_ROWS = 20_000
KEY_BYTES = 7


@dataclass(frozen=True)
class Layout:
    """How many blocks texts are dealt to, and how many bits of the second hash number the range."""

    blocks: int
    range_bits: int


def block_layout(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> Layout:
    """Counts that follow the size of the corpus; one small aggregate reaches the driver."""
    rows, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-size // block_bytes), -(-rows // BLOCK_ROWS))
    return Layout(int(blocks), max(6, int(blocks).bit_length()))


def dealt(docs: DataFrame, key: str, text: str, layout: Layout) -> DataFrame:
    """``block, key, body``: texts as bytes, dealt by key and content, so that repeated or missing keys spread too."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    frame = docs.select(F.col(key).cast("bigint").alias("key"), body.alias("body"))
    block = F.pmod(F.xxhash64("key", "body"), F.lit(layout.blocks)).cast("int")
    parts = min(layout.blocks, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frame.withColumn("block", block).repartition(parts, "block")


def pack(keys: np.ndarray) -> bytes:
    """The upper 56 bits of every key, 7 bytes each, planes of equal significance together."""
    keys = keys >> np.uint64(8)
    return b"".join(
        (keys.astype(np.uint32).tobytes(), (keys >> np.uint64(32)).astype(np.uint16).tobytes(), (keys >> np.uint64(48)).astype(np.uint8).tobytes())
    )


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // KEY_BYTES
    low = np.frombuffer(blob, np.uint32, n)
    mid = np.frombuffer(blob, np.uint16, n, 4 * n)
    high = np.frombuffer(blob, np.uint8, n, 6 * n)
    return low.astype(np.uint64) | mid.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48)


def by_range(other: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings the entries of a range together, and where each range begins."""
    number = (other >> np.uint64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
    order = np.argsort(number, kind="stable")
    return order, np.searchsorted(number[order], np.arange((1 << bits) + 1))


def ask(block: int, keys: np.ndarray, other: np.ndarray, bits: int, extra: Callable[[np.ndarray], bytes]) -> pa.Table:
    """A row for each range that has entries; ``extra`` makes what goes along with the entries at given places."""
    order, begin = by_range(other, bits)
    numbers = np.flatnonzero(np.diff(begin))
    parts = [order[begin[r] : begin[r + 1]] for r in numbers]
    return pa.table(
        {
            "span": pa.array(numbers, pa.int32()),
            "block": pa.array(np.full(len(numbers), block), pa.int32()),
            "keys": pa.array([pack(keys[p]) for p in parts], pa.binary()),
            "extra": pa.array([extra(p) for p in parts], pa.binary()),
        }
    )


ASK_SCHEMA = "span int, block int, keys binary, extra binary"
ANSWER_SCHEMA = "block int, span int, answer binary"


def answers_in_order(table: pa.Table, other: np.ndarray, bits: int, dtype) -> np.ndarray:
    """The answers to :func:`ask`, one per entry, in the entries' own order."""
    order, begin = by_range(other, bits)
    out = np.zeros(len(order), dtype)
    for span, answer in zip(table.column("span").to_pylist(), table.column("answer").to_pylist()):
        out[order[begin[span] : begin[span + 1]]] = np.frombuffer(answer, dtype)[: begin[span + 1] - begin[span]]
    return out


def resolve(asked: DataFrame, answer: Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray]) -> DataFrame:
    """Answer every entry. ``answer(keys, extras, sizes)`` sees all entries of one range."""

    def one_range(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("keys")]
        sizes = np.array([len(b) // KEY_BYTES for b in blobs], np.int64)
        found = answer(np.concatenate([unpack(b) for b in blobs]), [b.as_py() for b in table.column("extra")], sizes)
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()),
                "span": table.column("span").cast(pa.int32()),
                "answer": pa.array([found[e - n : e].tobytes() for n, e in zip(sizes, ends)], pa.binary()),
            }
        )

    return asked.groupBy("span").applyInArrow(one_range, ANSWER_SCHEMA)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the keys and the places in it where a new key begins."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), sorted_keys[1:] != sorted_keys[:-1]]))


def sliced(table: pa.Table, rows: int) -> Iterator[pa.Table]:
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``most`` bytes of a text or binary column, so that long texts make short runs."""
    begin, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)
