"""Exact deduplication of texts with Patricia tries."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removed before texts are compared (fixed values: space and the controls from tab to carriage return).
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of edges a trie may hold before finished subtrees leave it.
TRIE_BYTES = 24 << 20
_BATCH_BYTES = 4 << 20


class Node:
    """An edge label, children by first byte, and for a terminal the best row so far and the number of rows."""

    __slots__ = ("label", "children", "best", "rows", "meta")

    def __init__(self, label: bytes):
        self.label, self.children, self.best, self.rows, self.meta = label, {}, None, 0, None


class Patricia:
    """A compressed radix trie over byte strings. A terminal keeps the smallest ``best`` of its rows."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, best: tuple, rows: int, meta) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(key) - at + 200
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            upper = Node(label[:same])
            child.label = label[same:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += 200
            node, at = upper, at + same
        node.rows += rows
        if node.best is None or best < node.best:
            node.best = best
        node.meta = meta

    def take(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Every terminal with its whole key, in byte order."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.rows:
                yield key, node
            stack += [(node.children[b], key) for b in sorted(node.children, reverse=True)]

    def spill(self, keep: bytes | None = None) -> Iterator[tuple[bytes, Node]]:
        """Give up subtrees below the root's branching point: all, or all but the one on the path of ``keep``."""
        node, prefix = self.root, b""
        while keep is not None and not node.rows and len(node.children) == 1 and (child := next(iter(node.children.values()))):
            if not keep.startswith(child.label, len(prefix) + len(node.label)):
                break
            prefix += node.label
            node = child
        on = keep[len(prefix) + len(node.label)] if keep is not None and len(keep) > len(prefix) + len(node.label) else None
        for byte in sorted(node.children):
            if byte != on:
                freed = 0
                for key, terminal in self.take(node.children[byte], prefix + node.label):
                    freed += len(key)
                    yield key, terminal
                del node.children[byte]
        self.size = sum(len(k) + 200 for k, _ in self.take())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[:mid] == key[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


_OWNER_SCHEMA = "body_len bigint, body_hash binary, body binary, chars bigint, id bigint, rows bigint"
_KEEP_SCHEMA = "text_sha256 string, keep_id bigint, group_size bigint"
_LAST = (1 << 63) - 1


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: each distinct text of a partition once, with its best row and its number of rows."""
    trie, digests = Patricia(), {}

    def flush(found):
        rows, size = [], 0
        for key, node in found:
            rows.append((len(key), node.meta, key, -node.best[0], node.best[1], node.rows))
            size += len(key)
            if size >= _BATCH_BYTES:
                yield _batch(rows, _OWNER_ARROW)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _OWNER_ARROW)

    for batch in batches:
        ids, chars, bodies = (batch.column(c) for c in ("id", "chars", "body"))
        for i in range(batch.num_rows):
            body = bodies[i].as_py().translate(None, WHITE)
            row_id = ids[i].as_py()
            trie.insert(body, (-chars[i].as_py(), _LAST if row_id is None else row_id), 1, sha256(body).digest()[:16])
            if trie.size > TRIE_BYTES:
                yield from flush(trie.spill())
                trie = Patricia()
    yield from flush(trie.take())


_OWNER_ARROW = pa.schema([("body_len", pa.int64()), ("body_hash", pa.binary()), ("body", pa.binary()), ("chars", pa.int64()), ("id", pa.int64()), ("rows", pa.int64())])
_KEEP_ARROW = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, sorted by length and hash: full byte strings meet in one trie; finished subtrees leave it."""
    trie, current = Patricia(), None

    def flush(found):
        rows = [(sha256(key[24:]).hexdigest(), None if node.best[1] == _LAST else node.best[1], node.rows) for key, node in found]
        for at in range(0, len(rows), 10_000):
            yield _batch(rows[at : at + 10_000], _KEEP_ARROW)

    for batch in batches:
        columns = [batch.column(c) for c in ("body_len", "body_hash", "body", "chars", "id", "rows")]
        for i in range(batch.num_rows):
            size, digest, body, chars, row_id, rows = (c[i].as_py() for c in columns)
            head = size.to_bytes(8, "big") + digest
            if head != current and trie.size > TRIE_BYTES:
                # Rows come in order of length and hash: no subtree left of this one can grow any more.
                yield from flush(trie.spill(head))
            current = head
            trie.insert(head + body, (-chars, row_id), rows, None)
    yield from flush(trie.take())


_DIGEST_SCHEMA = "id bigint, text_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [sha256(b.as_py().translate(None, WHITE)).hexdigest() for b in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.string())], names=["id", "text_sha256"])


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``: which row stays of texts that differ in white space only.

    The row with the most code points stays, then the smallest key. Each partition first reduces its texts in a trie,
    so a text that fills a third of all rows reaches its owner once per partition. Owners are partitions by length and
    content hash; they compare whole byte strings. Every row then looks its group up by SHA-256; that join is a plain
    equi-join of narrow rows, which adaptive execution splits where a group is hot.

    Null texts are empty. Null keys rank last and keep a group only if it has no other key. Rows that repeat a key with
    an equal text share its verdict. Other columns are not carried; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.char_length(body).cast("bigint").alias("chars"), body.cast("binary").alias("body"))
    owners = rows.mapInArrow(_owners, _OWNER_SCHEMA)
    placed = owners.repartition("body_len", "body_hash").sortWithinPartitions("body_len", "body_hash")
    winners = placed.mapInArrow(_winners, _KEEP_SCHEMA)
    digests = rows.select("id", "body").mapInArrow(_digests, _DIGEST_SCHEMA)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return digests.join(winners, "text_sha256").select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
