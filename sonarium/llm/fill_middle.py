"""Fill-in-middle rewriting of texts, with cuts found in a learned rank index over unit boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest distance of a boundary from its segment's line; a residual takes one byte.
ERROR = 127
#: Ranks in a segment before it is first checked.
SPAN = 2048
#: Bytes of text that are indexed at a time.
BATCH_BYTES = 2 << 20

OUT_SCHEMA = "key bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


class RankIndex:
    """Offsets by rank: straight segments within ``error`` of every offset, and what is left over in one byte each.

    Segments start at ``span`` ranks and are halved until their line, drawn between their first and last offsets, is near
    enough to every offset in them; two offsets always are.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR, span: int = SPAN):
        if not 0 <= error <= ERROR:
            raise ValueError(f"a residual of one byte holds errors from 0 to {ERROR}")
        count = len(offsets)
        self.residual = np.zeros(count, np.int8)
        first = np.arange(0, count, span)
        size = np.minimum(span, count - first)
        fitted = []
        while len(first):
            start = np.cumsum(size) - size
            piece = np.repeat(np.arange(len(first)), size)
            step = np.arange(len(piece)) - start[piece]
            rank = first[piece] + step
            base, run = offsets[first], np.maximum(size - 1, 1)
            rise = offsets[first + size - 1] - base
            left = offsets[rank] - base[piece] - step * rise[piece] // run[piece]
            near = np.maximum.reduceat(np.abs(left), start) <= error
            self.residual[rank[near[piece]]] = left[near[piece]]
            fitted.append((first[near], base[near], rise[near], run[near]))
            far, half = first[~near], size[~near] // 2
            first, size = np.concatenate([far, far + half]), np.concatenate([half, size[~near] - half])
        columns = [np.concatenate(c) for c in zip(*fitted)] if fitted else [np.zeros(0, np.int64)] * 4
        order = np.argsort(columns[0])
        self.first, self.base, self.rise, self.run = (c[order] for c in columns)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Where the segments' lines place the ranks."""
        piece = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[piece] + (ranks - self.first[piece]) * self.rise[piece] // self.run[piece]

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets: predictions put right by their residuals."""
        return self.predict(ranks) + self.residual[ranks]


def unit_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets at which units ``[A-Za-z]+|[^A-Za-z]`` of the joined texts begin, with the end; where texts begin."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    letter = (points | np.uint32(32)) - np.uint32(97) < 26
    start = np.ones(len(points) + 1, bool)
    start[1:-1] = ~(letter[1:] & letter[:-1])
    start[begins] = True
    return np.flatnonzero(start), begins


def draws(key: int | None, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers from the digest of ``seed:key``; a missing key is empty."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def restore(output: str, form: str) -> str:
    """The text that an output was made from. Texts that hold a marker stay plain, so the first marker is the true one."""
    if form == "plain":
        return output
    head, tail = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(head) :].partition(tail)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def rewrite(keys: list[int | None], texts: list[str], seed: int, plain: int, spm: int) -> dict[str, list]:
    """The columns of ``OUT_SCHEMA`` for some texts."""
    starts, begins = unit_starts(texts)
    low = np.searchsorted(starts, begins)
    counts = np.diff(low)
    drawn = [draws(k, seed) for k in keys]
    cut = np.array([sorted((d[0] % (n + 1), d[1] % (n + 1))) for d, n in zip(drawn, counts.tolist())], np.int64).reshape(-1, 2)
    at = RankIndex(starts).offsets(low[:-1, None] + cut) - begins[:-1, None]
    out = {name: [] for name in ("form", "prefix_chars", "middle_chars", "output", "restored")}
    for (_, _, third, fourth), text, (a, b) in zip(drawn, texts, at.tolist()):
        if not text or third % 100 >= 100 - plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            form, output, sizes = "plain", text, (None, None)
        else:
            form, sizes = "spm" if fourth % 100 < spm else "psm", (a, b - a)
            head, tail = PREFIX + text[:a], SUFFIX + text[b:]
            output = (tail + head if form == "spm" else head + tail) + MIDDLE + text[a:b]
        for name, value in zip(out, (form, *sizes, output, restore(output, form))):
            out[name].append(value)
    return {"key": keys, "n": counts, **out}


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output, restored``: texts cut in three and put in another order.

    A text is ``n`` units, runs of ASCII letters or single other code points. Its two cuts fall after numbers of units
    drawn from the digest of ``seed:key``, so reruns agree. ``plain`` percent of the texts, empty texts and those that
    hold a marker stay as they are, with null sizes; of the others ``spm`` percent put the suffix first. ``restored`` is
    read back from the output alone.

    The boundaries of all units are indexed by straight segments with residuals (``RankIndex``), a few megabytes of
    texts at a time. Null texts are empty; rows without a key share the draws of an empty one, repeated keys share
    theirs. One row per input row, no shuffle; other columns are not carried.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.by_bytes(batch, "body", BATCH_BYTES):
                made = rewrite(part.column("key").to_pylist(), part.column("body").to_pylist(), seed, plain, spm)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(run, OUT_SCHEMA)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, part sizes and the digests of its output and of the text read back from it."""
    made = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS third, CAST('0x' || h[25:32] AS BIGINT) % 100 AS fourth
  FROM units
), parts AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR third >= 90 THEN 'plain'
              WHEN fourth < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
