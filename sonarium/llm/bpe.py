"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Pieces and token pairs whose results a worker keeps; the stores are emptied when full.
CACHE_PIECES = 300_000
CACHE_PAIRS = 500_000
_BATCH_BYTES = 4 << 20
_NEVER = 1 << 62
#: The byte-level pre-tokenizer's pattern, white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same pattern for texts of ASCII and Latin letters only, where the classes are plain ranges.
_LATIN, _SIGN, _SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~", r"\t-\r "
LATIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[{_SIGN}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Bpe:
    """A byte-level vocabulary with merges.

    The encoding of a text's prefix ends in one token that only depends on the prefix. A token can be last if the token
    before it, itself last of the shorter prefix, is compatible: merging by rank would not join them across the border.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merge.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.rank_of[whole] = pair, rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        output = self.bytes_of | {i: t.encode() for t, i in self.special.items()}
        ordered = [output.get(i, b"") for i in range(max(output) + 2)]
        self.flat = np.frombuffer(b"".join(ordered), np.uint8)
        self.sizes = np.array(list(map(len, ordered)), np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.pairs = _Pieces(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), CACHE_PAIRS)
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if i not in self.parts and len(b) > 1:
                continue
            if len(b) == 1 or self._compatible(*self.parts[i], own=self.rank_of[i]):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.pieces = _Pieces(self._encode_piece, CACHE_PIECES)
        self.find_any, self.find_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.not_latin = re.compile(f"[^{_LATIN}{_SIGN}{_SPACE}0-9]").search
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _compatible(self, left: int, right: int, own: int | None = None) -> bool:
        """Whether no merge across the border comes before the merges that hide its two tokens.

        ``x`` runs over the tokens that end at the border while ``left`` is built, ``y`` over those that start there.
        Both are present until they are merged into their parents; of equal merges the one further left comes first.
        ``own`` leaves out the merge that makes the pair itself.
        """
        x, until_x = left, _NEVER
        while True:
            y, until_y = right, _NEVER
            while True:
                rank = self.merge.get((x, y))
                if rank is not None and rank != own and rank < until_x and rank <= until_y:
                    return False
                if y not in self.parts:
                    break
                until_y, y = self.rank_of[y], self.parts[y][0]
            if x not in self.parts:
                return True
            until_x, x = self.rank_of[x], self.parts[x][1]

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8").decode("latin-1")
        last: list[tuple | None] = [None] * (len(data) + 1)
        pairs = self.pairs
        for end, found in self.automaton.iter(data):
            end += 1
            if last[end] is None:
                start = end - found[1]
                before = last[start]
                if start == 0 or (before is not None and pairs[before[0] << 32 | found[0]]):
                    last[end] = found
        ids, at = array("I"), len(data)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        ids.reverse()
        return ids.tobytes()

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.not_latin(text) else self.find_latin(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(token in text for token in self.special):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        out = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.pieces.__getitem__, self.find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of token ids in UTF-8, special tokens included; ids that no token has add nothing."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        found = np.minimum(found, len(self.sizes) - 1)
        size = self.sizes[found]
        ends = np.cumsum(size)
        places = np.repeat(self.begins[found] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places].tobytes().decode("utf-8", "replace").encode()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows in runs of bounded size, so that long texts make short batches."""
    begin, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= _BATCH_BYTES:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``key, n_tokens`` and ``ids, decoded``, or with ``digests`` their ``ids_sha256, decoded_sha256``.

    Ids are those of merging by rank within the pieces of the byte-level pre-tokenizer; special tokens in a text are
    tokens. ``ids`` is an array, ``decoded`` the text that the ids give. Null texts are empty and have no tokens. One
    row per input row, no shuffle; other columns are not carried. ``path`` must lead to the vocabulary on every host.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _sliced(batch, "body"):
                ids = [bpe.encode(t) for t in part.column("body").to_pylist()]
                back = map(bpe.decode, ids)
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                if digests:
                    first = pa.array([sha256(i).hexdigest() for i in ids], pa.string())
                    second = pa.array([sha256(t).hexdigest() for t in back], pa.string())
                    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    first = pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))
                    second = pa.array([t.decode() for t in back], pa.string())
                    names = ["key", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column("key"), counts, first, second], names=names)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), body.alias("body"))
    return rows.mapInArrow(run, f"key bigint, n_tokens bigint, {kind}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the decoded text."""
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), digests=True)
    return coded.withColumnRenamed("key", "doc_id")
