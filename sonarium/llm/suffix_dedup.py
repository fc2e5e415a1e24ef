"""Removal of byte strings that occur elsewhere, by a suffix sort that compares prefix hashes.

Every window of ``width`` bytes has an anchor, the place in it of the half-width gram with the smallest hash. Equal
windows have equal anchors, so a window can repeat only where its anchor's gram does, and windows that follow each other
mostly share one. A run of windows with one anchor, with the bytes it covers, is a segment: a few of them describe a text.

1. Each block asks how often its grams and its whole segments occur in the corpus. That settles grams that occur once
   and grams whose segments are all alike.
2. Of the other grams each distinct segment is sent once to the task of its gram. There the suffixes from the anchor on
   and the prefixes before it are sorted; neighbours' common lengths tell which windows occur twice.
3. Grams with very many distinct segments would fill one task: their windows are counted by hash, spread over all ranges.

Blocks of texts, ranges of hashes and the packed entries between them are those of ``blocks``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import blocks, hashing

WIDTH = 200
#: Distinct segments of a gram that one task sorts; the windows of a more frequent gram are counted by hash instead.
GROUP_SEGMENTS = 20_000
#: Bytes of entries in a range, about.
RANGE_BYTES = 16 << 20
#: Bytes of segments that are sorted at a time.
SORT_BYTES = 1 << 20

OUT_SCHEMA = "key bigint, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"

#: What a range of entries holds; the kind stands above the range's number.
_GRAM, _SEGMENT, _SORT, _WINDOW, _STATE = range(5)
_KIND_SHIFT = 26
#: Answers about a gram.
_ONCE, _ALIKE, _MIXED, _CROWDED = range(4)
#: Answers about a segment.
_ALONE, _FIRST, _AGAIN = range(3)

_POSITION_BITS = np.uint64(20)


# ------------------------------------------------------------------------------------ anchors


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


@dataclass
class Segments:
    """Runs of window starts ``first..last`` with one anchor, in text order, and hashes of their grams and bytes."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    gram_range: np.ndarray
    whole: np.ndarray
    whole_range: np.ndarray


def segments_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Segments:
    """All segments of some texts; a window never crosses two texts.

    Of grams with equal hashes in a window the first is the anchor, which only depends on the window. The bytes are
    hashed a megabyte at a time.
    """
    gram = width // 2
    choices = width - gram + 1
    step = (1 << int(_POSITION_BITS)) - 4 * width
    if step < width:
        raise ValueError(f"windows of {width} bytes are too long")
    starts = offsets[:-1][np.diff(offsets) >= width]
    stops = offsets[1:][np.diff(offsets) >= width] - width + 1  # behind the last window
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    mask = np.uint64((1 << int(_POSITION_BITS)) - 1)
    for begin in range(0, len(data) - width + 1, step):
        end = min(begin + step, len(data) - width + 1)
        # One window before tells whether a segment begins here; a segment that begins here ends within ``choices``.
        low, high = max(0, begin - 1), min(len(data) - width + 1, end + choices)
        values = data[low : high + width].astype(np.uint64) + np.uint64(1)
        grams = len(values) - gram + 1
        hashes = hashing.mix(hashing.span_hash(values, slice(0, grams), slice(gram, gram + grams), hashing.BASES[0]))
        place = (hashes & ~mask) | np.arange(grams, dtype=np.uint64)
        anchor = _sliding_min(place, choices)[: high - low] & mask
        changes = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1 + low
        a, b = np.searchsorted(starts, (begin, end))
        first = np.union1d(changes[(changes >= begin) & (changes < end)], starts[a:b])
        text = np.searchsorted(starts, first, side="right") - 1
        inside = (text >= 0) & (first < stops[np.maximum(text, 0)]) if len(stops) else np.zeros(len(first), bool)
        first, text = first[inside], text[inside]
        if not len(first):
            continue
        after = np.append(changes, high)[np.searchsorted(changes, first, side="right")]
        last = np.minimum(after, stops[text]) - 1
        at = anchor[first - low].astype(np.int64)
        whole = [hashing.mix(hashing.span_hash(values, first - low, last - low + width, base)) for base in hashing.BASES]
        second = hashing.mix(hashing.span_hash(values, at, at + gram, hashing.BASES[1]))
        for column, piece in zip(columns, (first, last, at + low, hashes[at], second, *whole)):
            column.append(piece)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64)
    return Segments(*[np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(columns, kinds)])


def _sorted_texts(table: pa.Table) -> pa.Table:
    """Rows in an order of their own, so that every read of a block numbers its entries alike."""
    return table.take(pc.sort_indices(table.select(["key", "body"]), [("key", "ascending"), ("body", "ascending")]))


# ------------------------------------------------------------------------------------ suffix sort


class SuffixSorter:
    """Sorts suffixes of one buffer by their prefix hashes.

    A prefix hash of a suffix is two look-ups and a product, so the common length of two suffixes takes a binary search
    over lengths, and a comparison one byte more. Common lengths of neighbours are checked byte by byte in the end; where
    hashes have collided, the suffixes are sorted by their bytes.
    """

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(1, np.uint8))
        self.up, self.down = hashing._power_tables(hashing.BASES[0], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.copy()
        sums, down = self.sums, self.down
        base_a, base_b, scale_a, scale_b = sums[a], sums[b], down[a], down[b]
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = (sums[a + mid] - base_a) * scale_a == (sums[b + mid] - base_b) * scale_b
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def _less(self, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix ``i`` comes before suffix ``j``; of equal ones neither does."""
        most = np.minimum(size[i], size[j])
        same = self._common(begin[i], begin[j], most)
        ended = same == most
        return np.where(ended, size[i] < size[j], self.data[begin[i] + np.where(ended, 0, same)] < self.data[begin[j] + np.where(ended, 0, same)])

    def sort(self, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within their groups, and how much each shares with the one before it (-1 for the first).

        ``group`` numbers rise. All groups are merged at once: an item's place in a merged run is its place in its own
        plus the number of items of the other run before it, found by binary search.
        """
        n = len(begin)
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, n))
        head, length = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        order, width = np.arange(n), 1
        while width < sizes.max(initial=0):
            slots = np.flatnonzero(length > width)
            local = slots - head[slots]
            own = local // width
            pair = local - local % (2 * width)
            left = own % 2 == 0
            other = head[slots] + np.where(left, pair + width, pair)
            count = np.where(left, np.clip(length[slots] - pair - width, 0, width), width)
            item = order[slots]
            low, high = np.zeros(len(slots), np.int64), count.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                x, y = item[open_], order[other[open_] + mid]
                is_left = left[open_]
                # A left item goes behind smaller ones, a right item behind smaller and equal ones: the merge is stable.
                before = self._less(begin, size, np.where(is_left, y, x), np.where(is_left, x, y)) == is_left
                low[open_[before]], high[open_[~before]] = mid[before] + 1, mid[~before]
                open_ = open_[low[open_] < high[open_]]
            merged = order.copy()
            merged[head[slots] + pair + local % width + low] = item
            order, width = merged, 2 * width
        a, b = order[:-1], order[1:]
        shared = np.full(n, -1)
        if n:
            shared[1:] = self._common(begin[a], begin[b], np.minimum(size[a], size[b]))
        shared[heads] = -1
        return (order, shared) if self._proven(begin, size, order, shared) else self._by_bytes(begin, size, heads, sizes)

    def _proven(self, begin: np.ndarray, size: np.ndarray, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours share what they are said to share, and stand in order behind it."""
        rows = np.flatnonzero(shared >= 0)
        a, b, n = order[rows - 1], order[rows], shared[rows]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        if not np.array_equal(self.data[np.repeat(begin[a], n) + at], self.data[np.repeat(begin[b], n) + at]):
            return False
        inner = n < np.minimum(size[a], size[b])
        last = np.where(inner, n, 0)
        return bool(np.where(inner, self.data[begin[a] + last] < self.data[begin[b] + last], (n == size[a]) & (size[a] <= size[b])).all())

    def _by_bytes(self, begin: np.ndarray, size: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = self.data.tobytes()
        found = [text[b : b + s] for b, s in zip(begin.tolist(), size.tolist())]
        order = np.concatenate([np.zeros(0, np.int64), *[h + np.array(sorted(range(n), key=lambda i: found[h + i]), np.int64) for h, n in zip(heads.tolist(), sizes.tolist())]])
        shared = np.full(len(order), -1)
        for k in set(range(len(order))) - set(heads.tolist()):
            one, two = found[order[k - 1]], found[order[k]]
            most = min(len(one), len(two))
            different = np.flatnonzero(np.frombuffer(one, np.uint8, most) != np.frombuffer(two, np.uint8, most)) if most else []
            shared[k] = different[0] if len(different) else most
        return order, shared


def repeated_windows(data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each segment and offset of its anchor in a window: whether that window occurs in another segment, too.

    ``lead`` bytes stand before a segment's anchor; ``group`` numbers rise. Windows are equal if their anchors are in one
    class of suffixes and in one class of prefixes: neighbours in the sorted order that share enough.
    """
    n, choices = len(lead), width - width // 2 + 1
    size = np.diff(offsets)
    anchor = offsets[:-1] + lead
    right, right_shared = SuffixSorter(data).sort(anchor, size - lead, group)
    # A prefix read backwards is a suffix of the reversed buffer.
    left, left_shared = SuffixSorter(data[::-1].copy()).sort(len(data) - anchor, lead, group)
    out = np.zeros((n, choices), bool)
    behind, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(choices):
        has = np.flatnonzero((lead >= offset) & (lead - (size - width) <= offset))
        if not len(has):
            continue
        behind[right] = np.cumsum(right_shared < width - offset)
        before[left] = np.cumsum(left_shared < offset)
        name = behind[has] * (n + 1) + before[has]
        order = np.argsort(name, kind="stable")
        equal = name[order[1:]] == name[order[:-1]]
        twice = np.zeros(len(has), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        out[has, offset] = twice
    return out


# ------------------------------------------------------------------------------------ blocks and ranges


def _digests(values: np.ndarray) -> bytes:
    return blocks.pack(values)


def _kind(kind: int, table: pa.Table) -> pa.Table:
    """The rows of one kind, with plain range numbers."""
    span = table.column("span").to_numpy()
    mine = np.flatnonzero(span >> _KIND_SHIFT == kind)
    part = table.take(pa.array(mine))
    return part.set_column(part.schema.get_field_index("span"), "span", pa.array(span[mine] & ((1 << _KIND_SHIFT) - 1), pa.int32()))


def _of_kind(kind: int, table: pa.Table) -> pa.Table:
    span = pa.array(table.column("span").to_numpy() | kind << _KIND_SHIFT, pa.int32())
    return table.set_column(table.schema.get_field_index("span"), "span", span)


def _ask(width: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """Grams with what their segments look like, and segments, each once for the block."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted_texts(table)
        found = segments_of(*hashing.texts_buffer(table.column("body")), width)
        entries = _Entries(found)
        block = table.column("block")[0].as_py()
        grams = blocks.ask(
            block, entries.gram, entries.gram_range, bits, lambda part: _digests(entries.digest[part]) + entries.code[part].tobytes()
        )
        wholes = blocks.ask(block, entries.whole, entries.whole_range, bits, lambda part: entries.twice[part].tobytes())
        return pa.concat_tables([_of_kind(_GRAM, grams), _of_kind(_SEGMENT, wholes)])

    return run


class _Entries:
    """The distinct grams and segments of a block."""

    def __init__(self, found: Segments):
        order, begin = blocks.groups_of(found.whole)
        sizes = np.diff(np.append(begin, len(order)))
        self.whole_head = order[begin]
        self.whole, self.whole_range = found.whole[self.whole_head], found.whole_range[self.whole_head]
        self.twice = (sizes > 1).astype(np.uint8)
        self.whole_of = np.empty(len(order), np.int64)
        self.whole_of[order] = np.repeat(np.arange(len(begin)), sizes)
        order, begin = blocks.groups_of(found.gram)
        sizes = np.diff(np.append(begin, len(order)))
        head = order[begin]
        self.gram, self.gram_range = found.gram[head], found.gram_range[head]
        self.gram_of = np.empty(len(order), np.int64)
        self.gram_of[order] = np.repeat(np.arange(len(begin)), sizes)
        # Distinct segments of a gram: 0 one occurrence, 1 alike, above that the power of two that holds their number.
        variants = np.bincount(self.gram_of[self.whole_head], minlength=len(begin))
        self.code = np.where(variants > 1, 2 + np.ceil(np.log2(np.maximum(variants, 2))), sizes > 1).astype(np.uint8)
        self.digest = found.whole[head]


def _count_range(limit: int) -> Callable[[pa.Table], pa.Table]:
    """Answers for a range of grams or of segments."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")  # the first block with a segment is the same in every run
        kind = table.column("span")[0].as_py() >> _KIND_SHIFT
        blobs = [b.as_py() for b in table.column("keys")]
        extras = [b.as_py() for b in table.column("extra")]
        sizes = np.array([len(b) // blocks.KEY_BYTES for b in blobs], np.int64)
        order, begin = blocks.groups_of(np.concatenate([blocks.unpack(b) for b in blobs]))
        count = np.diff(np.append(begin, len(order)))
        if kind == _GRAM:
            code = np.concatenate([np.frombuffer(x, np.uint8, n, blocks.KEY_BYTES * n) for x, n in zip(extras, sizes)])[order]
            digest = np.concatenate([blocks.unpack(x[: blocks.KEY_BYTES * n]) for x, n in zip(extras, sizes)])[order]
            alike = (np.minimum.reduceat(digest, begin) == np.maximum.reduceat(digest, begin)) & (np.maximum.reduceat(code, begin) < 2)
            variants = np.add.reduceat(np.where(code < 2, 1.0, 2.0 ** (code.astype(np.float64) - 2)), begin)
            once = (count == 1) & (code[begin] == 0)
            group = np.where(once, _ONCE, np.where(alike, _ALIKE, np.where(variants <= limit, _MIXED, _CROWDED))).astype(np.uint8)
            found = np.empty(len(order), np.uint8)
            found[order] = np.repeat(group, count)
        else:
            twice = np.concatenate([np.frombuffer(x, np.uint8) for x in extras])[order]
            more = (count > 1) | (np.maximum.reduceat(twice, begin) > 0)
            found = np.empty(len(order), np.uint8)
            found[order] = np.repeat(np.where(more, _AGAIN, _ALONE), count)
            found[order[begin[more]]] = _FIRST
        return _answers(table, found, sizes)

    return run


def _answers(table: pa.Table, found: np.ndarray, sizes: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return pa.table({
        "block": table.column("block").cast(pa.int32()), "span": table.column("span").cast(pa.int32()),
        "answer": pa.array([found[e - n : e].tobytes() for n, e in zip(sizes, ends)], pa.binary()),
    })


def _windows(lead: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and window number of all windows of some segments."""
    count = size - width + 1
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(lead)), count)
    return owner, np.arange(len(owner)) - np.repeat(ends - count, count)


def _send(width: int, bits: int, sort_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the counts leave open: segments to sort, windows to count, and the block's own notes on both."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({"span": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "extra": pa.array([], pa.binary())})
        table = _sorted_texts(table)
        data, offsets = hashing.texts_buffer(table.column("body"))
        found = segments_of(data, offsets, width)
        entries = _Entries(found)
        block = table.column("block")[0].as_py()
        gram = blocks.answers_in_order(_kind(_GRAM, answers), entries.gram_range, bits, np.uint8)[entries.gram_of]
        whole = blocks.answers_in_order(_kind(_SEGMENT, answers), entries.whole_range, bits, np.uint8)
        settled = whole[entries.whole_of] != _ALONE
        head = entries.whole_head
        goes = head[(gram[head] >= _MIXED) & (whole != _AGAIN)]
        sent = goes[gram[goes] == _MIXED]
        counted = goes[gram[goes] == _CROWDED]
        size = found.last - found.first + width
        lead = found.anchor - found.first

        def packed(part: np.ndarray) -> bytes:
            rows = sent[part]
            ends = np.cumsum(size[rows])
            at = np.arange(ends[-1]) - np.repeat(ends - size[rows] - found.first[rows], size[rows])
            return size[rows].astype(np.uint32).tobytes() + lead[rows].astype(np.uint32).tobytes() + data[at].tobytes()

        segments = blocks.ask(block, found.gram[sent], found.gram_range[sent], sort_bits, packed)
        owner, number = _windows(lead[counted], size[counted], width)
        start = found.first[counted][owner] + number
        first, second = _window_hashes(data, start, width)
        order, begin = blocks.groups_of(first)
        sizes = np.diff(np.append(begin, len(order)))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(begin)), sizes)
        twice = (sizes > 1).astype(np.uint8)
        windows = blocks.ask(block, first[order[begin]], second[order[begin]], bits, lambda part: twice[part].tobytes())
        # Notes: settled intervals; segments in the order of their answers; windows and their entries.
        by_range, _ = blocks.by_range(found.gram_range[sent], sort_bits)
        window_range, _ = blocks.by_range(second[order[begin]], bits)
        place = np.empty(len(window_range), np.int64)
        place[window_range] = np.arange(len(window_range))
        notes = _pack_notes(
            _merged(found.first[settled], found.last[settled] + width, offsets),
            found.anchor[sent[by_range]][None, :],
            np.stack([start, place[entry]]),
        )
        state = pa.table({"span": pa.array([block], pa.int32()), "block": pa.array([block], pa.int32()), "keys": pa.array([notes], pa.binary()), "extra": pa.array([b""], pa.binary())})
        return pa.concat_tables([_of_kind(_SORT, segments), _of_kind(_WINDOW, windows), _of_kind(_STATE, state)])

    return run


def _window_hashes(data: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, by pieces of the buffer; ``start`` may come in any order."""
    order = np.argsort(start, kind="stable")
    ordered = start[order]
    out = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    at = 0
    while at < len(order):
        low = int(ordered[at])
        to = int(np.searchsorted(ordered, low + hashing.PIECE, side="right"))
        values = data[low : low + hashing.PIECE + width].astype(np.uint64) + np.uint64(1)
        for target, base in zip(out, hashing.BASES):
            here = ordered[at:to] - low
            target[order[at:to]] = hashing.mix(hashing.span_hash(values, here, here + width, base))
        at = to
    return out


def _pack_notes(*tables: np.ndarray) -> bytes:
    shapes = np.array([x for t in tables for x in t.shape], np.int64)
    return shapes.tobytes() + b"".join(t.astype(np.int32).tobytes() for t in tables)


def _unpack_notes(blob: bytes) -> list[np.ndarray]:
    shapes = np.frombuffer(blob, np.int64, 6).reshape(3, 2)
    out, at = [], 48
    for rows, columns in shapes.tolist():
        out.append(np.frombuffer(blob, np.int32, rows * columns, at).reshape(rows, columns).astype(np.int64))
        at += 4 * rows * columns
    return out


def _merged(first: np.ndarray, stop: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Begin and end of the maximal intervals that ``[first, stop)`` cover, cut at texts' ends."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], stop[order]
    if not len(first):
        return np.zeros((2, 0), np.int64)
    reach = np.maximum.accumulate(stop)
    text = np.searchsorted(offsets, first, side="right")
    new = np.append(True, (first[1:] > reach[:-1]) | (text[1:] != text[:-1]))
    heads = np.flatnonzero(new)
    return np.stack([first[heads], reach[np.append(heads[1:], len(first)) - 1]])


def _sort_range(width: int) -> Callable[[pa.Table], pa.Table]:
    """Answers for a range of segments or of windows; notes pass through."""

    def segments(table: pa.Table) -> pa.Table:
        grams, sizes, leads, texts = [], [], [], []
        for keys, extra in zip(table.column("keys"), table.column("extra")):
            grams.append(blocks.unpack(keys.as_py()))
            n, blob = len(grams[-1]), np.frombuffer(extra.as_buffer(), np.uint8)
            sizes.append(blob[: 4 * n].view(np.uint32).astype(np.int64))
            leads.append(blob[4 * n : 8 * n].view(np.uint32).astype(np.int64))
            texts.append(blob[8 * n :])
        per_row = np.array([len(g) for g in grams])
        gram, size, lead, data = np.concatenate(grams), np.concatenate(sizes), np.concatenate(leads), np.concatenate(texts)
        begin = np.cumsum(size) - size
        order, heads = blocks.groups_of(gram)
        bounds = np.append(heads, len(order))
        filled = np.append(0, np.cumsum(size[order]))[bounds]
        repeated = np.zeros((len(gram), width - width // 2 + 1), bool)
        at = 0
        while at < len(heads):  # whole groups, about SORT_BYTES at a time
            to = max(at + 1, int(np.searchsorted(filled, filled[at] + SORT_BYTES, side="right")) - 1)
            rows = order[bounds[at] : bounds[to]]
            ends = np.cumsum(size[rows])
            places = np.arange(ends[-1]) - np.repeat(ends - size[rows] - begin[rows], size[rows])
            group = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
            repeated[rows] = repeated_windows(data[places], np.append(0, ends), lead[rows], group, width)
            at = to
        bits = np.packbits(repeated, axis=1)
        return _answers(table, bits, per_row)

    def windows(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("keys")]
        sizes = np.array([len(b) // blocks.KEY_BYTES for b in blobs], np.int64)
        order, begin = blocks.groups_of(np.concatenate([blocks.unpack(b) for b in blobs]))
        count = np.diff(np.append(begin, len(order)))
        twice = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("extra")])[order]
        found = np.empty(len(order), np.uint8)
        found[order] = np.repeat((count > 1) | (np.maximum.reduceat(twice, begin) > 0), count)
        return _answers(table, found, sizes)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("span")[0].as_py() >> _KIND_SHIFT
        if kind == _STATE:
            return pa.table({"block": table.column("block"), "span": table.column("span"), "answer": table.column("keys")})
        return segments(table) if kind == _SORT else windows(table)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _cut(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({"key": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})
        table = _sorted_texts(table)
        data, offsets = hashing.texts_buffer(table.column("body"))
        settled, sent, counted = _unpack_notes(_kind(_STATE, answers).column("answer")[0].as_py())
        by_span = _kind(_SORT, answers).sort_by("span")
        choices = width - width // 2 + 1
        bits = np.frombuffer(b"".join(b.as_py() for b in by_span.column("answer")), np.uint8).reshape(sent.shape[1], -(-choices // 8))
        row, offset = np.nonzero(np.unpackbits(bits, axis=1, count=choices))
        start = sent[0][row] - offset
        by_span = _kind(_WINDOW, answers).sort_by("span")
        twice = np.frombuffer(b"".join(b.as_py() for b in by_span.column("answer")), np.uint8)
        more = counted[0][twice[counted[1]] > 0]
        first = np.concatenate([settled[0], start, more])
        stop = np.concatenate([settled[1], start + width, more + width])
        begins, stops = _merged(first, stop, offsets)
        edges = np.searchsorted(begins, offsets)
        spans, kept = [], []
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            mine = list(zip(begins[edges[i] : edges[i + 1]].tolist(), stops[edges[i] : edges[i + 1]].tolist()))
            spans.append([{"start": s - low, "length": e - s} for s, e in mine])
            cuts = [low, *[x for pair in mine for x in pair], high]
            kept.append(b"".join(data[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2])))
        return pa.table({
            "key": table.column("key").combine_chunks(), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary()),
        })

    return run


# ------------------------------------------------------------------------------------ operator


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, block_bytes: int = blocks.BLOCK_BYTES,
                 group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """``key, n_bytes, spans, kept``: maximal runs of bytes covered by strings that also start somewhere else.

    A text is its UTF-8 bytes; a string is ``width`` of them in one text. A byte goes if any such string that covers it
    starts at another place, of the same text or another, overlapping or not; strings are judged on the input. ``kept``
    are the other bytes. So of equal passages no copy stays.

    Segments of a gram are compared byte by byte, unless they are more than ``group_segments``; then windows are told
    apart by 56 bits of one hash and, through the number of the range, some bits of another. Whether a gram or a whole
    segment occurs again is told by hashes of the same size.

    Null texts are empty; keys may be null or repeat. Each input row gives one row; other columns are not carried.
    """
    if width < 2:
        raise ValueError("a string needs two bytes at least")
    layout = blocks.block_layout(docs, text, block_bytes)
    # A segment takes about a quarter of the width in window starts; its entries take some 24 bytes.
    entries = layout.blocks * block_bytes * 4 // width * 24
    bits = max(6, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length(), (entries // RANGE_BYTES).bit_length())
    sort_bits = min(bits + 3, _KIND_SHIFT)
    texts = blocks.dealt(docs, key, text, layout)
    asked = texts.groupBy("block").applyInArrow(_ask(width, bits), blocks.ASK_SCHEMA)
    counts = asked.groupBy("span").applyInArrow(_count_range(group_segments), blocks.ANSWER_SCHEMA)
    left = texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_send(width, bits, sort_bits), blocks.ASK_SCHEMA)
    found = left.groupBy("span").applyInArrow(_sort_range(width), blocks.ANSWER_SCHEMA)
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(width), OUT_SCHEMA)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest after strings of 200 bytes that occur elsewhere are removed."""
    cut = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return cut.select(
        F.col("key").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP11_SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strips AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 1398) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 500)) AS o FROM bytes)
), windows AS (
  SELECT doc_id, o + i AS i, md5(substr(p, 2 * i + 1, 400)) AS d FROM (SELECT doc_id, o, p, unnest(range(0, least(500, len(p) // 2 - 199))) AS i FROM strips)
), again AS (
  SELECT d FROM windows GROUP BY d HAVING count(*) > 1
), marked AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows SEMI JOIN again USING (d)
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, r
), pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f, s AS t FROM spans
  UNION ALL SELECT doc_id, max(e), 1000000000 FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 1000000000 FROM bytes ANTI JOIN spans USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - s) AS m, count(*) AS c FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
