"""Suffix sort dedup, whitening and fill-in-middle against brute force."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest

from sonarium.llm import fill_middle, suffix_dedup, whitening
from sonarium.session import materialize

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------ suffix dedup


def brute_cut(texts, width):
    """``(bytes, spans, kept)`` of every text."""
    bodies = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + width] for t in bodies for i in range(len(t) - width + 1))
    out = []
    for t in bodies:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        spans = tuple((int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2]))
        out.append((len(t), spans, bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return out


def passages():
    random = np.random.default_rng(3)
    base = ["".join(random.choice(list("abé ű"), n)) for n in (300, 200, 150)]
    texts = [
        base[0], base[1] + base[0][50:120], base[0][:100] + base[2] + base[0][100:], None, "", "ab", "a" * 90, "xy" * 60, base[2], base[2],
        "q" + base[2][:40] + "r", "s" + base[2][3:45] + "t", "u" + base[2][5:50] + "v", *[f"z{i}{base[1][20:60]}{i}{i}" for i in range(30)],
    ]
    return texts, [5, 3, 8, 1, 2, 0, 9, 10, None, None, 7, 7, 12, *range(20, 50)]


@pytest.mark.parametrize("width, block_bytes, group", [(20, 1 << 20, 20_000), (20, 300, 20_000), (20, 300, 2), (7, 500, 4), (41, 400, 1)])
def test_suffix_dedup_matches_brute_force(spark, width, block_bytes, group):
    """One block and many; segments sorted in groups, and windows of crowded grams counted; null and repeated keys."""
    texts, ids = passages()
    rows = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id bigint, text string, kept int")
    got = suffix_dedup.suffix_dedup(rows, width=width, block_bytes=block_bytes, group_segments=group).collect()
    want = collections.Counter((i, *x) for i, x in zip(ids, brute_cut(texts, width)))
    assert collections.Counter((r.key, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert sum(length for x in want for _, length in x[2]) > 0


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    """Texts longer than what is hashed at a time have the same segments."""
    random = np.random.default_rng(5)
    data = random.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 3000, 3019, 5000])
    whole = suffix_dedup.segments_of(data, offsets, 20)
    monkeypatch.setattr(suffix_dedup, "_POSITION_BITS", np.uint64(8))
    pieces = suffix_dedup.segments_of(data, offsets, 20)
    windows = [sum(max(0, int(n) - 19) for n in np.diff(offsets))] * 2
    assert [int((s.last - s.first + 1).sum()) for s in (whole, pieces)] == windows
    for name in ("first", "last"):
        assert np.all(np.diff(getattr(pieces, name)) > 0)
    ends = np.searchsorted(offsets, pieces.first, side="right")
    assert np.all(pieces.last + 20 <= offsets[ends])


def test_suffix_sort_is_a_sort():
    random = np.random.default_rng(2)
    data = random.integers(0, 2, 600).astype(np.uint8)
    begin = random.integers(0, 500, 200)
    size = np.minimum(random.integers(0, 60, 200), 600 - begin)
    group = np.sort(random.integers(0, 5, 200))
    order, shared = suffix_dedup.SuffixSorter(data).sort(begin, size, group)
    texts = [data[b : b + s].tobytes() for b, s in zip(begin, size)]
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], texts[i], i))
    for k in range(1, 200):
        one, two = texts[order[k - 1]], texts[order[k]]
        common = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        assert shared[k] == (common if group[order[k]] == group[order[k - 1]] else -1)


def test_collisions_are_noticed(monkeypatch):
    """If all hashes are equal, the order and the common lengths still are those of the bytes."""
    random = np.random.default_rng(4)
    data = random.integers(97, 100, 300).astype(np.uint8)
    begin, size, group = np.arange(0, 200, 2), np.full(100, 30), np.repeat([0, 1], 50)
    want = suffix_dedup.SuffixSorter(data).sort(begin, size, group)
    blind = suffix_dedup.SuffixSorter(data)
    blind.sums[:] = 0
    got = blind.sort(begin, size, group)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


# ------------------------------------------------------------------------------------ whitening


VECTORS = "vec_id bigint, embedding array<float>, component int, x int"


def brute_whitening(vectors):
    """Scaled rows, fit list size, sums, eigenvalues and eigenvectors by numpy."""
    x = np.floor(256.0 * np.array(vectors, np.float64)).astype(np.int64)
    unique = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(unique.T, bias=True))
    return x, len(unique), unique.sum(0), values[::-1], axes.T[::-1]


def test_whitening_matches_numpy(spark):
    random = np.random.default_rng(0)
    good = (random.normal(size=(300, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1])).astype(np.float32)
    good[200:] = good[7]  # a third of the rows is one vector
    rows = [(i if i % 50 else None, v.tolist(), 1, 2) for i, v in enumerate(good)]
    odd = [(900, None, 1, 2), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (902, [float("nan")] * 6, 1, 2), (903, [float("inf")] + [0.0] * 5, 1, 2), (904, [], 1, 2)]
    vectors = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    distinct = materialize(whitening.fit_list(vectors), "fit")
    fitted = whitening.fit(distinct)
    x, n, sums, values, axes = brute_whitening(good)
    assert (fitted.n, list(fitted.sums)) == (n, sums.tolist())
    assert np.allclose(fitted.variances, values[:4], rtol=1e-12) and abs(fitted.total - values.sum()) < 1e-9
    assert np.allclose(np.abs((fitted.directions * axes[:4]).sum(1)), 1, atol=1e-12)
    assert np.allclose(fitted.directions @ fitted.directions.T, np.eye(4), atol=1e-13)
    got = whitening.whiten(vectors, fitted).collect()
    deviation = ((n * x - sums) ** 2).sum(1).tolist()
    want = collections.Counter((i if i % 50 else None, c, n, deviation[i]) for i in range(300) for c in (1, 2, 3, 4))
    assert collections.Counter((r.key, r.component, r.n, r.deviation) for r in got) == want
    by_row = {(r.key, r.component): r for r in got}
    for c in (1, 2, 3, 4):
        direction = axes[c - 1] * np.sign(axes[c - 1] @ fitted.directions[c - 1])
        for i in (1, 7, 199, 299):
            row = by_row[i, c]
            assert abs(row.whitened - (x[i] - sums / n) @ direction / np.sqrt(values[c - 1])) < 1e-9
            assert abs(row.explained - values[c - 1] / values.sum()) < 1e-9
    assert whitening.identity_error(distinct, fitted) < 1e-10


@pytest.mark.parametrize("vectors, directions", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0], [1.0, 2.0]], 0), ([[0.0, 0.0, 1.0], [1.0, 1.0, 1.0]], 1), ([[0.5], [2.0]], 1)])
def test_whitening_of_few_or_dependent_vectors(spark, vectors, directions):
    rows = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], VECTORS)
    distinct = materialize(whitening.fit_list(rows), "fit")
    fitted = whitening.fit(distinct)
    assert len(fitted.variances) == directions
    assert whitening.whiten(rows, fitted).count() == directions * len(vectors)
    assert whitening.identity_error(distinct, fitted) < 1e-12


def test_vectors_of_two_lengths_raise(spark):
    rows = spark.createDataFrame([(1, [1.0], 0, 0), (2, [1.0, 2.0], 0, 0)], VECTORS)
    with pytest.raises(ValueError, match="one length"):
        whitening.fit(materialize(whitening.fit_list(rows), "fit"))


def test_deviations_beyond_machine_integers():
    fitted = whitening.Whitening(3 << 40, (5, -7), np.zeros(0), np.zeros((0, 2)), 0.0)
    x = np.array([[1 << 20, -3], [0, 9]])
    assert fitted.deviations(x) == [((3 << 40) * a - 5) ** 2 + ((3 << 40) * b + 7) ** 2 for a, b in x.tolist()]


@pytest.mark.parametrize("kind", ["dense", "dependent", "graded", "ties", "zero"])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_qd_solver(kind, n):
    random = np.random.default_rng(n)
    a = random.normal(size=(n + 5, n))
    a = {"dense": a, "dependent": a * (np.arange(n) < max(1, n // 2)), "graded": a * 10.0 ** -np.arange(n), "zero": 0 * a,
         "ties": np.eye(n) * np.repeat([3.0, 2.0], [n // 2, n - n // 2])}[kind]
    r = np.linalg.qr(a, mode="r")
    diagonal, upper, v = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(v @ v.T, np.eye(n), atol=1e-13) and np.allclose(v @ b.T @ b @ v.T, r.T @ r, atol=1e-12)
    squares, truth = whitening.singular_squares(diagonal, upper), np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(squares, truth, rtol=1e-12, atol=1e-13 * truth[0])
    kept = squares[:4][squares[:4] > 1e-20 * max(squares[0], 1e-300)]
    vectors = whitening.right_vectors(diagonal, upper, kept) @ v.T
    assert np.allclose(vectors @ vectors.T, np.eye(len(kept)), atol=1e-12)
    for value, vector in zip(kept, vectors):
        assert np.abs(r.T @ (r @ vector) - value * vector).max() < 1e-12 * squares[0]


def test_small_singular_values_are_accurate():
    """Relative accuracy where values span sixteen orders: a bidiagonal matrix with known determinant."""
    diagonal, upper = 10.0 ** -np.arange(9.0), 10.0 ** -np.arange(8.0)
    squares = whitening.singular_squares(diagonal, upper)
    assert abs(np.prod(np.sqrt(squares)) / np.prod(diagonal) - 1) < 1e-13


# ------------------------------------------------------------------------------------ fill in middle


def brute_fill(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h[2] % 100 >= 90 or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (key, len(units), "plain", None, None, text, text)
    if h[3] % 100 < 20:
        return (key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_middle_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 200)
    texts = [None, "", "a", "Ab1 é\r\n𝒳x", "<P> in it", "tail <S", "<", " " * 300, "word " * 4000, "x" * 9000, "é" * 50]
    rows = [(i if i % 9 else None, texts[i % len(texts)], "form", 1) for i in range(150)] + [(4, "twice one id", "f", 2), (4, "twice one id", "f", 2)]
    got = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_fill(i, t) for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("error, span", [(127, 2048), (0, 7), (3, 64), (1, 1), (127, 2)])
def test_rank_index_is_exact(error, span):
    random = np.random.default_rng(error)
    offsets = np.concatenate([[0], np.cumsum(np.where(random.random(3000) < 0.01, 500, random.integers(1, 9, 3000)))])
    index = fill_middle.RankIndex(offsets, error, span)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.offsets(ranks), offsets)
    assert np.abs(index.predict(ranks) - offsets).max() <= error


def test_rank_index_is_small():
    """Evenly spaced offsets take one segment for each span."""
    index = fill_middle.RankIndex(np.arange(0, 30_000, 3))
    assert len(index.first) == 5 and not index.residual.any()
    with pytest.raises(ValueError):
        fill_middle.RankIndex(np.arange(3), error=128)
