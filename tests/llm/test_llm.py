"""The corpus operators: nulls, empty tables, ties, long texts, odd columns, and brute force where SQL has no say."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonarium.llm import bpe, exact_dedup, graph, hashing, language_id, line_dedup, mixing, ngram_join, quality, substring_dedup, topk_search
from sonarium.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, label string"


def docs(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, 0, None, "x") for i, t, s in zip(ids, texts, sources)], DOC)


def words(n, seed=0):
    random = np.random.default_rng(seed)
    return ["".join(random.choice(list("abcdefghij"), 6)) for _ in range(n)]


TEXTS = [None, "", "a b", "a  b\n", "a b", "ab", "x " * 50_000, "é\x0b", "é"]


def test_exact_groups_match_brute_force(spark):
    ids = [9, 8, 7, 3, 2, 1, None, 5, 4]
    got = {(r.id, r.text_sha256): r for r in exact_dedup.exact_groups(docs(spark, TEXTS, ids)).collect()}
    def strip(t):
        return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in zip(ids, TEXTS):
        groups.setdefault(strip(t), []).append((-len(t or ""), i if i is not None else 1 << 62, i))
    for i, t in zip(ids, TEXTS):
        row = got[i, hashlib.sha256(strip(t).encode()).hexdigest()]
        assert (row.keep_id, row.group_size) == (min(groups[strip(t)])[2], len(groups[strip(t)]))
        assert row.kept == (row.keep_id == i)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_trie_splits_merges_and_spills():
    trie, seen = exact_dedup.Patricia(), {}
    for i, key in enumerate([b"romane", b"romanus", b"rom", b"", b"romane", b"rubens", b"\x00\xff", b"\x00"]):
        trie.insert(key, (0, i), 1, None)
        seen.setdefault(key, []).append(i)
    assert {k: (n.best[1], n.rows) for k, n in trie.take()} == {k: (min(v), len(v)) for k, v in seen.items()}
    spilled = dict(trie.spill(b"rubens"))
    left = dict(trie.take())
    assert not set(spilled) & set(left) and set(spilled) | set(left) == set(seen) and b"rubens" in left


def brute_cut(texts, ids, width):
    lists = [(t or "").split() for t in texts]
    owner = {}
    for w, i in zip(lists, ids):
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            owner[key] = min(owner.get(key, i), i)
    out = {}
    for w, i in zip(lists, ids):
        gone = {q for p in range(len(w) - width + 1) if owner[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        out[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    return out


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_substring_dedup_matches_brute_force(spark, block_bytes):
    base, other = words(60), words(40, 1)
    texts = [" ".join(base), " ".join(other + base[10:40]), " ".join(base[20:50] + other + base[20:50]), None, "", "one two", " ".join(other * 3), " ".join(other * 3)]
    ids = [5, 3, 8, 1, 2, 0, 9, 10]
    got = substring_dedup.substring_dedup(docs(spark, texts, ids), width=13, block_bytes=block_bytes).collect()
    want = brute_cut(texts, ids, 13)
    assert {r.key: (r.n_words, sum(s.length for s in r.spans), r.kept) for r in got} == want


def test_substring_dedup_null_keys_and_empty_table(spark):
    text = " ".join(words(20))
    got = {r.key: len(r.spans) for r in substring_dedup.substring_dedup(docs(spark, [text, text], [None, 4])).collect()}
    assert got == {None: 1, 4: 0}
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def test_entries_do_not_depend_on_the_order_of_rows():
    bodies = [" ".join(words(12, s)).encode() for s in range(6)] + [" ".join(words(12) + words(12, 1)).encode()]
    table = pa.table({"key": pa.array([None, None, None, None, 4, 4, 4], pa.int64()), "body": pa.array(bodies, pa.binary())})
    one = substring_dedup._Block(table, 5)
    for seed in range(5):
        other = substring_dedup._Block(table.take(np.random.default_rng(seed).permutation(7)), 5)
        assert (one.first == other.first).all() and (one.second == other.second).all() and (one.owner == other.owner).all()
        assert one.table.column("body") == other.table.column("body")


def test_long_words_and_window_hashes():
    text = ("z" * 5_000 + " b " + "z" * 5_000 + " c").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = hashing.word_spans(data, np.array([0, len(text)]))
    first, second = hashing.word_hashes(data, starts, ends)
    assert first[0] == first[2] and second[0] == second[2] and len(set(first)) == 3


def brute_components(texts, ids):
    sets = {}
    for t, i in zip(texts, ids):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("chunk", [4, 1_500])
def test_ngram_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", chunk)
    random, base = np.random.default_rng(3), words(120)
    texts = [None, "", "A b", "a B", " ".join(base), " ".join(base).upper()]
    for i in range(24):
        copy = list(base)
        for p in random.choice(120, 1 + i % 5, replace=False):
            copy[p] = f"new{i}x{p}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:40] + words(80, s)) for s in range(4, 10)] + ["solo one two three four five"]
    ids = list(range(100, 100 + len(texts)))
    got = ngram_join.ngram_components(docs(spark, texts, ids), block_bytes=2_000).collect()
    assert {r.key: (r.n_shingles, r.component) for r in got} == brute_components(texts, ids)


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0


def test_components_of_a_path(spark):
    order = np.random.default_rng(1).permutation(200).tolist()
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:])) + [(500, 501), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.label for r in graph.connected_components(edges).collect()}
    assert len({got[i] for i in range(200)}) == 1 and got[500] == got[501] != got[0] and len(got) == 202


def test_targets_cap_and_reshare():
    assert mixing.fill_targets([10, 10, 100], [5, 2, 1]) == [30.0, 30.0, 60.0]
    assert mixing.fill_targets([], []) == [] and mixing.fill_targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_overlapping_sources_are_routed():
    taken = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 15, "b": 15})
    assert sum(taken.values()) == 30 and taken[("a",)] >= 10 and taken[("a", "b")] <= 20


def test_mix_is_near_its_targets_and_repeats(spark):
    texts = [" ".join(["w"] * (1 + i % 17)) for i in range(300)] + [None, ""]
    sources = [None if i % 7 == 0 else f"s{i % 5}" for i in range(302)]
    frame = docs(spark, texts, sources=sources)
    taken, named = mixing.mix(frame)
    rows, targets = taken.collect(), {r.source: r.target for r in named.collect()}
    assert len(rows) == 302 and max(r.passes for r in rows) <= 3
    sums = Counter()
    for r in rows:
        sums[sources[r.key]] += r.passes * r["size"]
    assert all(abs(sums[s] - t) <= 17 for s, t in targets.items())
    again = {r.key: r.passes for r in mixing.mix(frame.repartition(5))[0].collect()}
    assert again == {r.key: r.passes for r in rows}
    assert mixing.mixed(frame).count() == sum(again.values())
    assert mixing.mix(docs(spark, []))[0].count() == 0


def test_languages_and_mixtures(spark):
    english, german = "the king and the thing with other things ", "der könig und die sache mit anderen dingen schön "
    texts = [english * 9, german * 9, english * 20 + german * 12, None, "123 !!", "", "\0" + german * 5]
    frame = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, ["en", "de", None, "en", None, None, None]))], "doc_id bigint, text string, lang string")
    model = language_id.train(frame)
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "en", "und", "und", "und", "de"]
    assert len(got[2].languages) == 2 and 0.5 < got[2].score < 0.8 and got[0].score == 1
    nothing = language_id.train(frame.where("false"))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}


def test_language_sets_do_not_depend_on_other_texts(monkeypatch):
    # By text and size of the set; the first text gains at 4 languages, but not at 3.
    gains = {0: {2: 1.0, 3: 0.0, 4: 9.0}, 1: {2: 1.0, 3: 5.0, 4: 0.0}}
    def fake(p, counts, text, begin, start, rounds):
        return start, np.array([gains[int(p[b, 0])][int((row > 0).sum())] for b, row in zip(begin, start)])
    monkeypatch.setattr(language_id, "_maximise", fake)
    p, chosen = np.array([[0.0] * 4, [1.0] * 4]), np.eye(4)[[0, 0]]
    args = p, np.ones(2, np.float32), np.array([0, 1]), np.array([1, 1]), np.array([[0.4, 0.3, 0.2, 0.1]] * 2), chosen, np.zeros(2), np.full(2, 0.1)
    alone, both = (language_id._select(*args, np.array(mixed)) for mixed in ([0], [0, 1]))
    assert (alone[0] == both[0]).all() and (alone[0] > 0).sum() == 4


def test_quality_separates_held_out_labels(spark):
    rows = QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = rows.merge(labels, on="doc_id").query("held_out")
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and rows.score.between(0, 1).all()


def test_quality_of_few_or_no_labels(spark):
    frame = docs(spark, [None, "", "a b", "###"])
    labels = spark.createDataFrame([(0, 1), (1, None)], "doc_id bigint, quality int")
    vectors = quality.word_vectors(frame)
    assert quality.train(frame, labels, vectors) == 1.0 and quality.train(frame, labels.where("false"), vectors) == 0.5
    assert quality.score(frame, vectors, 0.5).count() == 4


def test_language_accuracy(spark):
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows.merge(truth, on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.98


def python_lines(rows):
    """Brute force over few lines, given as (id, norm): every pair is tested by edit distance alone."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]
    label = {r[0]: r[0] for r in rows}
    for _ in range(5):
        for a in rows:
            for b in rows:
                if distance(a[1], b[1]) <= 0.2 * max(len(a[1]), len(b[1])) + 1e-9:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
    return label


def test_line_dedup_matches_brute_force(spark):
    line, other = " ".join(words(60)), " ".join(words(12, 5))
    near = [line.replace(w, w + "x", 1) for w in line.split()[::6]]
    texts = [line + "\n" + other, other.upper() + "!\n" + near[0], None, "", "***\n***", "\n".join(near), line + "\nnew " + other[:9], "a\nb"]
    frame = docs(spark, texts)
    staged = line_dedup._staged(frame, "doc_id", "text")
    found = line_dedup._occurrences(staged).collect()
    norm = {}
    for r in found:
        text = texts[r["first"]["key"]].split("\n")[r.pos].lower()
        norm[r.id] = " ".join("".join(c if c.isalnum() else " " for c in text).split())
    places = {}
    for r in found:
        places.setdefault(r.id, []).append((r["first"]["key"], r.pos))
    label = python_lines(list(norm.items()))
    groups = {}
    for i, at in places.items():
        groups.setdefault(label[i], []).extend(at)
    gone = {p for at in groups.values() for p in at if p != min(at)}
    assert len(gone) >= 3
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame).collect()}
    for i, text in enumerate(texts):
        want = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone)
        assert got[i].text == want and got[i].n_removed == sum(k[0] == i for k in gone) and got[i].label == "x"
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 14, 15])
def test_simhash_is_the_majority_of_hashes(spark, n):
    values = [int(v) for v in np.random.default_rng(n).integers(-(1 << 63), 1 << 63, n)]
    got = spark.createDataFrame([(values,)], "v array<bigint>").select(line_dedup.simhash(F.col("v"))).first()[0]
    assert got == sum(1 << bit for bit in range(60) if 2 * sum(v >> bit & 1 for v in values) > n)


def test_an_edit_moves_cuts_near_it_only(spark):
    values = [int(v) for v in np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 400)]
    edited = values[:200] + [7] + values[201:]
    rows = spark.createDataFrame([(v,) for v in (values, edited, [4] * 400, values[:1])], "v array<bigint>")
    one, other, same, single = [r[0] for r in rows.select(line_dedup._pieces("v")).collect()]
    assert sum(one, []) == values and sum(other, []) == edited and same == [[4] * 400] and single == [values[:1]]
    assert 40 < len(one) < 130 and min(map(len, one)) >= 3 and len([p for p in one if p not in other]) <= 3


def test_shared_ends_do_not_change_verdicts(spark):
    base = words(30, 3)
    others = [base[:9] + words(k, 40 + k) + base[at:] for k in range(9) for at in (9, 11, 16)] + [base[::-1], base[1:], base[:-1], words(30, 8)]
    rows = [(0, i, base, y, len(" ".join(base)), len(" ".join(y))) for i, y in enumerate(others)]
    schema = "a bigint, b bigint, x array<string>, y array<string>, x_size int, y_size int"
    got = {r.b for r in line_dedup._verified(spark.createDataFrame(rows, schema)).collect()}
    texts = spark.createDataFrame([(i, " ".join(base), " ".join(y)) for i, y in enumerate(others)], "b bigint, x string, y string")
    want = texts.where("levenshtein(x, y) <= greatest(length(x), length(y)) div 5").collect()
    assert got == {r.b for r in want} and 0 < len(got) < len(others)


def test_long_lines_are_judged_by_edit_distance(spark):
    base = words(400, 21)
    lettered = [w[:-1] + "z" if p % 3 == 0 else w for p, w in enumerate(base)]
    others = [sorted(base), lettered, ["ahead"] + lettered[:-1], ["ahead"] + base[:-1]]
    rows = [(0, i, base, y, len(" ".join(base)), len(" ".join(y))) for i, y in enumerate(others)]
    schema = "a bigint, b bigint, x array<string>, y array<string>, x_size int, y_size int"
    assert {r.b for r in line_dedup._verified(spark.createDataFrame(rows, schema)).collect()} == {1, 2, 3}
    got = line_dedup.line_dedup(docs(spark, [" ".join(base), " ".join(sorted(base))])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def near_by_edits(spark, lines):
    """Brute force by edit similarity alone: pairs ``a, b`` of the lines, given as id and normal form."""
    frame = spark.createDataFrame(lines, "id bigint, norm string").withColumn("size", F.length("norm")).repartition(8, "id")
    left, right = frame.toDF("a", "x", "x_size"), F.broadcast(frame.toDF("b", "y", "y_size"))
    close = (F.col("a") < F.col("b")) & (5 * F.least("x_size", "y_size") >= 4 * F.greatest("x_size", "y_size"))
    most = F.floor(F.greatest("x_size", "y_size") / 5).cast("int")
    return left.join(right, close).where(F.call_function("levenshtein", "x", "y", most) >= 0).select("a", "b").collect()


def linked_recall(spark, frame, longest=800):
    """How many pairs of near lines there are, and which part of them has one label."""
    staged = line_dedup._staged(frame, "doc_id", "text")
    found = corpus_pipeline.materialize(line_dedup._occurrences(staged), "found")
    label = {r.id: r.label for r in line_dedup.line_groups(staged, found).collect()}
    line = F.element_at(F.split("text", "\n"), F.col("pos") + 1)
    norms = staged.join(found, "row").select("id", F.array_join(line_dedup.words_of(line), " ").alias("norm")).distinct()
    pairs = near_by_edits(spark, [tuple(r) for r in norms.where(F.length("norm") <= longest).collect()])
    return len(pairs), sum(label[a] == label[b] for a, b in pairs) / len(pairs)


def test_near_lines_are_found_without_the_hash_condition(spark):
    random, texts = np.random.default_rng(11), []
    for n in (8, 14, 20, 40, 60):
        for k in range(12):
            line = words(n, 1_000 * n + k)
            copy = list(line)
            for p in random.choice(n, max(1, n // 10), replace=False):
                copy[p] = f"new{k}x{p}"
            texts += [" ".join(line), " ".join(copy)]
    n, recall = linked_recall(spark, docs(spark, texts))
    assert n == 60 and recall >= 0.95
    n, recall = linked_recall(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert n > 5 and recall >= 0.95


def test_lines_with_letters_changed_in_every_fifth_word_are_found(spark):
    lines = [words(n, 70 * n + k) for n in (12, 30, 90) for k in range(15)]
    copies = [[w[:2] + "z" + w[3:] if p % 5 == 2 else w for p, w in enumerate(line)] for line in lines]
    n, recall = linked_recall(spark, docs(spark, [" ".join(w) for pair in zip(lines, copies) for w in pair]))
    assert n == 45 and recall >= 0.95


def test_line_dedup_leaves_only_what_its_result_reads(spark, monkeypatch, tmp_path):
    folders = iter(range(1_000))
    for module in ("sonarium.session", "sonarium.llm.line_dedup"):
        monkeypatch.setattr(f"{module}.work_dir", lambda spark, name: f"{tmp_path}/{name}-{next(folders)}")
    line = words(20, 9)
    got = line_dedup.line_dedup(docs(spark, [" ".join(line), " ".join(line[1:]), " ".join(line[:-1]), "a b"])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 1, 1]
    left = {f.name.split("-")[0] for f in tmp_path.iterdir()}
    assert "gone" in left and not left & {"occurrences", "crowded", "entries", "texts", "verdicts"}


def test_line_dedup_is_native(spark):
    plan = line_dedup.line_dedup(docs(spark, ["a b c\nd", "A b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    random = np.random.default_rng(2)
    vectors = np.round(random.normal(size=(150, 8)), 2)
    vectors[20:60] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (1000, [None] * 8), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1200, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk_search.top_k(frame, frame.where("vec_id % 50 = 0"), k=7).collect()
    whole = np.floor(1024 * vectors).astype(np.int64)
    want = set()
    for q in (0, 50, 100):
        scores = whole @ whole[q]
        best = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:7]
        want |= {(q, r, i, int(scores[i])) for r, i in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want
    assert topk_search.top_k(frame.where("false"), frame).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.load(path)
    random = np.random.default_rng(4)
    parts = ["the", "ing", " ", "\n", "  ", "'s", "é", "über", "😀", "12", "<|endoftext|>", "<|", "\t", "aaaa", "!?", "　", "\x1c", "ǆ", "़"]
    texts = ["", "a" * 3_000] + ["".join(random.choice(parts, 30)) for _ in range(300)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encode(docs(spark, [None, "", "hello"]), path).collect()
    assert [(r.key, r.n_tokens, r.decoded) for r in rows] == [(0, 0, ""), (1, 0, ""), (2, 1, "hello")]


def test_line_stage_drops_documents_left_blank(spark):
    line = " ".join(words(20, 9))
    texts = [line, f"{line}\n\n\n \t\n{line}", f"{line}\n***", " \n", None]
    got = corpus_pipeline.line_stage(spark, docs(spark, texts), SF).collect()
    assert {r.doc_id: r.text for r in got} == {0: line, 2: "***", 3: " \n", 4: None}


def test_one_row_of_each_group_of_near_copies_stays(spark):
    base, other, third = words(80, 30), words(80, 31), words(80, 32)
    near = " ".join(["new"] + base[1:])
    base, other, third = " ".join(base), " ".join(other), " ".join(third)
    rows = [(None, base), (None, base), (7, near), (7, third), (3, other), (3, other), (None, other), (None, None), (9, ""), (None, "")]
    got = corpus_pipeline.near_copy_stage(spark, docs(spark, [t for _, t in rows], [i for i, _ in rows]), SF).collect()
    want = [(7, near), (7, third), (3, other), (None, None), (9, ""), (None, "")]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_pipeline_stages(spark):
    frame, names = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        names = frame.columns
        after = corpus_pipeline.materialize(stage(spark, frame, SF), name)
        if name != "tokens":
            assert after.columns == names and 0 < after.count()
        if name in ("quality", "near_copies"):
            assert after.join(frame, names, "left_anti").count() == 0 and after.count() <= frame.count()
        frame = after
    assert frame.count() > 0


def test_queries_have_sql_or_tests():
    assert set(SQL) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
