"""Groups of documents whose word shingles overlap: an exact n-gram Jaccard join by blocked sparse products."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import blocks, hashing
from sonarium.llm.graph import connected_components
from sonarium.session import materialize

#: Classes of equal sets, and shingles of their sets, that one product holds.
CHUNK_CLASSES = 1_500
CHUNK_SHINGLES = 1_500_000
#: Linked sets differ in size by 1.25 at most (at 0.8); neighbouring size classes of this ratio hold every linked pair.
_SLACK = 1.04

_SET_SCHEMA = "key bigint, n_shingles bigint, node bigint, set_key binary, hashes binary, prefix array<bigint>, central bigint"
_LINK_SCHEMA = "a bigint, b bigint"


class _Sets:
    """The shingle sets of one block: entries sorted by text, then hash, and each hash of the block once."""

    def __init__(self, table: pa.Table, width: int):
        data, offsets = hashing.texts_buffer(table.column("body"))
        starts, ends, text = hashing.word_spans(data, offsets)
        words = hashing.word_hashes(data, starts, ends, lower=True)
        n_words = np.bincount(text, minlength=table.num_rows)
        at = np.arange(max(0, len(text) - width + 1))
        at = at[text[: len(at)] == text[width - 1 :]] if len(at) else at
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        begin = np.searchsorted(text, short)
        low, high = np.concatenate([at, begin]), np.concatenate([at + width, begin + n_words[short]])
        owner = text[low] if len(low) else low
        first, second = hashing.window_hashes(words, low, high)
        order = np.argsort(first, kind="stable")
        narrow = np.uint16 if table.num_rows < 1 << 16 else np.uint32
        order = order[np.argsort(owner[order].astype(narrow), kind="stable")]
        owner, first, second = owner[order], first[order], second[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])
        self.owner, self.first = owner[new], first[new]
        second = second[new]
        self.sizes = np.bincount(self.owner, minlength=table.num_rows)
        order, begin = blocks.groups_of(self.first)
        counts = np.diff(np.append(begin, len(order)))
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(begin)), counts)
        head = order[begin]
        self.keys, self.second, self.counts = self.first[head], second[head], np.minimum(counts, 255).astype(np.uint8)


def _ask(width: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        sets = _Sets(table, width)
        return blocks.ask(table.column("block")[0].as_py(), sets.keys, sets.second, bits, lambda part: sets.counts[part].tobytes())

    return run


def _frequency(keys: np.ndarray, extras: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """In how many texts of the corpus a shingle stands, 255 at most."""
    counts = np.frombuffer(b"".join(extras), np.uint8).astype(np.int64)
    order, begin = blocks.groups_of(keys)
    total = np.minimum(np.add.reduceat(counts[order], begin), 255)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(total, np.diff(np.append(begin, len(order))))
    return out


def _least_shared(sizes, percent: int):
    """Shingles that a set of this size shares with every set it links to."""
    return -(-percent * sizes // 100)


def _collect(width: int, bits: int, percent: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, width)
        seen = blocks.answers_in_order(answers, sets.second, bits, np.uint8)[sets.group]
        repeated = np.bincount(sets.owner, weights=seen > 1, minlength=table.num_rows)
        need = _least_shared(sets.sizes, percent)
        live = (sets.sizes > 0) & (repeated >= need)
        begin = np.concatenate([[0], np.cumsum(sets.sizes)])
        nodes, names, hashes, prefixes, central = [], [], [], [], []
        for i in range(table.num_rows):
            if not live[i]:
                for column in (nodes, names, hashes, prefixes, central):
                    column.append(None)
                continue
            part = slice(begin[i], begin[i + 1])
            own, often = sets.first[part], seen[part]
            name = blake2b(own.tobytes(), digest_size=16).digest()
            # Rare shingles first: one order for all texts, so linked sets share a shingle of both prefixes.
            order = np.argsort(often, kind="stable")
            prefix = order[: len(own) - need[i] + 1]
            nodes.append(int.from_bytes(name[:8], "little", signed=True))
            names.append(name)
            hashes.append(own.tobytes())
            prefixes.append(own[prefix[often[prefix] > 1]].view(np.int64))
            central.append(int(often.sum(dtype=np.int64)) * 1000 // len(own))
        return pa.table({
            "key": table.column("key").combine_chunks(), "n_shingles": pa.array(sets.sizes, pa.int64()), "node": pa.array(nodes, pa.int64()),
            "set_key": pa.array(names, pa.binary()), "hashes": pa.array(hashes, pa.binary()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())), "central": pa.array(central, pa.int64()),
        })

    return run


class _Product:
    """Rows of the document by n-gram incidence matrix, with an inverted list for every n-gram."""

    def __init__(self, hashes: list[bytes]):
        self.sizes = np.array([len(h) // 8 for h in hashes], np.int64)
        column = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)[1]
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.columns = column
        owner = np.repeat(np.arange(len(hashes)), self.sizes)
        order = np.argsort(column, kind="stable")
        self.posted = owner[order]
        self.column_begin = np.concatenate([[0], np.cumsum(np.bincount(column))])

    def linked(self, i: int, percent: int) -> np.ndarray:
        """Rows whose overlap with row ``i`` reaches the bound that both sizes set."""
        own = self.columns[self.begin[i] : self.begin[i + 1]]
        low, counts = self.column_begin[own], self.column_begin[own + 1] - self.column_begin[own]
        places = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        overlap = np.bincount(self.posted[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * overlap >= percent * (self.sizes[i] + self.sizes - overlap))


def _links(percent: int):
    """All links within a chunk, as far as they join different components: stars round their smallest row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "descending"), ("central", "descending"), ("node", "ascending")])
        nodes = table.column("node").to_numpy()
        product = _Product(table.column("hashes").to_pylist())
        label = np.arange(len(nodes))
        for i in range(len(nodes)):
            # Pairs inside the component of the most central row need no test; every other pair has a row outside it.
            if i and label[i] == label[0]:
                continue
            joined = np.unique(label[product.linked(i, percent)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
            if label.max() == 0:
                break
        away = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[away], pa.int64()), "b": pa.array(nodes[label[away]], pa.int64())})

    return run


def _cross_links(percent: int):
    """Links between rows outside a hot group's main component (``pivot``) and the rows of one chunk."""

    def run(table: pa.Table) -> pa.Table:
        nodes, component = table.column("node").to_numpy(), table.column("label").to_numpy()
        product = _Product(table.column("hashes").to_pylist())
        a, b = [], []
        for i in np.flatnonzero(table.column("pivot").to_numpy(zero_copy_only=False)):
            near = product.linked(i, percent)
            near = near[component[near] != component[i]]
            _, one = np.unique(component[near], return_index=True)
            a += [nodes[i]] * len(one)
            b += nodes[near[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def shingle_sets(docs: DataFrame, key: str, text: str, width: int, percent: int, block_bytes: int) -> DataFrame:
    """A row per document; those that may have links carry their set, its name and its prefix.

    A document shares at least ``percent`` of its shingles with whatever it links to. Shingles are counted over the
    whole corpus, and a document of whose shingles fewer than that stand in another document is alone.
    """
    layout = blocks.block_layout(docs, text, block_bytes)
    texts = blocks.dealt(docs, key, text, layout)
    asked = texts.groupBy("block").applyInArrow(_ask(width, layout.range_bits), blocks.ASK_SCHEMA)
    answers = blocks.resolve(asked, _frequency)
    run = _collect(width, layout.range_bits, percent)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SET_SCHEMA)


def _candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """``node, label``: classes joined by a shared prefix shingle and like sizes, directly or through others."""
    step = 100.0 / percent * _SLACK
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(step))).cast("int") if step > 1.0001 else F.lit(0)
    entries = classes.select("node", F.explode("prefix").alias("shingle"), size_class.alias("c"))
    entries = entries.select("node", "shingle", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    heads = entries.groupBy("shingle", "c").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = entries.join(heads, ["shingle", "c"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return connected_components(edges, "candidates")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                     block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``key, n_shingles, component``: documents linked when 100 * intersection >= percent * union of their shingle sets.

    A shingle is ``width`` consecutive words, A-Z lower-cased; fewer words are one shingle, no words none and no link.
    ``component`` is the smallest key that links reach. Steps: shingles are counted over the corpus and documents that
    cannot have a link leave (:func:`shingle_sets`); equal sets collapse to one class; classes that share a prefix
    shingle form candidate groups; each group's document by n-gram incidence is multiplied with itself in chunks, and
    overlaps below the bound set by both sizes are discarded. A group larger than a chunk first meets its most central
    class, chunk by chunk; what stays outside the main component is then tested against every chunk. So a hot group of
    near copies costs time in proportion to its size, and no pair of different texts is left out.

    Shingles are compared by 64-bit hashes. Null texts are empty. Documents with a null key take part; a component of
    null keys only is null. Repeated rows are linked as copies. Other columns are not carried.
    """
    rows = materialize(shingle_sets(docs, key, text, width, percent, block_bytes), "shingles")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("key").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("hashes").alias("hashes"),
        F.first("prefix").alias("prefix"), F.first("central").alias("central"),
    )
    classes = materialize(classes, "classes")
    narrow = _candidate_groups(classes, percent).withColumnRenamed("label", "grp").join(classes.select("node", "n_shingles", "central"), "node")
    sizes = narrow.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_CLASSES), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"),
        F.max(F.struct("central", "node")).alias("hub"),
    )
    placed = narrow.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    # The sets join last: they are shuffled by class, then by chunk, and never by group.
    members = placed.drop("n_shingles").join(classes.select("node", "hashes"), "node")
    members = materialize(members, "members")
    kept = ["grp", "chunk", "node", "hashes", "central"]
    hubs = members.where("chunks > 1 AND node = hub.node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = members.where("chunks = 1 OR node <> hub.node").select(*kept, F.lit(False).alias("pivot"))
    tasks = tasks.union(hubs.select(*kept, F.lit(True)))
    links = materialize(tasks.groupBy("grp", "chunk").applyInArrow(_links(percent), _LINK_SCHEMA), "links")
    hot = members.where("chunks > 1")
    if not hot.isEmpty():
        links = links.union(_across_chunks(hot, links, percent))
    found = connected_components(links)
    labels = classes.select("node", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labels.groupBy("label").agg(F.min("least").alias("component"))
    labels = labels.join(least, "label").select("node", "component")
    named = rows.select("key", "n_shingles", "node").join(labels, "node", "left")
    return named.select("key", "n_shingles", F.coalesce("component", "key").alias("component"))


def _across_chunks(hot: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the chunks of hot groups that the hub has not made already."""
    hot = hot.join(connected_components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    hot = materialize(hot.select("grp", "chunk", "chunks", "node", "hashes", "label"), "hot")
    parts = hot.groupBy("grp", "label").count()
    main = parts.groupBy("grp").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.sum("count").alias("total"), F.max("count").alias("most"))
    main = main.withColumn("slices", F.ceil((F.col("total") - F.col("most")) / CHUNK_CLASSES).cast("int"))
    hot = hot.join(main.where("slices > 0").select("grp", "main", "slices"), "grp")
    cell = F.sequence(F.lit(0), F.col("slices") - 1)
    right = hot.select("grp", "chunk", F.explode(cell).alias("slice"), "node", "hashes", "label", F.lit(False).alias("pivot"))
    left = hot.where("label <> main").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), "slices").cast("int").alias("slice"),
        "node", "hashes", "label", F.lit(True).alias("pivot"),
    )
    cells = right.union(left).groupBy("grp", "chunk", "slice")
    return materialize(cells.applyInArrow(_cross_links(percent), _LINK_SCHEMA), "links")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    found = ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT x AS doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM reach JOIN sizes ON doc_id = x GROUP BY x
"""
