"""Mixing overlapping sources to target weights as a min-cost flow."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.session import materialize

#: Membership patterns that the driver may hold; a corpus with more is refused, not cut.
MAX_PATTERNS = 200_000
#: Hexadecimal digits of the selection digest that one histogram resolves.
DIGITS = 3


def fill_targets(sizes: list[int], weights: list[float], most: int = 3) -> list[float]:
    """Share the total size by weight; none above ``most`` times its size, the excess reshared by weight."""
    targets: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(targets) if t is None]
        weight = sum(weights[i] for i in open_)
        level = (sum(sizes) - sum(int(t) for t in targets if t is not None)) / weight if open_ and weight else 0.0
        over = [i for i in open_ if weights[i] * level > most * sizes[i]]
        if not over:
            return [float(weights[i] * level) if t is None else t for i, t in enumerate(targets)]
        for i in over:
            targets[i] = float(most * sizes[i])


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Successive cheapest paths with potentials; every augmentation fills an arc."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def sent(self, place: tuple[int, int]) -> int:
        arc = self.arcs[place[0]][place[1]]
        return self.arcs[arc.to][arc.back].room

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.arcs)
        while True:
            distance, via = {source: 0}, {}
            queue = [(0, source)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > distance[node]:
                    continue
                for k, arc in enumerate(self.arcs[node]):
                    step = d + arc.cost + height[node] - height[arc.to]
                    if arc.room and step < distance.get(arc.to, step + 1):
                        distance[arc.to], via[arc.to] = step, (node, k)
                        heapq.heappush(queue, (step, arc.to))
            if sink not in distance:
                return
            farthest = max(distance.values())
            height = [h + distance.get(i, farthest) for i, h in enumerate(height)]
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = via[node][0]
            room = min(self.arcs[a][k].room for a, k in path)
            for a, k in path:
                arc = self.arcs[a][k]
                arc.room -= room
                self.arcs[arc.to][arc.back].room += room


def route(capacity: dict[tuple, int], quota: dict, most: int = 3) -> dict[tuple, int]:
    """Words to take from each membership pattern. A pattern's k-th pass costs k - 1 a word, so repetition is spread.

    Patterns and sources that share no member are routed apart.
    """
    parent = {s: s for s in quota}

    def find(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for pattern in capacity:
        for s in pattern[1:]:
            parent[find(s)] = find(pattern[0])
    parts: dict = {}
    for pattern in capacity:
        parts.setdefault(find(pattern[0]), []).append(pattern)
    taken = {}
    for patterns in parts.values():
        names = list(dict.fromkeys(s for p in patterns for s in p))
        place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
        net = FlowNetwork(2 + len(patterns) + len(names))
        passes = []
        for i, pattern in enumerate(patterns):
            passes.append([net.add(0, 2 + i, capacity[pattern], k) for k in range(most)])
            for s in pattern:
                net.add(2 + i, place[s], most * capacity[pattern], 0)
        for s in names:
            net.add(place[s], 1, quota[s], 0)
        net.run(0, 1)
        taken |= {p: sum(map(net.sent, arcs)) for p, arcs in zip(patterns, passes)}
    return taken


def _code_points(name: str | None) -> tuple:
    return (name is None, name or "")


def selection_digest(seed: int, key: Column) -> Column:
    """The order in which a pattern's documents are drawn; a missing key has a digest of its own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def _boundary(rows: DataFrame, plan: DataFrame, digit: int) -> DataFrame:
    """For each pattern the first digest prefix at which more than the rest is reached, and the rest before it."""
    from pyspark.sql import Window

    bucket = F.substring("digest", 1, digit)
    histogram = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("n")).join(plan, "pattern")
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket"))
    crossing = histogram.withColumn("upto", upto).where("upto > rest")
    first = F.min(F.struct("bucket", "upto", "n")).alias("x")
    return crossing.groupBy("pattern", "rest").agg(first).select("pattern", F.col("x.bucket").alias("bucket"), (F.col("rest") - F.col("x.upto") + F.col("x.n")).alias("rest"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of a written table ``rows(pattern, size, digest, row)``; ``pattern`` is the JSON array of a document's sources.

    Returns one row per pattern (passes over all its documents, the last digest and size of the partial pass, the last
    row of the entry that follows, one document that fits the remainder) and one row per source (its size and target).
    """
    spark = rows.sparkSession
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(sorted(set(json.loads(r.pattern)), key=_code_points)): r.size for r in found}
    texts = {tuple(sorted(set(json.loads(r.pattern)), key=_code_points)): r.pattern for r in found}
    sources = sorted({s for p in capacity for s in p}, key=_code_points)
    sizes = [sum(c for p, c in capacity.items() if s in p) for s in sources] if len(capacity) < 2_000 else _source_sizes(capacity, sources)
    # An overlapping document counts once in the total, though it is in the size of each of its sources.
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sources))], most)
    taken = route(capacity, {s: int(t) for s, t in zip(sources, targets)}, most)
    planned = [
        (texts[p], c, taken[p] // c if c else 0, taken[p] % c if c else 0) for p, c in capacity.items()
    ]
    plan = spark.createDataFrame(planned, "pattern string, capacity long, passes long, rest long")
    named = spark.createDataFrame([(s, n, t) for s, n, t in zip(sources, sizes, targets)], "source string, source_size long, target double")
    return _cut(rows, plan), named


def _source_sizes(capacity: dict[tuple, int], sources: list) -> list[int]:
    total = dict.fromkeys(sources, 0)
    for pattern, c in capacity.items():
        for s in pattern:
            total[s] += c
    return [total[s] for s in sources]


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the partial pass over each pattern ends.

    Documents come in digest order. Two histograms of digest prefixes narrow the end down to a 16-millionth of a
    pattern, and there documents of one digest and size count as one entry, so no task orders a whole source. Of the
    entry at which the rest runs out as many rows go as fit; one last document that fits what is left then brings the
    pattern nearer.
    """
    from pyspark.sql import Window

    partial = plan.where("rest > 0").select("pattern", "rest")
    one = materialize(_boundary(rows, partial, DIGITS), "mix")
    inside = rows.join(one.select("pattern", "bucket"), "pattern").where(F.substring("digest", 1, DIGITS) == F.col("bucket")).drop("bucket")
    two = materialize(_boundary(inside, one.select("pattern", "rest"), 2 * DIGITS), "mix")
    last = inside.join(two, "pattern").where(F.substring("digest", 1, 2 * DIGITS) == F.col("bucket"))
    entries = last.groupBy("pattern", "rest", "digest", "size").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum(F.col("size") * F.col("m")).over(Window.partitionBy("pattern").orderBy("digest", "size"))
    entries = materialize(entries.withColumn("upto", upto), "mix")
    fits = entries.where("upto <= rest").groupBy("pattern").agg(F.max(F.struct("upto", "digest", "size")).alias("x"))
    next_ = entries.where("upto > rest").groupBy("pattern").agg(F.min(F.struct("digest", "size")).alias("p"))
    room = F.col("rest") - F.coalesce("x.upto", F.lit(0))
    ends = two.join(fits, "pattern", "left").join(next_, "pattern", "left").select(
        "pattern",
        # Nothing of the last bucket fits: the pass ends before it.
        F.coalesce("x.digest", "bucket").alias("cut_digest"), F.coalesce("x.size", F.lit(-1)).alias("cut_size"),
        F.col("p.digest").alias("part_digest"), F.col("p.size").alias("part_size"),
        F.coalesce(F.floor(room / F.col("p.size")), F.lit(0)).cast("bigint").alias("part_rows"),
        (room - F.coalesce(F.floor(room / F.col("p.size")) * F.col("p.size"), F.lit(0))).cast("bigint").alias("left_over"),
    )
    ends = materialize(ends, "mix")
    beyond = F.struct("digest", "size") > F.struct(F.col("cut_digest").alias("digest"), F.col("cut_size").alias("size"))
    filler = rows.join(ends, "pattern").where(beyond & (F.col("size") > 0) & (F.col("size") <= F.col("left_over")))
    # Of rows with one digest and size the first by number.
    filler = filler.groupBy("pattern").agg(F.max(F.struct("size", "digest", -F.col("row"))).alias("f"))
    filler = filler.select("pattern", (-F.col("f.col3")).alias("fill_row"))
    cut = plan.join(ends.drop("left_over", "part_rows"), "pattern", "left").join(_part_rows(rows, ends), "pattern", "left")
    return materialize(cut.join(filler, "pattern", "left"), "mix")


def _part_rows(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``pattern, part_row``: the number of the last row that goes of the entry at which a pattern's rest runs out.

    Rows are counted by the partition that numbered them; only those of the one partition in which the count is reached
    are put in order.
    """
    from pyspark.sql import Window

    wanted = ends.where("part_rows > 0").select("pattern", F.col("part_digest").alias("digest"), F.col("part_size").alias("size"), "part_rows")
    own = rows.select("pattern", "digest", "size", "row").join(wanted, ["pattern", "digest", "size"])
    own = own.withColumn("part", F.shiftright("row", 33))
    counts = own.groupBy("pattern", "part", "part_rows").count()
    counts = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("pattern").orderBy("part")))
    at = counts.where("upto >= part_rows").groupBy("pattern").agg(F.min(F.struct("part", (F.col("part_rows") - F.col("upto") + F.col("count")).alias("place"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("row"))
    near = own.select("pattern", "part", "row").join(at.select("pattern", "x.part", "x.place"), ["pattern", "part"]).withColumn("n", place)
    return near.where("n = place").select("pattern", F.col("row").alias("part_row"))


def passes_taken() -> Column:
    """How many times a row of ``pattern, size, digest, row`` joined with its plan is taken."""
    here = F.struct("digest", F.col("size").alias("size"))
    upto = F.col("cut_digest").isNotNull() & (here <= F.struct(F.col("cut_digest").alias("digest"), F.col("cut_size").cast("bigint").alias("size")))
    part = (F.col("digest") == F.col("part_digest")) & (F.col("size") == F.col("part_size")) & (F.col("row") <= F.col("part_row"))
    fill = F.col("row") == F.col("fill_row")
    return F.col("passes") + F.when(upto | F.coalesce(part, F.lit(False)) | F.coalesce(fill, F.lit(False)), 1).otherwise(0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mixing_rows(docs: DataFrame, key: str, size: Column, sources: Column, seed: int, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``key, pattern, size, digest, row`` of every document; ``sources`` is an array of its sources.

    ``row`` numbers the rows, so write them before they are used twice.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct(sources)))
    return docs.select(
        F.col(key).alias("key"), pattern.alias("pattern"), size.alias("size"), selection_digest(seed, F.col(key)).alias("digest"),
        F.monotonically_increasing_id().alias("row"), *keep,
    )


def mix(docs: DataFrame, key: str = "doc_id", size: Column | None = None, sources: Column | None = None,
        weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``key, pattern, size, passes``: how often a mix of the sources takes each document; and the table of sources.

    Sources in code-point order (null last) get ``weights`` in turn and share the total size; none gets more than
    ``most`` times its size. Documents are aggregated by membership pattern; a min-cost flow routes the patterns'
    words to the sources' targets, and repeating a pattern costs more with every pass. Within a pattern a whole pass
    takes every document, a partial one those with the smallest seeded digests of their keys.

    Only patterns and sources reach the driver (:data:`MAX_PATTERNS`). Rows without a key, and rows of one key, have one
    digest; they are told apart by number where the partial pass ends, so each source comes within a document of its
    target whatever the keys are. Documents of size 0 are taken in whole passes and, in digest order, in partial ones. An empty
    table gives no rows. Other columns are not carried.
    """
    size = word_count(F.col("text")) if size is None else size
    sources = F.array(F.col("source")) if sources is None else sources
    rows = materialize(mixing_rows(docs, key, size, sources, seed), "mix")
    plan, named = mix_plan(rows, weights, most)
    return rows.join(plan, "pattern").select("key", "pattern", "size", passes_taken().alias("passes")), named


def mixed(docs: DataFrame, key: str = "doc_id", size: Column | None = None, sources: Column | None = None,
          weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """The rows of the mix that :func:`mix` plans, all columns kept: each document as often as it is taken.

    Documents are written once with a number for each row, which tells rows of equal keys apart.
    """
    size = word_count(F.col("text")) if size is None else size
    sources = F.array(F.col("source")) if sources is None else sources
    rows = materialize(mixing_rows(docs, key, size, sources, seed, keep=(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"),)), "mix")
    plan, _ = mix_plan(rows.drop("doc"), weights, most)
    taken = rows.join(plan, "pattern").select("doc", passes_taken().cast("int").alias("passes")).where("passes > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    taken, named = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    source = F.element_at(F.from_json("pattern", T.ArrayType(T.StringType())), 1)
    rows = taken.select(F.col("key").alias("doc_id"), "size", source.alias("of"), (F.col("passes") * F.col("size")).alias("taken"))
    return rows.join(named, F.col("of").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('1:' || CAST(doc_id AS VARCHAR)) AS digest
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM rows GROUP BY source
), filled AS (
  SELECT *, 3 * n / w AS ratio,
         (sum(n) OVER () - coalesce(3 * sum(n) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT max(level) AS level FROM filled WHERE level <= ratio
), targets AS (
  SELECT source, n, least(w * top, 3 * n) AS target FROM filled CROSS JOIN (SELECT level AS top FROM water)
), planned AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // CAST(n AS BIGINT) END AS passes, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % CAST(n AS BIGINT) END AS rest FROM targets
), ordered AS (
  SELECT r.*, n, target, passes, rest,
         sum(size) OVER (PARTITION BY r.source ORDER BY digest, size) AS upto
  FROM rows r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
), cut AS (
  SELECT *, upto <= rest AND rest > 0 AS hit,
         rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS left_over
  FROM ordered
), filler AS (
  SELECT source, arg_max(doc_id, (size, digest)) AS doc_id FROM cut WHERE NOT hit AND rest > 0 AND size > 0 AND size <= left_over GROUP BY source
)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (passes + CASE WHEN hit OR f.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cut c LEFT JOIN filler f ON c.doc_id = f.doc_id
"""
