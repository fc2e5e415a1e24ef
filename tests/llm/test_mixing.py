"""The mix where ids say nothing about rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.llm import mixing

DOC = "doc_id bigint, text string, source string, row bigint, passes int"


def corpus(ids, n=2000):
    random = np.random.default_rng(7)
    rows = []
    for i in range(n):
        source = "a" if i % 3 else None
        text = "w " * 6 if i % 2 else "w " * int(random.integers(0, 12))  # half of the rows are copies
        rows.append((ids(i), text, source, i, 1))
    return rows


IDS = {"none": lambda i: None, "a third": lambda i: None if i % 3 == 0 else i, "one id": lambda i: 5, "few ids": lambda i: i % 7, "all": lambda i: i}


@pytest.mark.parametrize("kind", IDS)
def test_targets_are_met_whatever_the_ids(spark, kind):
    rows = corpus(IDS[kind])
    taken, named = mixing.mix(spark.createDataFrame(rows, DOC).repartition(5))
    found = taken.groupBy("pattern").agg(F.sum(F.col("passes") * F.col("size")).alias("words"), F.max("size").alias("longest"), F.count(F.lit(1)).alias("n"), F.max("passes").alias("most")).collect()
    targets = {r.source: r.target for r in named.collect()}
    sizes = {s: sum(len(t.split()) for _, t, x, *_ in rows if x == s) for s in ("a", None)}
    assert sum(r.n for r in found) == len(rows)
    for r in found:
        source = None if r.pattern == "[null]" else "a"
        assert abs(r.words - targets[source]) <= r.longest and r.most <= 3
        assert targets[source] <= 3 * sizes[source]


@pytest.mark.parametrize("kind", ["none", "few ids"])
def test_mixed_rows_are_those_that_are_planned(spark, kind):
    """Every row as often as it is taken, its own columns kept, names in use and with dots included."""
    rows = spark.createDataFrame(corpus(IDS[kind], 300), DOC).withColumn("a.b", F.col("row"))
    got = mixing.mixed(rows)
    assert got.columns == rows.columns
    words = got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " ")) * (F.trim("text") != "").cast("int")).alias("n")).collect()
    _, named = mixing.mix(rows)
    targets = {r.source: r.target for r in named.collect()}
    assert all(abs(r.n - targets[r.source]) <= 12 for r in words)
    # passes over a row differ by one at most within a source, as no document repeats before all have gone once
    counts = got.groupBy("source", "row").count().groupBy("source").agg(F.max("count").alias("high"), F.min("count").alias("low")).collect()
    assert all(r.high - r.low <= 1 for r in counts)


def test_reruns_agree(spark):
    rows = corpus(IDS["few ids"])
    runs = []
    for parts in (2, 9):
        taken, _ = mixing.mix(spark.createDataFrame(rows, DOC).repartition(parts))
        runs.append(sorted((r.key, r.size, r.pattern, r.passes) for r in taken.collect()))
    assert runs[0] == runs[1]
    assert mixing.mixed(spark.createDataFrame([], DOC)).count() == 0
