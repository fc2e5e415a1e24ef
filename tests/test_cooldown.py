"""Cooldown by pointers: long chains, cooldowns over many segments, what a row holds."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from sonarium.operators import cooldown as c


def accepted(times, gap):
    times, out, last = sorted(set(times)), [], None
    while True:
        at = 0 if last is None else bisect.bisect_left(times, last + gap)
        if at == len(times):
            return out
        last = times[at]
        out.append(last)


def dense(spark, n, seed, steps=(1, 1, 2, 3)):
    rng, t, rows = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.choice(steps)
        rows.append((1, t))
    return spark.createDataFrame(rows, "k int, t bigint"), [t for _, t in rows]


@pytest.mark.parametrize("gap, width", [(400, 10), (411, 10), (100, 1), (57, 100), (7, 2), (1000, 1_000_000)])
def test_cooldown_over_many_segments(spark, gap, width):
    """From a cooldown of a hundred segments to a segment that holds everything."""
    rows, times = dense(spark, 1500, gap)
    got = sorted(r.t for r in c.cooldown(rows, "k", "t", gap, "t", width).collect())
    assert got == accepted(times, gap)


def test_rows_stay_small_when_a_cooldown_spans_segments(spark):
    """A cooldown of 40 segments: a row holds its segment's candidates or one pointer, however long the chain."""
    gap, width = 400, 10
    rows, times = dense(spark, 2000, 1)
    sections = c.materialize(c._sections(c._firsts(rows, "k", "t", "t"), "k", "t", width), "sections")
    most = sections.agg(F.max(F.size("_times"))).first()[0]
    assert most <= width
    maps = c.materialize(c.step_maps(sections, "k", gap), "steps")
    assert maps.agg(F.max(F.greatest(F.size("entry"), F.size("exit")))).first()[0] <= most
    assert maps.where("NOT settled").count() > 100
    steps = c.materialize(c.pointers(maps, "k", gap, width), "pointers")
    assert {t for _, t in steps.dtypes} <= {"int", "bigint", "boolean"}
    assert steps.count() <= len(set(times)) and steps.groupBy("k", "at").count().where("count > 1").count() == 0
    # every pointer is the last acceptance of the segment it leads to
    truth, places = accepted(times, gap), sorted(set(times))
    for r in steps.where("to IS NOT NULL").collect():
        nexts, at = [], bisect.bisect_left(places, r["at"] + gap)
        while at < len(places) and (not nexts or places[at] // width == nexts[0] // width):
            nexts.append(places[at])
            at = bisect.bisect_left(places, places[at] + gap)
        assert (r.to, r.to_segment) == (nexts[-1], nexts[0] // width)
    marked = {r["at"] for r in c.followed(steps, "k").collect()}
    assert marked <= set(truth) and {t // width for t in truth} == {t // width for t in marked}


def test_pauses_settle_segments(spark):
    """After a pause of a cooldown nothing before matters: no pointer is followed."""
    rows = spark.createDataFrame([(k, 1000 * i + j) for k in range(3) for i in range(20) for j in (0, 3, 9)], "k int, t bigint")
    sections = c.materialize(c._sections(c._firsts(rows, "k", "t", "t"), "k", "t", 500), "sections")
    maps = c.materialize(c.step_maps(sections, "k", 50), "steps")
    assert maps.where("NOT settled").count() == 0
    assert c.pointers(maps, "k", 50, 500).where("NOT cut").count() == 0
    assert c.cooldown(rows, "k", "t", 50, "t", 500).count() == 60


def test_first_of_a_tie_by_the_given_column(spark):
    rows = spark.createDataFrame([(1, 5, 9), (1, 5, 2), (1, 7, 1), (2, 5, 4)], "k int, t bigint, id int")
    assert sorted(r.id for r in c.cooldown(rows, "k", "t", 3, "id", 4).collect()) == [2, 4]
    assert c.cooldown(rows.limit(0), "k", "t", 3, "id").count() == 0


def test_width_follows_the_data(spark, monkeypatch):
    rows, times = dense(spark, 300, 3)
    assert c._segment_width(rows, "k", "t", 20) == 160
    monkeypatch.setattr(c, "SEGMENT_ROWS", 10)
    monkeypatch.setattr(c, "SEGMENT_MS", 15)
    assert c._segment_width(rows, "k", "t", 20) == 15
    assert sorted(r.t for r in c.cooldown(rows, "k", "t", 20, "t").collect()) == accepted(times, 20)
