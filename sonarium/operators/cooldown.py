"""Cooldown: accept what comes at least a given time after the last accepted, without walking along a key.

The rule chains along a whole key. A key is cut into time segments. For each segment, what was accepted last before it
decides what is accepted last in it: a step function with few steps. Where all steps that can be reached agree, the
segment settles itself (so it does after every pause of a cooldown or more, and mostly once a segment is much longer than
the cooldown). What is left are pointers from one possible last acceptance to the next one in a later segment. They are
followed by doubling: each round joins the pointers with themselves, so ``n`` segments in a chain take ``log2(n)`` joins,
and every row is one pointer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarium.operators.ordered import SEGMENT, with_segment
from sonarium.session import materialize

SEGMENT_MS = 6 * 3_600_000
#: Candidates of a key that a row may hold, and cooldowns that make a good segment where that many fit.
SEGMENT_ROWS = 20_000
SEGMENT_COOLDOWNS = 8


def _firsts(candidates: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Of candidates at one time only the first by ``tie`` can be accepted; the others go before the shuffle."""
    return candidates.groupBy(key, time).agg(F.min_by(F.struct(*candidates.columns), tie).alias("_row"))


def _segment_width(firsts: DataFrame, key: str, time: str, gap: int) -> int:
    """Some cooldowns, so that nearly every segment settles itself, unless that puts too many candidates in a row."""
    width = SEGMENT_COOLDOWNS * gap
    fullest = with_segment(firsts, time, width).groupBy(key, SEGMENT).count().agg(F.max("count")).first()[0]
    return width if (fullest or 0) <= SEGMENT_ROWS else min(width, SEGMENT_MS)


def _sections(firsts: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """``key, segment, _times, _rows``: the candidates of every segment that has any, in order of time."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(time).cast("bigint").alias("t"), "_row")))
    sections = with_segment(firsts, time, width).groupBy(key, SEGMENT).agg(rows.alias("_rows"))
    return sections.withColumn("_times", F.transform("_rows", lambda r: r["t"]))


def step_maps(sections: DataFrame, key: str, gap: int) -> DataFrame:
    """``key, segment, entry, exit, settled``: what each segment makes of the last acceptance before it.

    If ``a`` was accepted last, the first candidate from ``a + gap`` on is accepted next. ``exit[i]`` is what is
    accepted last in the segment if that candidate is later than ``entry[i - 1]`` and not later than ``entry[i]``; beyond
    the last entry nothing in the segment is accepted. Only entries within reach of earlier candidates are kept.
    ``settled`` segments end with ``exit[0]`` whatever came before.
    """
    earlier = Window.partitionBy(key).orderBy(SEGMENT)
    ends = sections.select(key, SEGMENT, F.element_at("_times", -1).alias("_end"))
    before = ends.select(key, SEGMENT, F.lag("_end").over(earlier).alias("_before"))

    @F.pandas_udf("struct<entry: array<bigint>, exit: array<bigint>, settled: boolean>")
    def steps(times: pd.Series, before: pd.Series) -> pd.DataFrame:
        out = []
        for line, since in zip(times, before):
            follow = np.searchsorted(line, line + gap)
            last = line.copy()
            for i in range(len(line) - 1, -1, -1):
                if follow[i] < len(line):
                    last[i] = last[follow[i]]
            # The latest candidate before the segment opens it latest; without one its first candidate is accepted.
            limit = line[0] if pd.isna(since) else int(since) + gap
            reach = min(len(line), int(np.searchsorted(line, limit)) + 1)
            ends = np.append(last[1:reach] != last[: reach - 1], True)
            out.append((line[:reach][ends], last[:reach][ends], bool(ends.sum() == 1 and line[-1] >= limit)))
        return pd.DataFrame(out, columns=["entry", "exit", "settled"])

    joined = sections.select(key, SEGMENT, "_times").join(before, [key, SEGMENT])
    return joined.select(key, SEGMENT, steps("_times", "_before").alias("_m")).select(key, SEGMENT, "_m.*")


def pointers(maps: DataFrame, key: str, gap: int, width: int) -> DataFrame:
    """``key, segment, at, root, to, to_segment, cut``: where every possible last acceptance of a segment leads.

    ``to`` is what is accepted last in ``to_segment``, the next segment in which anything is accepted after ``at``. Roots
    are sure to be accepted; a pointer into a settled segment is ``cut``, as its end is a root of its own.
    """
    later = Window.partitionBy(key).orderBy(SEGMENT)
    heads = maps.select(key, SEGMENT, F.col("exit")[0].alias("_exit"), "settled")
    following = heads.select(key, SEGMENT, *[F.lead(c).over(later).alias(f"_next{c}") for c in (SEGMENT, "_exit", "settled")])
    lit = maps.join(following, [key, SEGMENT])
    # Segments without candidates lead to the next one; only those within a cooldown can be asked for.
    first, last = F.col(SEGMENT) + 1, F.least(F.col(f"_next{SEGMENT}") - 1, F.col(SEGMENT) + F.lit(-(-gap // width)))
    empty = lit.where(last >= first).withColumn(SEGMENT, F.explode(F.sequence(first, last)))
    nothing = F.array().cast("array<bigint>")
    empty = empty.withColumn("entry", nothing).withColumn("exit", nothing).withColumn("settled", F.lit(False))
    index = lit.unionByName(empty).select(
        F.col(key).alias("_key"), F.col(SEGMENT).alias("_at"), "entry", "exit", F.col("settled").alias("_own"),
        f"_next{SEGMENT}", "_next_exit", "_nextsettled",
    )
    ends = maps.select(key, SEGMENT, F.col("settled").alias("root"), F.explode(F.array_distinct("exit")).alias("at"))
    opens = F.col("at") + F.lit(gap)
    meet = (F.col(key) == F.col("_key")) & (F.floor(opens / F.lit(width)) == F.col("_at"))
    later_entries = F.size(F.filter("entry", lambda e: e >= opens))
    here = (F.col("_at").isNotNull()) & (later_entries > 0)
    return ends.join(index, meet, "left").select(
        key, SEGMENT, "at", "root",
        F.when(here, F.get("exit", F.size("exit") - later_entries)).otherwise(F.col("_next_exit")).alias("to"),
        F.when(here, F.col("_at")).otherwise(F.col(f"_next{SEGMENT}")).alias("to_segment"),
        F.coalesce(F.when(here, F.col("_own")).otherwise(F.col("_nextsettled")), F.lit(True)).alias("cut"),
    )


def followed(steps: DataFrame, key: str) -> DataFrame:
    """``key, at``: all that can be reached from the roots of ``steps``, a written table of :func:`pointers`.

    Round ``k`` holds the pointers over ``2**k`` segments. Going back from the longest, what is marked so far takes one
    jump of each length, which reaches every distance.
    """
    jumps, jump = [], steps.where("NOT cut").select(key, "at", "to")
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select(key, F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = materialize(jump.join(onward, [key, "to"]).select(key, "at", F.col("_to").alias("to")), "jumps")
    marked = steps.where("root").select(key, "at")
    for jump in reversed(jumps):
        marked = materialize(marked.union(marked.join(jump, [key, "at"]).select(key, F.col("to").alias("at"))), "marked")
    return marked


def cooldown(
    candidates: DataFrame, key: str, time: str, cooldown_ms: int, tie: str, width: int | None = None
) -> DataFrame:
    """Accept a candidate if at least ``cooldown_ms`` passed since the last *accepted* one.

    ``width`` is a segment's length in the unit of ``time``; it bounds the candidates of a key that meet in one row,
    whatever the cooldown. Without it segments are as long as eight cooldowns, or six hours if some key has too many
    candidates for that. Candidates already passed the score threshold; keep them narrow (ids, not samples). Of
    candidates at one time only the first by ``tie`` can be accepted. A NULL key or time is an error. Segments and
    pointers are written to the work folder.
    """
    missing = F.raise_error(F.lit(f"NULL in {key}: a cooldown needs a key")).cast(candidates.schema[key].dataType)
    candidates = candidates.withColumn(key, F.coalesce(key, missing))
    if cooldown_ms <= 0:
        return candidates
    gap = int(cooldown_ms)
    firsts = materialize(_firsts(candidates, key, time, tie), "candidates")
    width = width or _segment_width(firsts, key, time, gap)
    sections = materialize(_sections(firsts, key, time, width), "sections")
    maps = materialize(step_maps(sections, key, gap), "steps")
    steps = materialize(pointers(maps, key, gap, width), "pointers")
    marked = followed(steps, key)
    # Where the path goes on, it enters the next segment; every key begins in its first.
    entered = steps.join(marked, [key, "at"]).where("to_segment IS NOT NULL").select(key, F.col("to_segment").alias(SEGMENT), F.col("at").alias("_since"))
    begun = sections.groupBy(key).agg(F.min(SEGMENT).alias(SEGMENT)).withColumn("_since", F.lit(None).cast("bigint"))

    @F.pandas_udf("array<int>")
    def replay(times: pd.Series, since: pd.Series) -> pd.Series:
        picked = []
        for line, accepted in zip(times, since):
            follow = np.searchsorted(line, line + gap)
            at, chosen = 0 if pd.isna(accepted) else int(np.searchsorted(line, int(accepted) + gap)), []
            while at < len(line):
                chosen.append(at)
                at = int(follow[at])
            picked.append(chosen)
        return pd.Series(picked, dtype=object)

    # keeps the optimizer from adding a filter that runs the function a second time
    replay = replay.asNondeterministic()
    accepted = sections.join(entered.unionByName(begun), [key, SEGMENT]).withColumn("_picked", replay("_times", "_since"))
    return (
        accepted.withColumn("_at", F.explode("_picked"))
        .select(F.col("_rows")[F.col("_at")]["_row"].alias("_row"))
        .select("_row.*")
    )
