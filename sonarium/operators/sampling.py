"""Exact, deterministic sampling, balancing and shuffling by key hash.

"The n rows with the smallest digest" is found without sorting or shuffling the rows: a histogram over
digest prefixes (4,096 buckets) names the bucket in which a stratum reaches its quota, further digits
split that bucket until few rows are left, and those are ranked. What comes back to the driver is one
row per stratum; the sample itself is a plain filter ``digest <= cut-off`` over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.keys import md5_key
from sonarium.schemas import NEGATIVE_LABEL

PREFIX = 3  # hex digits per histogram level
RANKED_ROWS = 1_000_000  # a bucket is ranked once it holds no more rows than this


def _histogram(rows: DataFrame, digits: int) -> DataFrame:
    return rows.groupBy("_stratum", F.substring("_digest", 1, digits).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_rows")
    )


def _boundaries(counts: DataFrame, quota: Column) -> list:
    """Per stratum the bucket in which its quota is reached and how many rows of it are needed.

    A stratum with quota 0 has no such bucket.
    """
    upto = Window.partitionBy("_stratum").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.withColumn("_quota", quota)
        .withColumn("_cum", F.sum("_rows").over(upto))
        .filter((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_rows") < F.col("_quota")))
    )
    return found.select("_stratum", "_prefix", "_rows", (F.col("_quota") - F.col("_cum") + F.col("_rows")).alias("_need")).collect()


def _fixed(quotas: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("_stratum") == s, F.lit(n)) for s, n in quotas.items()])


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def digest_cutoffs(rows: DataFrame, quota: Column) -> dict[str, tuple[str, int, int]]:
    """The ``quota``-th smallest ``_digest`` of every ``_stratum``, how many rows share it, and how many of those belong
    to the quota; a quota must not exceed its stratum.

    ``quota`` is computed beside the first histogram (``_stratum, _prefix, _rows``), so it may use window
    sums over it. One row per stratum reaches the driver at each step.
    """
    digits = PREFIX
    marks = _boundaries(_histogram(rows, digits), quota)
    if not marks:
        return {}
    while True:
        inside = rows.filter(
            _any([(F.col("_stratum") == m["_stratum"]) & F.col("_digest").startswith(m["_prefix"]) for m in marks])
        ).select("_stratum", "_digest")
        needs = {m["_stratum"]: m["_need"] for m in marks}
        if max(m["_rows"] for m in marks) <= RANKED_ROWS or digits >= 30:
            break
        digits += PREFIX
        marks = _boundaries(_histogram(inside, digits), _fixed(needs))
    upto = Window.partitionBy("_stratum").orderBy("_digest").rowsBetween(Window.unboundedPreceding, 0)
    counts = inside.groupBy("_stratum", "_digest").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_cum", F.sum("_rows").over(upto))
    wanted = _any(
        [(F.col("_stratum") == s) & (F.col("_cum") >= n) & (F.col("_cum") - F.col("_rows") < n) for s, n in needs.items()]
    )
    last = counts.filter(wanted).collect()
    return {r["_stratum"]: (r["_digest"], r["_rows"], needs[r["_stratum"]] - r["_cum"] + r["_rows"]) for r in last}


def _drawn(rows: DataFrame, cutoffs: dict[str, tuple[str, int, int]], always: Column | None = None) -> DataFrame:
    """The rows up to the cut-offs. Where more rows share a cut-off digest than belong to the quota, that is, where keys
    repeat, just enough of them are taken, in the order of a hash over all their columns."""
    inside, ties = F.lit(False) if always is None else always, F.lit(False)
    spare = F.lit(0)
    for stratum, (cut, equal, needed) in cutoffs.items():
        here = F.col("_stratum") == stratum
        if needed == equal:
            inside = inside | (here & (F.col("_digest") <= cut))
        else:
            inside, ties = inside | (here & (F.col("_digest") < cut)), ties | (here & (F.col("_digest") == cut))
            spare = F.when(here, F.lit(needed)).otherwise(spare)
    taken = rows.filter(inside)
    if any(needed < equal for _, equal, needed in cutoffs.values()):
        order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns])
        rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(order))
        taken = taken.unionByName(rows.filter(ties).withColumn("_rank", rank).filter(F.col("_rank") <= spare).drop("_rank"))
    return taken.drop("_stratum", "_digest")


def sample_n(df: DataFrame, n: int, seed, keys: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) without replacement. Rows that share ``keys`` are drawn together, but for those
    beyond ``n``."""
    return sample_n_per(df, F.lit("all"), {"all": n}, seed, keys)


def sample_n_per(df: DataFrame, stratum: Column, quotas: dict[str, int], seed, keys: Sequence[str]) -> DataFrame:
    """Exactly ``quotas[s]`` rows of every named stratum (all, if it has fewer)."""
    rows = df.withColumn("_stratum", stratum).withColumn("_digest", md5_key(seed, *[F.col(k) for k in keys]))
    named = rows.filter(F.col("_stratum").isin(*quotas))
    have = F.sum("_rows").over(Window.partitionBy("_stratum"))
    cutoffs = digest_cutoffs(named, F.least(_fixed(quotas), have))
    return _drawn(rows, cutoffs)


def split_draw(n_target: Column, external_ratio: Column, n_real: Column, n_external: Column) -> Column:
    """``STRUCT<n_real, n_external>``: rows to take from either background source.

    The external share is rounded half to even; a source that runs short is topped up by the other.
    """
    want_ext = F.rint(n_target * external_ratio).cast("bigint")
    want_real = n_target - want_ext
    real_short = want_real > n_real
    ext_short = want_ext > n_external
    real = (
        F.when(real_short, n_real)
        .when(ext_short, F.least(n_target - n_external, n_real))
        .otherwise(want_real)
    )
    external = (
        F.when(real_short, F.least(n_target - n_real, n_external))
        .when(ext_short, n_external)
        .otherwise(want_ext)
    )
    return F.struct(real.cast("bigint").alias("n_real"), external.cast("bigint").alias("n_external"))


def balance(
    chunks: DataFrame, keys: Sequence[str], ratio: float = 1.0, external_ratio: float = 0.5, seed=42,
    label: str = "label", pool: str = "noise_pool", negative: str = NEGATIVE_LABEL,
) -> DataFrame:
    """Keep all positives and draw ``int(positives * ratio)`` background rows.

    Background without a pool (real) and with one (external) is drawn apart, so large external pools
    cannot crowd out real recordings. ``keys`` should identify a row. Fewer rows than the target come
    back where both sources run short; :func:`background_shortfall` reports that.
    """
    stratum = (
        F.when(~F.col(label).eqNullSafe(F.lit(negative)), "positive")
        .when(F.col(pool).isNull(), "real")
        .otherwise("external")
    )
    rows = chunks.withColumn("_stratum", stratum).withColumn("_digest", md5_key(seed, *[F.col(k) for k in keys]))
    cutoffs = digest_cutoffs(rows, _draw_quota(ratio, external_ratio))
    return _drawn(rows, cutoffs, always=F.col("_stratum") == "positive")


def _draw_quota(ratio: float, external_ratio: float) -> Column:
    """Quota of a histogram row's stratum, from totals over the (bounded) histogram."""

    def rows_of(name: str) -> Column:
        mine = F.when(F.col("_stratum") == name, F.col("_rows"))
        return F.coalesce(F.sum(mine).over(Window.partitionBy()), F.lit(0))

    target = (rows_of("positive") * F.lit(float(ratio))).cast("bigint")
    drawn = split_draw(target, F.lit(float(external_ratio)), rows_of("real"), rows_of("external"))
    return F.when(F.col("_stratum") == "real", drawn["n_real"]).when(F.col("_stratum") == "external", drawn["n_external"])


def background_shortfall(chunks: DataFrame, ratio: float = 1.0, label: str = "label",
                         negative: str = NEGATIVE_LABEL) -> DataFrame:
    """One row: background target, rows available, rows missing."""
    is_negative = F.col(label).eqNullSafe(F.lit(negative))
    counts = chunks.agg(
        F.count(F.when(~is_negative, 1)).alias("n_positive"), F.count(F.when(is_negative, 1)).alias("n_background")
    )
    target = (F.col("n_positive") * F.lit(float(ratio))).cast("bigint")
    return counts.select(
        target.alias("n_target"),
        "n_background",
        F.greatest(target - F.col("n_background"), F.lit(0)).alias("n_missing"),
    )


def rank_by_digest(df: DataFrame, digest: str, name: str, strata: Sequence[str] = ()) -> DataFrame:
    """Exact 1-based rank over ``(strata..., digest)`` without a single-task sort.

    Rows are ranked inside ``(strata, digest prefix)``; the offsets come from prefix counts, whose
    number is bounded by the strata times 4,096.
    """
    rows = df.withColumn("_p", F.substring(digest, 1, PREFIX))
    groups = [*strata, "_p"]

    def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        """Inner join in which NULL meets NULL; the columns of ``on`` come from ``left``."""
        renamed = right.withColumnsRenamed({c: f"_r{c}" for c in on})
        equal = [left[c].eqNullSafe(renamed[f"_r{c}"]) for c in on]
        return left.join(renamed, equal).drop(*[f"_r{c}" for c in on])

    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    if strata:
        totals = counts.groupBy(*strata).agg(F.sum("_rows").alias("_total"))
        base = totals.withColumn(
            "_base",
            F.coalesce(F.sum("_total").over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        ).drop("_total")
        inside = Window.partitionBy(*strata).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = null_safe(counts, F.broadcast(base), list(strata)).select(
            *groups, (F.col("_base") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_offset")
        )
    else:
        inside = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*groups, F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*groups).orderBy(digest))
    return (
        null_safe(rows.withColumn("_local", local), offsets, groups)
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_p", "_local", "_offset")
    )


def shuffle_rank(df: DataFrame, seed, keys: Sequence[str], name: str = "shuffle_rank") -> DataFrame:
    """Position of every row in the deterministic shuffle."""
    digested = df.withColumn("_digest", md5_key(seed, *[F.col(k) for k in keys]))
    return rank_by_digest(digested, "_digest", name).drop("_digest")


def shuffle(df: DataFrame, seed, keys: Sequence[str]) -> DataFrame:
    """The rows in shuffled order (a range-partitioned sort on the digest)."""
    return df.orderBy(md5_key(seed, *[F.col(k) for k in keys]), *keys)
