"""Arithmetic on sample arrays as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarium.functions.binding import bind
from sonarium.schemas import INT16_PEAK


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def energy(samples: Column | str) -> Column:
    return F.aggregate(_col(samples), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def sample_power(samples: Column | str) -> Column:
    samples = _col(samples)
    return energy(samples) / F.size(samples)


def rms(samples: Column | str) -> Column:
    return F.sqrt(sample_power(samples))


def peak(samples: Column | str) -> Column:
    return F.array_max(F.transform(_col(samples), lambda x: F.abs(x.cast("double"))))


def scale(samples: Column | str, factor: Column) -> Column:
    samples = _col(samples)
    return bind(factor, lambda f: F.transform(samples, lambda x: x.cast("double") * f))


def peak_renormalize(samples: Column | str, limit: float = INT16_PEAK) -> Column:
    """Scale the whole array down to ``limit`` only if its peak is beyond it."""

    def fit(values: Column) -> Column:
        return bind(
            peak(values),
            lambda top: F.when(top > limit, scale(values, F.lit(float(limit)) / top)).otherwise(values),
        )

    return bind(_col(samples), fit)


def circular_shift(samples: Column | str, k: Column) -> Column:
    """Roll right: ``out[i] = in[(i - k) mod n]``."""

    def roll(values: Column) -> Column:
        n = F.size(values)
        return bind(
            F.pmod(k, n).cast("int"),
            lambda by: F.concat(F.slice(values, n - by + 1, by), F.slice(values, F.lit(1), n - by)),
        )

    return bind(_col(samples), roll)


def mix_at_snr(signal: Column | str, noise: Column | str, snr_db: Column) -> Column:
    """Add noise scaled to the target SNR; silent noise leaves the signal as it is."""
    signal, noise = _col(signal), _col(noise)

    def with_power(noise_power: Column) -> Column:
        factor = F.sqrt(sample_power(signal) / (noise_power * F.pow(F.lit(10.0), snr_db / F.lit(10.0))))
        mixed = bind(
            factor, lambda f: F.zip_with(signal, noise, lambda s, x: s.cast("double") + f * x.cast("double"))
        )
        unchanged = F.transform(signal, lambda s: s.cast("double"))
        return F.when(noise_power == 0, unchanged).otherwise(peak_renormalize(mixed))

    return bind(sample_power(noise), with_power)


def apply_gain(samples: Column | str, gain_db: Column) -> Column:
    return peak_renormalize(scale(samples, F.pow(F.lit(10.0), gain_db / F.lit(20.0))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def correlation_at(window: Column, template: Column) -> Column:
    """Normalised correlation of one full-overlap alignment; 0 where a side is silent."""
    return bind(
        F.sqrt(energy(window) * energy(template)),
        lambda norm: F.when(norm > 1e-12, F.abs(dot(window, template)) / norm).otherwise(F.lit(0.0)),
    )


def zero_crossings(samples: Column | str) -> Column:
    """Share of neighbouring samples that change sign (zero counts as positive)."""
    samples = _col(samples)
    n = F.size(samples)
    left = F.slice(samples, F.lit(1), F.greatest(n - 1, F.lit(0)))
    right = F.slice(samples, F.lit(2), F.greatest(n - 1, F.lit(0)))
    flips = F.zip_with(left, right, lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(flips, F.lit(0.0), lambda s, x: s + x) / n)
