"""Statistics of array columns with higher-order functions; no Python on the executors.

Arrays hold finite doubles. An empty array, or one whose statistic is undefined, gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-30


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def median(v: Column) -> Column:
    return let(F.array_sort(v), lambda s: let(F.size(s), lambda n: F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)))


def central(v: Column, power: int) -> Column:
    """Central moment, divided by the count."""
    return let(mean(v), lambda m: mean(F.transform(v, lambda x: F.pow(x - m, F.lit(float(power))))))


def moments(v: Column) -> Column:
    """struct(n, mean, m2, m3, m4)."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def add(s: Column, d: Column) -> Column:
        return F.struct((s["a"] + d * d).alias("a"), (s["b"] + d * d * d).alias("b"), (s["c"] + d * d * d * d).alias("c"))

    n = F.size(v).cast("double")
    sums = lambda m: F.aggregate(F.transform(v, lambda x: x - m), zero, add)
    return let(mean(v), lambda m: let(sums(m), lambda s: F.struct(n.alias("n"), m.alias("mean"), F.try_divide(s["a"], n).alias("m2"), F.try_divide(s["b"], n).alias("m3"), F.try_divide(s["c"], n).alias("m4"))))


def skewness(m: Column) -> Column:
    """Biased skewness, from moments()."""
    return F.when(m["m2"] > EPS, m["m3"] / F.pow(m["m2"], F.lit(1.5)))


def kurtosis(m: Column) -> Column:
    """Pearson's kurtosis (3 for a normal variable), from moments()."""
    return F.when(m["m2"] > EPS, m["m4"] / (m["m2"] * m["m2"]))


def bimodality(skew: Column, kurt: Column) -> Column:
    return F.when(F.abs(kurt) > EPS, (skew * skew + 1) / kurt)


def relative_std(m: Column) -> Column:
    return F.when(F.abs(m["mean"]) > EPS, F.sqrt(m["m2"]) / F.abs(m["mean"]))


def argmax(v: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def peak_run(v: Column, share: float = 0.01) -> Column:
    """struct(width, saturated): the run around the peak that stays above a share of it, over the median.

    The nearest places below on either side bound the run, so no loop is needed.
    """
    def found(z: Column) -> Column:
        peak, n = F.array_max(z), F.size(z)
        below = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(z, i + 1) < share * peak)
        at = argmax(z)
        low = F.coalesce(F.array_max(F.filter(below, lambda i: i < at)), F.lit(-1))
        high = F.coalesce(F.array_min(F.filter(below, lambda i: i > at)), n)
        whole = F.struct((high - low - 1).cast("double").alias("width"), ((low == -1) | (high == n)).alias("saturated"))
        return F.when(peak > EPS, whole).otherwise(F.struct(F.lit(0.0).alias("width"), F.lit(False).alias("saturated")))

    return let(median(v), lambda b: let(F.transform(v, lambda x: x - b), found))


def widths(channels: int, steps: int = 12) -> list[int]:
    """Sub-window widths, evenly spaced in their logarithm."""
    low, high = math.log10(3), math.log10(channels)
    found = {round(10 ** (low + (high - low) * k / (steps - 1))) for k in range(steps)}
    return sorted(w for w in found if w >= 3)


def kurtosis_sweep(v: Column, channels: int, df_hz: float) -> Column:
    """struct(corr, turning_hz, saturated): kurtosis of ever wider windows about the middle, against their bandwidth."""
    sweep = widths(channels)
    logs = [math.log10(w * df_hz) for w in sweep]
    middle = sum(logs) / len(logs)
    x, n = F.array(*(F.lit(g - middle) for g in logs)), len(sweep)
    spread = sum((g - middle) ** 2 for g in logs)
    grid = F.array(*map(F.lit, logs))
    each = F.array(*(kurtosis(moments(F.slice(v, max(0, channels // 2 - w // 2) + 1, w))) for w in sweep))

    def found(k: Column) -> Column:
        def fitted(m: Column) -> Column:
            over = F.sqrt(spread * total(F.transform(k, lambda y: (y - m) * (y - m))))
            corr = F.when(over > EPS, total(F.zip_with(k, x, lambda y, g: (y - m) * g)) / over)
            at = argmax(k)
            c = F.greatest(F.lit(1), F.least(at, F.lit(n - 2)))
            y0, y1, y2 = (F.element_at(k, c + j) for j in (0, 1, 2))
            bend = y0 - 2 * y1 + y2
            shift = F.when(F.abs(bend) > EPS, 0.5 * (y0 - y2) / bend).otherwise(0.0)
            vertex = F.element_at(grid, c + 1) + shift * (F.element_at(grid, c + 2) - F.element_at(grid, c + 1))
            vertex = F.greatest(F.lit(logs[0]), F.least(vertex, F.lit(logs[-1])))
            vertex = F.when((at == 0) | (at == n - 1), F.element_at(grid, at + 1)).otherwise(vertex)
            return F.struct(corr.alias("corr"), F.pow(F.lit(10.0), vertex).alias("turning_hz"), (at >= n - 1).alias("saturated"))

        return let(mean(k), fitted)

    return let(each, found)


def periodogram(v: Column, channels: int, bins: int) -> Column:
    """Power of the frequencies 1 to bins, up to a common factor; the mean plays no part.

    Waves are read from one table of a full turn, so the plan is as small for many channels as for few.
    """
    steps = F.sequence(F.lit(0), F.lit(channels - 1))
    turn = lambda f: F.transform(steps, lambda t: f(t * F.lit(2 * math.pi / channels)))

    def powers(w: Column) -> Column:
        part = lambda k, name: total(F.zip_with(v, steps, lambda x, t: x * F.element_at(w[name], (k * t) % channels + 1)))
        return F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.pow(part(k, "cos"), F.lit(2.0)) + F.pow(part(k, "sin"), F.lit(2.0)))

    return let(F.struct(turn(F.cos).alias("cos"), turn(F.sin).alias("sin")), powers)


def redness(v: Column, channels: int) -> Column:
    """Mean power of the first half over the second half of the lowest fifth of the periodogram."""
    n = max(4, channels // 2 // 5)
    h = n // 2
    return let(periodogram(v, channels, n), lambda p: let(mean(F.slice(p, h + 1, n - h)), lambda c: F.when(c > EPS, mean(F.slice(p, 1, h)) / c)))


def drift_residual(img: Column) -> Column:
    """Deviation of the peak channel of each time step from its least-squares line."""

    def fitted(pk: Column) -> Column:
        n = F.size(pk)
        t = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i - (n - 1) / 2)

        def residual(m: Column) -> Column:
            slope = total(F.zip_with(pk, t, lambda y, s: (y - m) * s)) / F.greatest(total(F.transform(t, lambda s: s * s)), F.lit(EPS))
            return let(slope, lambda b: F.sqrt(mean(F.zip_with(pk, t, lambda y, s: F.pow(y - m - b * s, F.lit(2.0))))))

        return let(mean(pk), residual)

    return let(F.transform(img, lambda r: argmax(r).cast("double")), fitted)


def time_occupancy(img: Column) -> Column:
    """Share of time steps whose peak reaches half the largest."""
    return let(F.transform(img, lambda r: F.array_max(r)), lambda p: F.size(F.filter(p, lambda x: x >= 0.5 * F.array_max(p))) / F.size(p))


def spectrum(img: Column) -> Column:
    """Mean over time of each channel."""
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(img, 1))), lambda c: mean(F.transform(img, lambda r: F.element_at(r, c))))


def time_series(img: Column) -> Column:
    """Mean over channels of each time step."""
    return F.transform(img, lambda r: mean(r))


def crop_fill(img: Column, n_channels: Column, crop: int, pad: float = -1.0) -> Column:
    """A window of `crop` channels about the middle of the n_channels that aren't padding, which leads.

    Padding and values that aren't finite become the median of what is left, 0 if nothing is.
    """
    width = F.size(F.element_at(img, 1))
    crop = max(3, crop)
    low = width - n_channels
    start = F.greatest(low, F.least(low + F.floor(n_channels / 2).cast("int") - crop // 2, width - crop))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != pad)
    cut = F.transform(img, lambda r: F.slice(r, start + 1, crop))
    return let(cut, lambda w: let(F.coalesce(median(F.filter(F.flatten(w), good)), F.lit(0.0)), lambda m: F.transform(w, lambda r: F.transform(r, lambda x: F.when(good(x), x).otherwise(m)))))


def noise_sigma(img: Column, pad: float = -1.0) -> Column:
    """1.4826 times the median absolute deviation of what isn't padding."""
    good = F.filter(F.flatten(img), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != pad))
    return let(good, lambda g: let(median(g), lambda m: 1.4826 * median(F.transform(g, lambda x: F.abs(x - m)))))
