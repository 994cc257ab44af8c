"""Operations on packed blocks of samples (ARRAY<DOUBLE>), interleaved by channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clear(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(0.0))


def scaled(x: Column, gain: float) -> Column:
    return F.transform(x, lambda v: v * gain)


def added(x: Column, y: Column) -> Column:
    """Element by element; unequal lengths are an error."""
    both = F.zip_with(x, y, lambda a, b: a + b)
    return F.when(F.size(x) == F.size(y), both).otherwise(F.raise_error(F.lit("blocks of unequal length")).cast("array<double>"))


def max_abs(x: Column) -> Column:
    """The greatest magnitude, 0 for an empty block."""
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def interleaved(planes: Column) -> Column:
    """[[l0, l1], [r0, r1]] -> [l0, r0, l1, r1]"""
    frames = F.sequence(F.lit(0), F.size(planes[0]) - 1)
    out = F.flatten(F.transform(frames, lambda i: F.transform(planes, lambda p: F.get(p, i))))
    return F.when(F.size(planes[0]) > 0, out).otherwise(F.array().cast("array<double>"))


def plane(x: Column, channel: int, channels: int) -> Column:
    """The samples of one channel; a length that the channels don't divide is an error."""
    own = F.filter(x, lambda _, i: i % channels == channel)
    return F.when(F.size(x) % channels == 0, own).otherwise(F.raise_error(F.lit("the channels don't divide the block")).cast("array<double>"))


def planar(x: Column, channels: int) -> Column:
    return F.array(*[plane(x, k, channels) for k in range(channels)])


def frames(x: Column, channels: int) -> Column:
    """One array per frame."""
    n = F.floor(F.size(x) / channels).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * channels + 1, F.lit(channels)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<double>>"))


def remapped(x: Column, before: int, after: int) -> Column:
    """Another number of channels: one to many fills the first two, many to one is the mean of the first two, others copy
    the first two; what is left is silent."""
    if before == after:
        return x

    def frame(f: Column) -> Column:
        if before == 1:
            return F.array(*[f[0] if k < 2 else F.lit(0.0) for k in range(after)])
        if after == 1:
            return F.array((f[0] + f[1]) / 2)
        return F.array(*[f[k] if k < 2 else F.lit(0.0) for k in range(after)])

    return F.flatten(F.transform(frames(x, before), frame))
