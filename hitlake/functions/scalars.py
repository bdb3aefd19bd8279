"""Scalar functions of the catalogue."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def half_even_at(x: Column, digits: int) -> Column:
    return F.rint(x * 10.0**digits) / 10.0**digits


def log10_floor(x: Column, least: float = 1e-12) -> Column:
    return F.log10(F.when(x < least, F.lit(least)).otherwise(x))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def galactic_latitude(ra_deg: Column, dec_deg: Column) -> Column:
    """Degrees, from equatorial coordinates (J2000)."""
    #: Right ascension and declination of the north galactic pole.
    pole_ra, pole_dec = 192.8595, 27.1284
    d, p = F.radians(dec_deg), math.radians(pole_dec)
    x = F.sin(d) * math.sin(p) + F.cos(d) * math.cos(p) * F.cos(F.radians(ra_deg - pole_ra))
    return F.degrees(F.asin(clip(x, -1.0, 1.0)))


def channel_offset(index: Column, start: Column, n: Column) -> Column:
    """Place of a hit within its cutout, 0 to 1; null without channels."""
    return clip((index - start) / F.when(n > 0, n), 0.0, 1.0)


def binned(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin (edges[k], edges[k + 1]]; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[k]) & (x <= edges[k + 1]), F.lit(k)).otherwise(out)
    return out
