"""Deterministic per-key Gaussian noise (Box–Muller on two 64-bit hashes)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_53 = float(2 ** 53)


def uniform(key: Column, seed: int, stream: int) -> Column:
    """U(0, 1) from xxhash64(seed, stream, key), never 0 or 1."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), key)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(_TWO_53)


def gaussian(key: Column, seed: int) -> Column:
    u1, u2 = uniform(key, seed, 1), uniform(key, seed, 2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
