"""Rounding as Python does it."""

from pyspark.sql import Column, functions as F

_SPLIT = 134_217_729.0  # 2**27 + 1, splits a double into two halves whose products are exact


def py_round(x: Column, digits: int = 2) -> Column:
    """Round the exact binary value, ties to even (2.675 -> 2.67, 0.125 -> 0.12), where Spark rounds the printed decimal.

    x * 10**digits is kept as the double product and its exact error, so the comparison with one half is exact. For
    digits up to 7 and magnitudes below 2**52 / 10**digits.
    """
    m = F.lit(10.0**digits)

    def scaled(v: Column) -> Column:
        p = v * m
        high = v * _SPLIT - (v * _SPLIT - v)
        rest = (high * m - p) + (v - high) * m
        f = F.floor(p).cast("double")
        side = (p - f - 0.5) + rest
        up = (side > 0) | ((side == 0) & (F.pmod(f, F.lit(2.0)) == 1.0))
        down = (p == f) & (rest < -0.5)
        return (f + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / m

    # bound once, so that a long input expression is not repeated
    return F.transform(F.array(x.cast("double")), scaled)[0]
