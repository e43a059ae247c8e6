"""``round(x, n)`` of floats as Python does it: on the binary value, halves to the even neighbour.

2.675 lies below its decimal text, so it rounds to 2.67.  The product with the
power of ten is taken together with its exact error (splitting both factors),
so that the comparison with a half is exact without any decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten up to this are floats without error.
MAX_DIGITS = 22
_SPLIT = 134217729.0  # 2^27 + 1: parts a float into two halves of its digits


def round_float(number: Column, digits: int = 0) -> Column:
    """``round(number, digits)`` of a float column, as a float; NaN and the infinities stay, and so do floats from 2^62 on with negative ``digits``."""
    if abs(digits) > MAX_DIGITS:
        raise ValueError(f"digits must be within {-MAX_DIGITS} and {MAX_DIGITS}")
    size = F.abs(number)
    rounded = _after_point(size, digits) if digits >= 0 else _before_point(size, 10.0**-digits)
    signed = F.when(number < 0, -rounded).otherwise(rounded)
    return F.when(F.isnan(number) | (number == 0) | (size == float("inf")), number).otherwise(signed)


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    return high, x - high


def _after_point(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    big = scale * _SPLIT
    scale_high = big - (big - scale)
    scale_low = scale - scale_high
    product = x * F.lit(scale)
    high, low = _halves(x)
    # product + error is x * scale without rounding.
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    over, missing = product - whole - F.lit(0.5), -error
    up = (over > missing) | ((over == missing) & _odd(whole))
    small = (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)
    # From 2^52 on products are whole numbers; only a tie can still move them, and from 2^53 on x is as near as any.
    tied = F.when((F.abs(error) == 0.5) & _odd(product), product + F.signum(error)).otherwise(product) / F.lit(scale)
    return F.when(product < 2.0**52, small).when(product < 2.0**53, tied).otherwise(x)


def _before_point(x: Column, scale: float) -> Column:
    # Below 2^53 all of this is exact; above, 64-bit whole numbers are; beyond them a float stays as it is.
    guess = F.floor(x / F.lit(scale)).cast("double")
    rest = x - guess * F.lit(scale)
    lower = F.when(rest < 0, guess - 1.0).when(rest >= scale, guess + 1.0).otherwise(guess)
    rest = x - lower * F.lit(scale)
    up = (rest > scale / 2) | ((rest == scale / 2) & _odd(lower))
    small = (lower + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) * F.lit(scale)
    if scale > 2.0**62:
        return F.when(x < 2.0**53, F.lit(0.0)).otherwise(x)
    large = round_whole(x.cast("bigint"), int(scale)).cast("double")
    return F.when(x < 2.0**53, small).when(x < 2.0**62, large).otherwise(x)


def _odd(x: Column) -> Column:
    return x % F.lit(2.0) == 1.0


def round_whole(number: Column, scale: int) -> Column:
    """A whole number to the nearest multiple of ``scale``, halves to the even one."""
    rest = F.pmod(number, F.lit(scale))
    lower = number - rest
    odd = F.pmod(F.call_function("div", lower, F.lit(scale)), F.lit(2)) == 1
    up = (rest * 2 > scale) | ((rest * 2 == scale) & odd)
    return F.when(up, lower + scale).otherwise(lower)
