"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """Double with NaN turned into null."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def clip(col: Column, low: float | None, high: float | None) -> Column:
    """Clamp to ``[low, high]``; null stays null."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(col.isNotNull(), bounded)


def in_range(col: Column, low: float | None, high: float | None) -> Column:
    """True when the value lies in the closed range; open bounds accept anything."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (col >= F.lit(float(low)))
    if high is not None:
        ok = ok & (col <= F.lit(float(high)))
    return ok


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` for a positive denominator, else null."""
    return F.when(denominator > 0, numerator / denominator)


def exact_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """Sum of doubles as decimals of 18 places, so it does not depend on the order of the rows.

    Where such a decimal does not give back a value (very large or small ones,
    infinity), or the total is too large for one, it is the plain sum.
    """
    def agg(one: Column) -> Column:
        return one if window is None else one.over(window)

    exact = value.try_cast("decimal(38,18)")
    held = agg(F.count(F.when(exact.cast("double") == value, 1))) == agg(F.count(value))
    return F.coalesce(F.when(held, agg(F.try_sum(exact)).cast("double")), agg(F.sum(value)))


def hours(n: float) -> Column:
    """Day-time interval of ``n`` hours, exact to the second."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(round(n * 3600))))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` on the zone-less clock."""
    return F.timestamp_diff("MICROSECOND", start, end)


def order_key(time: Column, tie: Column) -> Column:
    """One number that sorts like ``(time, tie)`` for an integral ``tie``.

    Usable as the ordering of ``max_by``/``min_by`` in a hash aggregate, which a
    struct ordering would turn into a sort of all input rows.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # 2e19 exceeds the spread of 64-bit ties
    stride = F.lit("20000000000000000000").cast("decimal(20,0)")
    key = micros_between(epoch, time).cast("decimal(18,0)") * stride + tie.cast("decimal(20,0)")
    return key.cast("decimal(38,0)")


def sortable(value: Column) -> Column:
    """A 64-bit whole number that sorts like the double ``value``; NaN and null give null.

    Sign, exponent and mantissa are taken apart with exact arithmetic: powers of
    two and quotients by them are exact.
    """
    size = F.abs(number(value))
    guess = F.floor(F.log2(size)).cast("int")
    # the logarithm may be off by one next to a power of two
    low = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size >= 2 * low, 1).when(size < low, -1).otherwise(0)
    mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).cast("long")
    key = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size >= 2.0**-1022, (exponent + 1023).cast("long") * (1 << 52) + mantissa)
        .otherwise((size / 2.0**-1074).cast("long"))
    )
    return F.when(value < 0, -key).otherwise(key)


def offset_key(offset: Column, place: Column, value: Column) -> Column:
    """One number that sorts like ``(offset, place, value)``, for a hash aggregate as :func:`order_key`.

    ``offset`` are microseconds within a window of up to three years, ``place``
    is below 10 000, ``value`` a double.
    """
    # 14 digits of offset, 4 of place, 20 of value
    return (
        (offset * 10_000 + place).cast("decimal(18,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")
        + F.coalesce(sortable(value), F.lit(-(2**63) + 1)).cast("decimal(20,0)")
    ).cast("decimal(38,0)")


def lenient_timestamp(col: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Zone-less timestamp; text that does not parse becomes null."""
    parsed = F.try_to_timestamp(col, F.lit(fmt))
    return parsed.cast("timestamp_ntz")


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0 for missing or non-positive values, else 1 + number of edges below the value."""
    clean = number(value)
    above = sum((F.when(clean > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(1))
    return F.when(clean > 0, above).otherwise(F.lit(0)).cast("int")


def encode_action(first_bin: Column, second_bin: Column, n_bins: int = 5) -> Column:
    return (first_bin * F.lit(n_bins) + second_bin).cast("int")


def decode_action(action: Column, n_bins: int = 5) -> tuple[Column, Column]:
    """Inverse of :func:`encode_action`; an id outside the grid fails the job."""
    checked = F.when((action >= 0) & (action < n_bins * n_bins), action).otherwise(
        F.raise_error(F.concat(F.lit("action id out of range: "), action.cast("string"))).cast("int")
    )
    return F.floor(checked / n_bins).cast("int"), F.pmod(checked, F.lit(n_bins)).cast("int")


def action_label(action: Column, n_bins: int = 5) -> Column:
    """Readable name of an action id, such as ``vaso_Q1×fluid_Q3``."""
    first, second = decode_action(action, n_bins)

    def part(name: str, index: Column) -> Column:
        return F.when(index == 0, F.lit(f"no_{name}")).otherwise(F.concat(F.lit(f"{name}_Q"), index.cast("string")))

    return F.concat(part("vaso", first), F.lit("×"), part("fluid", second))


def normal_split(label: Column) -> Column:
    return F.lower(F.trim(label))


def steady(col: Column, digits: int = 6) -> Column:
    """Rounded double for comparing float aggregates.

    The small offset moves exact rounding ties away from the border, where the
    summation order would decide; a negative zero becomes zero.
    """
    return F.round(col + F.lit(1e-9), digits) + F.lit(0.0)
