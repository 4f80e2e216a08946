"""Scalar expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is any run of characters that are not white space (Unicode white space and
# the four ASCII separators).
TOKEN_PATTERN = r"(?U)[^\s\x1c-\x1f]+"

_UNITS_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000}


def epoch_to_timestamp(column: Column, unit: str = "ms") -> Column:
    """Epoch number to a zone-free UTC timestamp, independent of the session time zone."""
    if unit not in _UNITS_PER_SECOND:
        raise ValueError(f"unknown epoch unit: {unit}")
    seconds = column.cast("decimal(20,0)") / F.lit(_UNITS_PER_SECOND[unit])
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def event_weight(event: Column, weights: dict[str, float]) -> Column:
    """Weight of an event type; null for types without a weight."""
    pairs = [part for name, weight in weights.items() for part in (F.lit(name), F.lit(float(weight)))]
    return F.try_element_at(F.create_map(*pairs), event) if pairs else F.lit(None).cast("double")


def tokens(text: Column) -> Column:
    """Lower-cased white-space separated tokens, in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def property_phrase(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit("_"), value)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit_vector(vector: Column) -> Column:
    """L2-normalised array; the zero vector stays zero.

    The norm is bound as a lambda variable: written inside the inner lambda it would be recomputed for
    every element.
    """
    norms = F.array(F.sqrt(dot(vector, vector)))
    scaled = F.transform(norms, lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector))
    return F.element_at(scaled, 1)


def angular_score(cosine: Column) -> Column:
    """1 - d/2 where d = sqrt(2(1 - cos)); the square root is guarded against cos slightly above 1."""
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - cosine))) / 2


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def fixed_decimals(value: Column, digits: int) -> Column:
    """``%.<digits>f`` text, halves rounded to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
