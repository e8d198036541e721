"""Rounding, guarded arithmetic, inline tables and display text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def round_even(value: Column, places: int) -> Column:
    """Round half to even on the scaled double, as numpy does.

    ``F.round`` rounds half up on the decimal text: 1.015 gives 1.02, this 1.01.
    """
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 when it is undefined."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def floor_at(value: Column, bound: float) -> Column:
    """Clip from below; unlike ``F.greatest`` an unknown stays unknown."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(bound))))


def cap_at(value: Column, bound: float) -> Column:
    """Clip from above; unlike ``F.least`` an unknown stays unknown."""
    return F.when(value.isNotNull(), F.least(value, F.lit(float(bound))))


def exact_sum(value: Column, places: int) -> Column:
    """Sum values known to ``places`` decimals, whatever order rows arrive in."""
    return F.sum(value.cast(T.DecimalType(18 if places <= 4 else 28, places))).cast("double")


def exact_mean(value: Column, places: int) -> Column:
    return F.try_divide(exact_sum(value, places), F.count(value))


def per_cent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole) * F.lit(100.0)


def currency(value: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(value, 2))


def small_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A constant table inside the plan, so that its size is known to the optimizer."""
    fields = T._parse_datatype_string(schema).fields
    row = F.struct
    entries = [
        row(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True)])
        for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
