"""The ordered segment dimension and results that list every segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import small_table
from ..params import SEGMENTS


def segment_dimension(spark: SparkSession, extra: tuple[str, ...] = ()) -> DataFrame:
    """Segment names with their display position, five rows plus ``extra``."""
    return small_table(
        spark,
        [(name, place) for place, name in enumerate((*SEGMENTS, *extra), 1)],
        "rfm_segment string, segment_sort_order int",
    )


def per_segment(*parts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Join per-segment results onto the dimension; absent segments keep a row."""
    base = segment_dimension(parts[0].sparkSession, extra)
    return reduce(lambda left, right: left.join(right, "rfm_segment", "left"), parts, base)


def with_sort_order(df: DataFrame) -> DataFrame:
    dimension = segment_dimension(df.sparkSession)
    return df.join(F.broadcast(dimension), "rfm_segment", "left")
