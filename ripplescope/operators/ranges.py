"""Containment joins of points with line ranges.

The join always has equi-keys (tree, file, or what stands for them), so it is a hash or sort-merge join with a residual
condition. For files with very many ranges, bucket splits a file's axis: a range goes to each bucket that it overlaps and a
point to its own, which bounds the rows that one key brings together without changing the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, ranges: DataFrame, on: Sequence[str], line: str = "line", start: str = "start", end: str = "end", bucket: int | None = None) -> DataFrame:
    """All pairs of a point and a range of equal keys with start <= line <= end; key columns once."""
    on = [*on]
    inside = F.col(line).between(F.col(start), F.col(end))
    if bucket is None:
        return points.join(ranges, on).where(inside)
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = points.withColumn("__bucket", F.floor(F.col(line) / bucket))
    return placed.join(spread, [*on, "__bucket"]).where(inside).drop("__bucket")


def innermost(points: DataFrame, ranges: DataFrame, on: Sequence[str], point_key: Sequence[str], range_id: str, **columns) -> DataFrame:
    """(point_key.., range_id): the shortest range around each point, the smaller id on ties; points outside have no row.

    min_by over a struct is a hash aggregate with map-side combine: no sort, no window.
    """
    start, end = columns.get("start", "start"), columns.get("end", "end")
    pairs = containing(points, ranges, on, **columns)
    least = F.min(F.struct((F.col(end) - F.col(start)).alias("length"), F.col(range_id).alias("id"))).alias("x")
    return pairs.groupBy(*point_key).agg(least).select(*point_key, F.col("x.id").alias(range_id))


def line_coverage(ranges: DataFrame, lines: DataFrame, on: Sequence[str], by: Sequence[str], **columns) -> DataFrame:
    """(by.., covered, known, value) over the lines inside the ranges of a group; a line counts once per range.

    value is null if no line of any range is known.
    """
    pairs = containing(lines, ranges, on, **columns)
    counted = pairs.groupBy(*by).agg(F.sum((F.col("hits") > 0).cast("long")).alias("covered"), F.count("*").alias("known"))
    every = ranges.select(*by).distinct().join(counted, [*by], "left")
    zero = F.lit(0).cast("long")
    return every.select(*by, F.coalesce("covered", zero).alias("covered"), F.coalesce("known", zero).alias("known"), (F.col("covered") / F.col("known")).alias("value"))
