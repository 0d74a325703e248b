"""Ordered rows within groups: runs, context around matches, gaps, nearest containers, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: (group, run, value, first order columns, length)."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    told = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(*group, "run").agg(F.min_by(value, F.struct(*order)).alias(value), *[F.min(c).alias(f"first_{c}") for c in order[:1]], F.count(F.lit(1)).alias("length"))


def context_lines(rows: DataFrame, group: list[str], order: list[str], match: Column, around: int = 1, head: int = 8, tail: int = 12, whole: int = 0) -> DataFrame:
    """Rows near a match, and the first and last ones of a group, or all of a group of `whole` rows or fewer; adds `line` (from 1), `n_lines` and `skipped` before it."""
    w = Window.partitionBy(*group).orderBy(*order)
    near = F.max(F.when(match, 1).otherwise(0)).over(w.rowsBetween(-around, around))
    told = rows.withColumn("line", F.row_number().over(w)).withColumn("_near", near).withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    kept = told.where((F.col("n_lines") <= whole) | (F.col("_near") == 1) | (F.col("line") <= head) | (F.col("line") > F.col("n_lines") - tail)).drop("_near")
    return kept.withColumn("skipped", F.col("line") - F.coalesce(F.lag("line").over(Window.partitionBy(*group).orderBy("line")), F.lit(0)) - 1)


def narrowest(points: DataFrame, intervals: DataFrame, on: list[str], point: str, low: str, high: str, key: list[str], name: str, bucket: float) -> DataFrame:
    """For each point the narrowest interval [low, high) that holds it (ties by name); points in none have nulls.

    Intervals are laid on a grid of the bucket's width, and points meet only those of their own cell.
    """
    cell = F.floor(F.col(point) / bucket)
    laid = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    met = points.withColumn("_cell", cell).join(laid, [*on, "_cell"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    best = met.groupBy(*key).agg(F.min_by(F.struct(name, low, high), F.struct((F.col(high) - F.col(low)).alias("w"), F.col(name).alias("n"))).alias("x"))
    return points.join(best.select(*key, "x.*"), key, "left")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of equal `on` whose closed ranges overlap."""
    (a, b), (c, d) = left_range, right_range
    return left.join(right, on).where((F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)))
