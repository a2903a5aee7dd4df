"""Operators on interval rows (start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_length(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "union_length") -> DataFrame:
    """Per key, the length that the intervals cover together; empty ones are ignored."""
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(end).over(order)
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("__seen"), F.col(start))), F.lit(0))
    return rows.filter(F.col(end) > F.col(start)).withColumn("__seen", seen).groupBy(*keys).agg(F.sum(fresh).alias(name))


def merged(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Per key, the disjoint intervals that cover the same."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    opens = (F.col(start) > F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col(start) - 1)).cast("int")
    grouped = rows.filter(F.col(end) > F.col(start)).withColumn("__open", opens).withColumn("__run", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def greedy_disjoint(intervals: Column, least: float, tolerance: float = 1e-9) -> Column:
    """Of an array of (start, end), how many long enough ones a scan by start keeps apart. A fold, so not the largest set."""
    usable = F.array_sort(F.filter(intervals, lambda x: x["end"] - x["start"] >= least))
    step = lambda acc, x: F.when(acc["n"].eqNullSafe(0) | (x["start"] >= acc["last"] - tolerance), F.struct((acc["n"] + 1).alias("n"), x["end"].cast("double").alias("last"))).otherwise(acc)
    return F.aggregate(usable, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("last")), step, lambda acc: acc["n"])


def elementary(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, rank, start, end: what lies between neighbouring boundaries of all intervals."""
    points = rows.select(*keys, F.col(start).alias("start")).union(rows.select(*keys, F.col(end))).distinct()
    order = Window.partitionBy(*keys).orderBy("start")
    return points.select(*keys, F.row_number().over(order).alias("rank"), "start", F.lead("start").over(order).alias("end"))


def active(rows: DataFrame, grid: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, rank and label for each elementary interval that one of the label's intervals covers.

    Each label's intervals are merged first and cover a range of ranks, so the rows
    made are those of the result; both joins are on equality.
    """
    spans = merged(rows, [*keys, label])
    low = grid.select(*keys, F.col("start"), F.col("rank").alias("__from"))
    high = grid.select(*keys, F.col("start").alias("end"), F.col("rank").alias("__to"))
    return spans.join(low, [*keys, "start"]).join(high, [*keys, "end"]).select(*keys, label, F.explode(F.sequence("__from", F.col("__to") - 1)).alias("rank"))
