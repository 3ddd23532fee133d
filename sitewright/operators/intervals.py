"""Unions of target intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a position within the bins by which blocks and points meet targets: a genome of targets stays below
#: the limit of a broadcast.
BIN = 13
#: Tables of more rows than this are shuffled, not broadcast.
BROADCAST_ROWS = 500_000


def few(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table is small enough to be sent to all executors: by the optimizer's upper estimate of its
    bytes, which needs no job, else by counting up to the limit."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= 16 * rows or df.limit(rows + 1).count() <= rows


def union(targets: DataFrame) -> DataFrame:
    """ref_id, start, end: intervals that overlap or touch become one; empty ones go. An interval begins a new
    one if it starts after the end of all before it."""
    by = W.partitionBy("ref_id").orderBy("start", "end")
    t = targets.where("end > start").withColumn("reach", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy("ref_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def bins(begin: str, end: str) -> Column:
    """One row for each bin of 2**BIN bases that a 0-based half-open interval touches."""
    return F.explode(F.sequence(F.shiftright(begin, BIN), F.shiftright(F.col(end) - 1, BIN)))


def binned(merged: DataFrame) -> DataFrame:
    """ref_id, bin, ts, te: intervals once for each bin that they touch."""
    return merged.select("ref_id", F.col("start").alias("ts"), F.col("end").alias("te")).withColumn("bin", bins("ts", "te"))


def inside(points: DataFrame, merged: DataFrame, pos0: str = "pos0") -> DataFrame:
    """Rows whose 0-based position lies in an interval: the start counts, the end does not. A position meets the
    intervals of its bin, not all of its contig."""
    t = binned(merged).alias("t")
    same = (F.col("p.ref_id") == F.col("t.ref_id")) & (F.shiftright(F.col(f"p.{pos0}"), BIN) == F.col("t.bin"))
    hit = (F.col(f"p.{pos0}") >= F.col("t.ts")) & (F.col(f"p.{pos0}") < F.col("t.te"))
    return points.alias("p").join(F.broadcast(t) if few(t) else t.hint("merge"), same & hit, "left_semi")
