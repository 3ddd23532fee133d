"""Counts of bases by site and sample, with a depth cap within a file and across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import BASES, COUNTS, depth
from ..shared import shared_folder

GROUP = ["ref_id", "pos", "sample_idx", "file_idx"]
#: Below this cap Spark keeps only the first rows of a group before the shuffle.
RANKED = 1000


def written(df: DataFrame) -> DataFrame:
    """The table, computed once: in the shared folder of checkpoints, where no executor holds it and it is
    deleted with the last plan that reads it if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counts(observed: DataFrame) -> DataFrame:
    """Bases by site, sample and file; combined before the shuffle."""
    return observed.groupBy(*GROUP).agg(*[F.count_if(F.col("base") == b).alias(n) for b, n in zip(BASES, COUNTS, strict=True)])


def first_n(observed: DataFrame, max_depth: int) -> DataFrame:
    """The first observations of each site, sample and file in the order of records."""
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy("ord"))
    return observed.withColumn("rank", rank).where(F.col("rank") <= max_depth).drop("rank")


def capped_counts(observed: DataFrame, max_depth: int) -> DataFrame:
    """Counts of the first ``max_depth`` observations of each group. With a large cap few groups reach it, so
    all are counted, and only the observations of those that exceed it are put in order."""
    if max_depth < RANKED:
        return counts(first_n(observed, max_depth))
    every = written(counts(observed))
    over = every.where(depth() > max_depth).select(*GROUP)
    if over.isEmpty():
        return every
    return every.where(depth() <= max_depth).unionByName(counts(first_n(observed.join(over, GROUP, "left_semi"), max_depth)))


def base_observations(per_file: DataFrame) -> DataFrame:
    """file_idx, n: the bases that each file adds."""
    return per_file.groupBy("file_idx").agg(F.sum(depth()).alias("n"))


def share(space: Column, total: Column) -> list[Column]:
    """The four counts cut to ``space`` in proportion: whole parts first, then one more for the largest
    remainders, the first of equals in the order A, C, G, T."""
    n = [F.col(c) for c in COUNTS]
    sound = F.greatest(total, F.lit(1))
    part = [((x * space - F.pmod(x * space, sound)) / sound).cast("long") for x in n]
    rest = [F.pmod(x * space, sound) for x in n]
    left = space - (part[0] + part[1] + part[2] + part[3])
    out = []
    for i in range(4):
        ahead = [F.when((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(4) if j != i]
        out.append(F.when(total > 0, part[i] + F.when(ahead[0] + ahead[1] + ahead[2] < left, 1).otherwise(0)).otherwise(0).cast("long"))
    return out


def merged(per_file: DataFrame, max_depth: int) -> DataFrame:
    """ref_id, pos, sample_idx and counts over all files, in the order of files: each file adds what fits, in
    proportion if not all does. What fits follows from the totals of the files before it, so nothing is folded
    one file after another. Rows are dealt by site, which later steps by site use again."""
    by = W.partitionBy("ref_id", "pos", "sample_idx").orderBy("file_idx").rowsBetween(W.unboundedPreceding, -1)
    t = per_file.repartition("ref_id", "pos").withColumn("total", depth())
    room = F.greatest(F.lit(max_depth) - F.coalesce(F.sum("total").over(by), F.lit(0)), F.lit(0))
    t = t.withColumn("space", F.least("total", room))
    cut = t.select("ref_id", "pos", "sample_idx", *[c.alias(n) for c, n in zip(share(F.col("space"), F.col("total")), COUNTS, strict=True)])
    return cut.groupBy("ref_id", "pos", "sample_idx").agg(*[F.sum(n).alias(n) for n in COUNTS])
