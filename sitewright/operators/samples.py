"""Read groups and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_index(read_groups: DataFrame) -> DataFrame:
    """sample, sample_idx: distinct samples in byte order. One row a sample goes through the window."""
    names = read_groups.where("sample IS NOT NULL").select("sample").distinct()
    return names.withColumn("sample_idx", (F.row_number().over(W.orderBy("sample")) - 1).cast("int"))


def conflicts(read_groups: DataFrame) -> DataFrame:
    """rg, n_samples for read groups that are given more than one sample."""
    n = F.count_distinct("sample").alias("n_samples")
    return read_groups.where("sample IS NOT NULL").groupBy("rg").agg(n).where("n_samples > 1")
