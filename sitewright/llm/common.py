"""What the operators of this subpackage share: the shared folder, and reading of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: A word is a run of bytes other than these; all of them are ASCII, so UTF-8 text can be cut bytewise.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder; `clear` deletes that part."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sitewright-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators saved, once the results that read them are written."""
    _delete(spark, own_folder(spark))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and the loss of an executor
    costs no more than the tasks it was running."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete saved tables that no later plan reads."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, f)


def limit_batches(spark: SparkSession) -> dict[str, str]:
    """Texts may be long: what JVM and Python hold of them at once is a batch, so batches are kept to 500 rows
    and 4 MB (a longer text is a batch of its own) where the session would allow more. What it changed, as it was."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key)
        if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= most:
            before[key] = now
            spark.conf.set(key, str(most))
    return before


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """The same while an operator saves its tables."""
    before = limit_batches(spark)
    try:
        yield
    finally:
        for key, now in before.items():
            spark.conf.set(key, now)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(c: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows: the check before each broadcast."""
    return df.limit(rows + 1).count() <= rows


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Broadcast the right side if it has at most ``rows`` rows, else shuffle both."""
    return left.join(F.broadcast(right) if small(right, rows) else right.hint("merge"), on, how)


def joined_hot(left: DataFrame, right: DataFrame, on: list[str], size: str, how: str = "left", rows: int = 200_000, hot: int = 100_000) -> DataFrame:
    """The same where ``size`` tells how many rows of the left side a row of the right side meets: beyond the
    limit, rows that meet more than ``hot`` are still broadcast, as there is at most one for so many rows of the
    left side, and only the others are shuffled. No key in the shuffle is hot. how: left or inner."""
    if small(right, rows):
        return left.join(F.broadcast(right), on, how)
    busy = right.where(F.col(size) > hot).withColumn("_joined_hot", F.lit(True))
    first = left.join(F.broadcast(busy), on, "left")
    met = first.where("_joined_hot").drop("_joined_hot")
    rest = first.where("_joined_hot IS NULL").select(*left.columns)
    return met.unionByName(rest.join(right.where(F.col(size) <= hot).hint("merge"), on, how))
