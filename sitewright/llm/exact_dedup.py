"""Exact duplicates through an extendible-hash index on shared files.

The index has one entry for each distinct key (a 64-bit hash of the text): rows, largest id. Entries lie in
bucket files; the directory maps the first bits of a key to a bucket. It starts with one bucket and doubles
while a bucket holds more than ``capacity`` keys, so only crowded key ranges get deeper. Equal texts collapse
before any shuffle, so a text that a third of all rows hold is still one key. Texts whose key occurs more than
once are compared byte by byte; the directory leads their classes to the bucket of their key, whose owner task
strings those that differ under one key to a chain.

Null text counts as empty, and empty texts equal each other. Of equal texts the row with the largest id stays;
a null id is smaller than any other. Rows repeated with the same id and text count each, and are marked alike.
Of an empty table the result is empty. Columns other than the two named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, filled, joined, joined_hot, new_path, save, small

#: Keys of a bucket file, at most (unless one range of MAX_DEPTH bits has more).
CAPACITY = 1 << 16
MAX_DEPTH = 20


@dataclass(frozen=True)
class HashIndex:
    """rows: id, key, sha256 of each row. directory: cell (the key's first ``depth`` bits), depth, bucket.
    entries: key, rows, top (the largest id), in one file for each bucket."""

    rows: DataFrame
    directory: DataFrame
    entries: DataFrame
    depth: int


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def directory_of(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The directory after all doublings: for each occupied cell the least depth at which the keys that share
    that many first bits fit in a bucket. Its buckets are named by a one followed by those bits."""
    cells = keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("cell")).agg(F.count("*").alias("load"))
    depth = F.lit(max_depth)
    for d in range(max_depth - 1, -1, -1):
        crowd = F.sum("load").over(W.partitionBy(F.shiftright("cell", max_depth - d)))
        depth = F.when(crowd <= capacity, F.lit(d)).otherwise(depth) if d else F.when(F.sum("load").over(W.partitionBy(F.lit(0))) <= capacity, F.lit(0)).otherwise(depth)
    cells = cells.withColumn("depth", depth)
    bits = F.expr(f"shiftright(cell, {max_depth} - depth)")
    return cells.select("cell", "depth", (F.expr("shiftleft(1L, depth)") + bits).alias("bucket"))


def placed(keys: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Adds the bucket of each key, by the directory, which has 2**MAX_DEPTH rows at most."""
    cells = keys.withColumn("cell", F.shiftrightunsigned("key", 64 - depth))
    return joined(cells, directory.select("cell", "bucket"), ["cell"], rows=1 << MAX_DEPTH).drop("cell")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=text_key, capacity: int = CAPACITY) -> HashIndex:
    text = filled(F.col(text_col).cast("string"))
    rows = save(docs.select(F.col(id_col).alias("id"), key(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha")), "dedup-rows")
    keys = save(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("id").alias("top")), "dedup-keys")
    # Cells number 1024 for each bucket that the keys could fill, so the directory stays far below the index.
    spark, depth = docs.sparkSession, 10
    while depth < MAX_DEPTH and not small(keys, capacity << (depth - 10)):
        depth += 1
    directory = save(directory_of(keys, capacity, depth), "dedup-directory")
    path = new_path(spark, "dedup-index")
    placed(keys, directory, depth).select("bucket", "key", "rows", "top").repartition("bucket").write.partitionBy("bucket").parquet(path)
    schema = "key long, rows long, top " + dict(keys.dtypes)["top"] + ", bucket long"
    drop(keys)
    return HashIndex(rows, directory, spark.read.schema(schema).parquet(path), depth)


def chains(docs: DataFrame, index: HashIndex, id_col: str = "doc_id", text_col: str = "text", key=text_key, few: int = 1_000_000) -> DataFrame:
    """The classes of rows whose bytes are equal, of keys with several rows: bucket, key, sha, keep_id, group_size,
    and their place in the key's chain. Equal texts collapse where they are read, so a text moves once from each
    task, and only if its key is shared; keys shared beyond ``few`` are not sent, and all texts collapse so. The
    owner of a bucket then strings the classes of each key, told apart by SHA-256 from here on."""
    text = filled(F.col(text_col).cast("string"))
    shared = index.entries.where("rows > 1").select("key")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", key(F.col("text")))
    if small(shared, few):
        rows = rows.join(F.broadcast(shared), "key", "left_semi")
    classes = rows.groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    owned = placed(classes, index.directory, index.depth).repartition("bucket")
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("sha"))
    return save(owned.withColumn("chain", chain).where("group_size > 1"), "dedup-classes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=text_key, capacity: int = CAPACITY) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for each row."""
    index = build_index(docs, id_col, text_col, key, capacity)
    classes = chains(docs, index, id_col, text_col, key).select("key", "sha", "keep_id", "group_size")
    out = joined_hot(index.rows, classes, ["key", "sha"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
