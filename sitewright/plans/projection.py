"""Alignments, targets, samples and a reference made from the TPC-H-like tables by integer arithmetic, for
queries that another engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calling import chunked
from ..operators.samples import sample_index

# Fixed values of the projection.
REFERENCE_CYCLE = "ACGTACGTACGTACGTACGTACN"
CIGARS = ("12M", "3S9M", "4M1I7M", "4M2D8M", "5M50N7M", "2H6=1X5M")
READ_BASES = 12
SPAN = 2000
LENGTH = 2100
#: Inputs of a call.
FILES = 3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference_base(p: Column, ref_id: Column) -> Column:
    return F.substring(F.lit(REFERENCE_CYCLE), ((p * p * 31 + p * 17 + ref_id * 7) % 23 + 1).cast("int"), F.lit(1))


def _reference_run(pos: Column, ref_id: Column) -> Column:
    """The reference bases of a read that begins at pos: they repeat after 23, so they are part of a string."""
    every = ["".join(REFERENCE_CYCLE[(k * k * 31 + k * 17 + r * 7) % 23] for k in range(23)) for r in range(5)]
    of = F.element_at(F.array(*[F.lit((c * 2)[: 23 + READ_BASES]) for c in every]), ref_id + 1)
    return F.substring(of, (pos % 23 + 1).cast("int"), F.lit(READ_BASES))


def _qualities(first: Column) -> Column:
    """Qualities (first + 7 i) mod 41: 7 * 6 = 1 mod 41, so they are part of the string of all steps of 7."""
    steps = "".join(chr(7 * k % 41 + 33) for k in range(41 + READ_BASES))
    return F.substring(F.lit(steps), (first * 6 % 41 + 1).cast("int"), F.lit(READ_BASES))


#: What orders the reads of an input.
ORD = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads are made from: an input and numbers, a third of the bytes of the reads."""
    flag = F.col("l_returnflag")
    return _read(spark, sf_dir, "lineitem").select(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("file_idx"), *ORD)


def reads_of(lines: DataFrame) -> DataFrame:
    key, line, part, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    ref_id, pos = (part % 5).cast("int"), 1 + (key * 7 + line * 13) % SPAN
    # base i differs where 11 divides part + 3 i: at i = 7 part mod 11, and 11 bases on
    other, at = F.substring(F.lit("TGCA"), (part % 4 + 1).cast("int"), F.lit(1)), (part * 7 % 11 + 1).cast("int")
    seq = F.overlay(_reference_run(pos, ref_id), other, at)
    seq = F.when(at == 1, F.overlay(seq, other, F.lit(12))).otherwise(seq)
    cigar = F.element_at(F.array(*map(F.lit, CIGARS)), (line % 6 + 1).cast("int"))
    return lines.select(
        "file_idx",
        F.struct(*ORD).alias("ord"),
        ref_id.alias("ref_id"),
        pos.alias("pos"),
        F.when(line == 7, 1024).when(line == 6, 256).otherwise(16).alias("flag"),
        F.col("l_quantity").cast("int").alias("mapq"),
        supp.cast("string").alias("rg"),
        cigar.alias("cigar"),
        seq.alias("seq"),
        _qualities(supp * 3 + part).alias("qual"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(lines(spark, sf_dir))


def raw_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval for each part, on four of the five contigs; some are empty. They begin in the first 20 of
    each 200 bases and end within 31, so gaps stay between them however many parts there are."""
    part = _read(spark, sf_dir, "part")
    place = (F.col("p_partkey") * 131) % SPAN
    start = place - place % 200 + F.col("p_size") % 20
    return part.select((F.col("p_partkey") % 4).cast("int").alias("ref_id"), start.alias("start"), (start + F.col("p_partkey") % 17 - 4).alias("end"))


def read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are read groups, their nations samples; those of nation 0 have none."""
    nation = _read(spark, sf_dir, "nation").where("n_nationkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sample"))
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("rg"), "s_nationkey")
    return supplier.join(F.broadcast(nation), "s_nationkey", "left").select("rg", "sample")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_index(read_groups(spark, sf_dir))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("ref_id"), F.col("r_name").alias("name"), F.lit(LENGTH).cast("long").alias("length"))


def reference(spark: SparkSession, sf_dir: str, chunk: int = 512) -> DataFrame:
    places = F.sequence(F.lit(1).cast("long"), F.lit(LENGTH).cast("long"))
    whole = contigs(spark, sf_dir).select("name", F.array_join(F.transform(places, lambda p: reference_base(p, F.col("ref_id"))), "").alias("seq"))
    return chunked(whole, chunk)
