"""Filters and lookups on alignments, and their expansion to observations of single bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import base_index
from ..functions.cigar import blocks
from .intervals import BIN, binned, bins, few

#: Fixed value: unmapped, secondary, failed quality control, duplicate, supplementary.
SKIPPED_FLAGS = 0xF04


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a dimension table: broadcast while it is checked to be small, else shuffled and merged."""
    return left.join(F.broadcast(right) if few(right) else right.hint("merge"), on, how)


def flags_pass(flag: Column) -> Column:
    return flag.bitwiseAND(SKIPPED_FLAGS) == 0


def usable(reads: DataFrame) -> DataFrame:
    """Reads that are mapped, primary and sound, on some contig."""
    return reads.where(flags_pass(F.col("flag")) & F.col("ref_id").isNotNull() & (F.col("ref_id") >= 0))


def on_target_contigs(reads: DataFrame, targets: DataFrame) -> DataFrame:
    return lookup(reads, targets.select("ref_id").distinct(), ["ref_id"], "left_semi")


def with_sample(reads: DataFrame, read_groups: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds sample_idx; reads whose group is missing or has no sample go. A group that is no text (the reader
    marks it by a leading NUL) is an error."""
    bad = F.raise_error(F.concat(F.lit("read group of an unexpected type: "), F.substring("rg", 2, 1))).cast("string")
    reads = reads.withColumn("rg", F.when(F.col("rg").startswith("\0"), bad).otherwise(F.col("rg")))
    return lookup(reads, read_groups.where("sample IS NOT NULL").join(samples, "sample").select("rg", "sample_idx"), ["rg"])


def without_sample(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    return lookup(reads, read_groups.where("sample IS NOT NULL").select("rg").distinct(), ["rg"], "left_anti")


def mapq_pass(least: int) -> Column:
    return F.coalesce("mapq", F.lit(0)) >= least


def retained(reads: DataFrame, targets: DataFrame, read_groups: DataFrame, samples: DataFrame, min_mapq: int) -> DataFrame:
    return with_sample(on_target_contigs(usable(reads), targets), read_groups, samples).where(mapq_pass(min_mapq))


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """One row for each run of aligned bases: 0-based half-open start and end on the contig, q0 on the read.
    Reads without a start, or with qualities of another length than the sequence, have none."""
    sound = reads.where(F.col("pos").isNotNull() & (F.length("seq") == F.length("qual")))
    b = sound.withColumn("b", F.explode(blocks(F.col("cigar"))))
    start = F.col("pos") - 1 + F.col("b.r")
    return b.withColumns({"bs": start, "be": start + F.col("b.len"), "q0": F.col("b.q")}).drop("b", "cigar")


def clipped(blocks_: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks cut to the merged targets they overlap, before any base is expanded. Merged targets are disjoint,
    so no base comes twice. Both sides are keyed by bins of 2**BIN bases, so a block meets the targets near it
    and not all of its contig; a pair that shares several bins counts in the first of them."""
    both = lookup(blocks_.withColumn("bin", bins("bs", "be")), binned(targets), ["ref_id", "bin"])
    lo, hi = F.greatest("bs", "ts"), F.least("be", "te")
    return both.where((lo < hi) & (F.shiftright(lo, BIN) == F.col("bin"))).withColumns({"lo": lo, "hi": hi}).drop("ts", "te", "bin")


def observations(clips: DataFrame, min_baseq: int) -> DataFrame:
    """file_idx, ord, sample_idx, ref_id, pos (1-based), base: one row for each base that is A, C, G or T and
    good enough. Bases past the read's end have quality 0 and are no base."""
    site = clips.withColumn("p", F.explode(F.sequence("lo", F.col("hi") - 1)))
    at = (F.col("q0") + F.col("p") - F.col("bs") + 1).cast("int")
    base, quality = F.upper(F.substring("seq", at, F.lit(1))), F.ascii(F.substring("qual", at, F.lit(1))) - 33
    seen = site.select("file_idx", "ord", "sample_idx", "ref_id", (F.col("p") + 1).alias("pos"), base.alias("base"), F.when(at <= F.length("qual"), quality).otherwise(0).alias("q"))
    return seen.where((F.col("q") >= min_baseq) & base_index(F.col("base")).isNotNull()).drop("q")


def scan_metrics(reads: DataFrame, targets: DataFrame, read_groups: DataFrame, min_mapq: int) -> DataFrame:
    """seen, skipped_flags, skipped_rg, retained for each file, in one pass."""
    t = targets.select("ref_id").distinct().withColumn("hit", F.lit(True))
    g = read_groups.where("sample IS NOT NULL").select("rg").distinct().withColumn("known", F.lit(True))
    rows = lookup(lookup(reads, t, ["ref_id"], "left"), g, ["rg"], "left")
    bad = ~flags_pass(F.col("flag")) | F.col("ref_id").isNull() | (F.col("ref_id") < 0)
    on, known = ~bad & F.col("hit").isNotNull(), F.col("known").isNotNull()
    return rows.groupBy("file_idx").agg(
        F.count("*").alias("seen"), F.count_if(bad).alias("skipped_flags"), F.count_if(on & ~known).alias("skipped_rg"), F.count_if(on & known & mapq_pass(min_mapq)).alias("retained")
    )
