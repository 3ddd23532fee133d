"""From counts to variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import COUNTS, base_index, choose_alt, depth, sample_call
from ..schemas import CHUNK
from .intervals import few

#: Rows of a reference (of CHUNK bases) that are broadcast, at most.
REFERENCE_ROWS = 500


def site_totals(counts: DataFrame, keep_samples: bool = False) -> DataFrame:
    """ref_id, pos and counts over samples; on request the samples' own counts as a list."""
    own = [F.collect_list(F.struct("sample_idx", *COUNTS)).alias("own")] if keep_samples else []
    return counts.groupBy("ref_id", "pos").agg(*[F.sum(n).alias(n) for n in COUNTS], *own)


def chunked(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """name, length, chunk_id, seq from name, seq: rows of bounded size."""
    n = F.greatest(F.ceil(F.length("seq") / chunk), F.lit(1))
    rows = sequences.select("name", F.length("seq").cast("long").alias("length"), "seq", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_id"))
    return rows.withColumn("seq", F.substring("seq", (F.col("chunk_id") * chunk + 1).cast("int"), F.lit(chunk)))


def reference_bases(sites: DataFrame, reference: DataFrame, contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds chrom and ref (upper case). A site outside its contig is an error."""
    named = sites.join(contigs.select("ref_id", F.col("name").alias("chrom")), "ref_id")
    named = named.withColumn("chunk_id", F.expr(f"(pos - 1) div {chunk}"))
    rows = reference.select(F.col("name").alias("chrom"), "chunk_id", F.col("seq").alias("chunk_seq"))
    both = named.join(F.broadcast(rows) if few(rows, REFERENCE_ROWS) else rows, ["chrom", "chunk_id"], "left")
    base = F.substring("chunk_seq", (F.col("pos") - F.col("chunk_id") * chunk).cast("int"), F.lit(1))
    where = F.concat(F.lit("position outside the reference: "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))
    ref = F.when(F.col("chunk_seq").isNull() | (F.length(base) == 0) | (F.col("pos") < 1), F.raise_error(where)).otherwise(F.upper(base))
    return both.withColumn("ref", ref).drop("chunk_id", "chunk_seq")


def with_alt(sites: DataFrame, min_alt_count: int = 1) -> DataFrame:
    """Adds alt, alt_count, dp, alt_fraction; keeps sites whose reference base is A, C, G or T and whose best
    other base occurs, and at least ``min_alt_count`` times over all samples."""
    s = sites.where(base_index(F.col("ref")).isNotNull()).withColumn("best", choose_alt(F.col("ref")))
    s = s.withColumns({"alt": F.col("best.alt"), "alt_count": F.col("best.alt_count"), "dp": depth()}).drop("best")
    return s.where(F.col("alt_count") >= max(1, min_alt_count)).withColumn("alt_fraction", F.col("alt_count") / F.col("dp"))


def fraction_pass(sites: DataFrame, least: float) -> DataFrame:
    return sites.where(F.col("alt_fraction") >= least)


def dense_calls(sites: DataFrame, n_samples: int) -> DataFrame:
    """Adds samples: one call for each sample in order; a sample not seen has no depth."""
    own = F.map_from_entries(F.transform("own", lambda s: F.struct(s["sample_idx"], s)))
    zero = F.struct(F.lit(0).alias("sample_idx"), *[F.lit(0).cast("long").alias(n) for n in COUNTS])
    every = F.sequence(F.lit(0), F.lit(n_samples - 1)) if n_samples else F.array().cast("array<int>")
    call = F.transform(every, lambda i: sample_call(F.col("ref"), F.col("alt"), F.coalesce(F.try_element_at(F.col("by_sample"), i), zero)))
    return sites.withColumn("by_sample", own).withColumn("samples", call).drop("by_sample", "own")


def vcf_line(sites: DataFrame) -> DataFrame:
    """Adds line: the record as text, without a line end."""
    each = F.transform("samples", lambda s: F.concat(s["gt"], F.lit(":"), s["dp"], F.lit(":"), s["ad_ref"], F.lit(","), s["ad_alt"]))
    head = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.concat(F.lit("DP="), F.col("dp")), F.lit("GT:DP:AD"))
    return sites.withColumn("line", F.when(F.size("samples") > 0, F.concat(head, F.lit("\t"), F.array_join(each, "\t"))).otherwise(head))
