"""The whole call as one plan: alignments to variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import depth
from ..operators import calling, pileup, reads
from ..params import CallParams
from ..schemas import CHUNK


def file_counts(alignments: DataFrame, targets: DataFrame, read_groups: DataFrame, samples: DataFrame, params: CallParams) -> DataFrame:
    """Counts by site, sample and file, each file capped. targets: merged."""
    kept = reads.retained(alignments, targets, read_groups, samples, params.min_mapq)
    seen = reads.observations(reads.clipped(reads.aligned_blocks(kept), targets), params.min_baseq)
    return pileup.capped_counts(seen, params.max_depth)


def variants(per_file: DataFrame, samples: DataFrame, contigs: DataFrame, reference: DataFrame, params: CallParams = CallParams(), chunk: int = CHUNK) -> DataFrame:
    """ref_id, chrom, pos, ref, alt, alt_count, dp, alt_fraction, samples; in no order: sinks sort."""
    sites = calling.site_totals(pileup.merged(per_file, params.max_depth), keep_samples=True).where(depth() > 0)
    sites = calling.with_alt(calling.reference_bases(sites, reference, contigs, chunk), params.min_alt_count)
    called = calling.dense_calls(calling.fraction_pass(sites, params.min_alt_fraction), samples.count())
    return called.select("ref_id", "chrom", "pos", "ref", "alt", "alt_count", "dp", "alt_fraction", "samples")


def call_targets(alignments: DataFrame, targets: DataFrame, read_groups: DataFrame, samples: DataFrame, contigs: DataFrame, reference: DataFrame, params: CallParams = CallParams(), chunk: int = CHUNK) -> DataFrame:
    """Both in one. targets: merged."""
    return variants(file_counts(alignments, targets, read_groups, samples, params), samples, contigs, reference, params, chunk)
