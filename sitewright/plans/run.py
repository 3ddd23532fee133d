"""A call from files to files."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators import intervals, pileup, reads
from ..params import CallParams
from ..schemas import SAMPLES
from ..sinks.fasta import prepare_reference
from ..sinks.vcf import write_vcf
from ..sources import bam, text
from ..sources.fasta import needed, read_reference
from .call_targets import file_counts, variants

log = logging.getLogger("sitewright")


@contextmanager
def stage(name: str):
    began = time.monotonic()
    yield
    log.info("[call-targets] stage=%s elapsed=%.2fs", name, time.monotonic() - began)


def run(spark: SparkSession, reference: str, targets: str, output: str, inputs: list[str] | None = None, bamlist: str | None = None, rg_map: str | None = None, index: str = "csi", params: CallParams = CallParams(), split: int = bam.SPLIT, metrics: bool = False, verbose: bool = False) -> None:
    """Errors come in this order: reference, inputs, headers, targets, samples, then those of the data."""
    with stage("prepare_reference"):
        prepared = prepare_reference(spark, reference)
    with stage("resolve_inputs"):
        paths = text.input_paths(inputs, bamlist)
    with stage("prepare_headers"):
        heads = bam.reconciled(paths)
        contigs = bam.contigs(spark, heads[0])
    with stage("load_targets"):
        merged = pileup.written(intervals.union(text.read_targets(spark, targets, contigs)))
        if merged.isEmpty():
            raise ValueError(f"no target intervals in {targets}")
    with stage("collect_samples"):
        names, groups = text.collect_samples(heads, text.read_rg_map(rg_map) if rg_map else None)
    known = {n: x[0] for n, x in text.read_index(text.index_path(prepared)).items()}
    missing = [n for n, _ in heads[0].contigs if n not in known]
    if missing:
        raise ValueError(f"contig {missing[0]} is not in the reference")
    # of the reference only what the targets touch is read
    rows = read_reference(spark, prepared, only=needed(merged, [n for n, _ in heads[0].contigs]))
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(names)], SAMPLES)
    dims = bam.read_groups(spark, groups)
    refs = [r.ref_id for r in merged.select("ref_id").distinct().collect()]
    per_file = file_counts(bam.read_alignments(spark, paths, split, reads.SKIPPED_FLAGS, refs), merged, dims, samples, params)
    if metrics:
        with stage("scan"):
            per_file = pileup.written(per_file)
            _report(spark, paths, split, merged, dims, per_file, params)
    with stage("write_vcf"):
        write_vcf(variants(per_file, samples, contigs, rows, params), output, reference, [(n, known[n]) for n, _ in heads[0].contigs], names, index, verbose)


def _report(spark: SparkSession, paths: list[str], split: int, merged: DataFrame, dims: DataFrame, per_file: DataFrame, params: CallParams) -> None:
    """Counts of each input. This second pass decodes neither bases nor qualities."""
    found = reads.scan_metrics(bam.read_alignments(spark, paths, split, bases=False), merged, dims, params.min_mapq)
    bases = {r.file_idx: r.n for r in pileup.base_observations(per_file).collect()}
    got = {r.file_idx: r for r in found.collect()}
    for i, path in enumerate(paths):
        r = got.get(i)
        seen, kept, flags, rg = (r.seen, r.retained, r.skipped_flags, r.skipped_rg) if r else (0, 0, 0, 0)
        log.info("[call-targets] finished input %s seen=%d retained=%d base_obs=%d skipped_flags=%d skipped_rg=%d", path, seen, kept, bases.get(i, 0), flags, rg)
