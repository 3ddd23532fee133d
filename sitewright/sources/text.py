"""Inputs that are lists: paths, target intervals, read-group maps, sequence indexes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TARGETS


def _lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as fh:
        return [x for x in (line.strip() for line in fh) if x and not x.startswith("#")]


def input_paths(inputs: list[str] | None = None, bamlist: str | None = None) -> list[str]:
    """Files as named, directories searched for .bam in either case; or the lines of a list. Sorted, once each:
    this is the order in which files fill the depth cap."""
    if not inputs:
        if not bamlist:
            raise ValueError("no input files: give paths or a list of them")
        return sorted(set(_lines(bamlist)))
    found = set()
    for path in inputs:
        if os.path.isdir(path):
            seen: set[str] = set()
            for d, folders, names in os.walk(path, followlinks=True):
                # a link to a folder above would never end
                seen.add(os.path.realpath(d))
                folders[:] = [f for f in folders if os.path.realpath(os.path.join(d, f)) not in seen]
                found.update(os.path.join(d, f) for f in names if os.path.splitext(f)[1].lower() == ".bam")
        else:
            found.add(path)
    return sorted(found)


def read_targets(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """ref_id, start, end of a BED file, not merged. Tabs separate fields; fields after the third are ignored;
    empty intervals are passed over even on an unknown contig, which otherwise is an error."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    part = F.split("line", "\t")
    number = lambda i, what: F.coalesce(F.when(F.get(part, F.lit(i)).rlike(r"^\+?\d{1,18}$"), F.get(part, F.lit(i)).cast("long")), F.raise_error(F.concat(F.lit(f"BED line without a valid {what}: "), "line")).cast("long"))
    rows = rows.select(part[0].alias("name"), number(1, "start").alias("start"), number(2, "end").alias("end")).where("end > start")
    named = rows.join(F.broadcast(contigs.select("name", "ref_id")), "name", "left")
    ref = F.when(F.col("ref_id").isNull(), F.raise_error(F.concat(F.lit("BED contig not in the header: "), "name")).cast("int")).otherwise(F.col("ref_id"))
    return named.select(ref.alias("ref_id"), "start", "end").to(spark.createDataFrame([], TARGETS).schema)


def read_rg_map(path: str) -> list[tuple[str, str]]:
    """Read group and sample of each line with two words or more."""
    rows = [line.split() for line in _lines(path)]
    return [(r[0], r[1]) for r in rows if len(r) > 1]


def collect_samples(headers: list, rg_map: list[tuple[str, str]] | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Samples in order, and the sample of each read group. A map replaces what headers say, and its samples
    keep the order in which they come; samples of headers are sorted."""
    rows = rg_map if rg_map is not None else [(g, s) for h in headers for g, s in h.read_groups if s is not None]
    of: dict[str, str] = {}
    for group, sample in rows:
        if of.setdefault(group, sample) != sample:
            raise ValueError(f"read group {group} has two samples: {of[group]} and {sample}")
    if rg_map is not None and not of:
        raise ValueError("the read-group map is empty")
    names = list(dict.fromkeys(s for _, s in rows)) if rg_map is not None else sorted(set(of.values()))
    if not names:
        raise ValueError("no samples")
    return names, sorted(of.items())


def index_path(reference: str) -> str | None:
    """The sequence index beside a reference: its name and .fai, or its name with the suffix replaced."""
    for path in (f"{reference}.fai", os.path.splitext(reference)[0] + ".fai"):
        if os.path.exists(path):
            return path
    return None


def read_index(path: str) -> dict[str, tuple[int, int, int, int]]:
    """length, offset, bases and bytes of a line for each name; the last of equal names counts."""
    out = {}
    with open(path, encoding="utf-8") as fh:
        for line in fh:
            f = line.rstrip("\n").split("\t")
            if len(f) >= 5:
                out[f[0]] = tuple(int(x) for x in f[1:5])
    return out
