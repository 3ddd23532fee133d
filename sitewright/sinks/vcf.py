"""Variants as one sorted, blocked VCF file with its index.

Rows are sorted by contig and position over all partitions; each task writes the blocks of its rows to a file
beside the output and sums up their place in the index. On commit the driver joins these files behind the
header, shifts the offsets, and only then puts the output in place: a failed call leaves no file.
"""

from __future__ import annotations

import os
import shutil
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.calling import vcf_line
from ..sources import bgzf
from . import index as ix

#: Records of a task after which it tells how far it is.
PROGRESS = 100_000
#: Stands in the header as the program that wrote the file.
SOURCE = "sitewright call-targets"


# Fixed values of the format: the lines of the header.
def header(reference: str, contigs: list[tuple[str, int]], samples: list[str]) -> str:
    lines = [
        "##fileformat=VCFv4.3",
        f"##source={SOURCE}",
        f"##reference={reference}",
        *[f"##contig=<ID={n},length={size}>" for n, size in contigs],
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">',
        '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths for the ref and alt alleles">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]
    return "\n".join(lines) + "\n"


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int
    contigs: dict[int, ix.Contig] = field(default_factory=dict)


class VcfWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, names: list[str], kind: str, verbose: bool = False):
        self.path, self.head, self.names, self.kind, self.verbose = path, head, names, kind, verbose
        self.stage = f"{path}.{uuid.uuid4().hex[:12]}.parts"
        os.makedirs(self.stage, exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        task = TaskContext.get()
        path = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        part = Part(task.partitionId(), path, 0)
        with open(path, "wb") as fh:
            out = bgzf.Writer(fh)
            for row in rows:
                start = out.tell()
                out.write(row["line"].encode() + b"\n")
                part.contigs.setdefault(row["ref_id"], ix.Contig()).add(row["pos"] - 1, row["pos"], start, out.tell())
                part.rows += 1
                if part.rows % PROGRESS == 0:
                    self.say(f"write progress: part={part.number} variants={part.rows}")
            out.flush()
        return part

    def say(self, what: str) -> None:
        if self.verbose:
            print(f"[call-targets] {what}", file=sys.stderr, flush=True)

    def commit(self, messages: list[Part | None]) -> None:
        began = time.monotonic()
        whole: dict[int, ix.Contig] = {}
        temporary = f"{self.stage}/whole"
        with open(temporary, "wb") as fh:
            first = bgzf.Writer(fh)
            first.write(self.head.encode())
            first.flush()
            for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.number):
                at = fh.tell()
                with open(part.path, "rb") as own:
                    shutil.copyfileobj(own, fh, 1 << 20)
                for ref, contig in part.contigs.items():
                    whole.setdefault(ref, ix.Contig()).extend(contig, at)
            fh.write(bgzf.EOF)
        joined = time.monotonic()
        with open(f"{temporary}.index", "wb") as fh:
            fh.write((ix.csi if self.kind == "csi" else ix.tbi)(whole, self.names))
        os.replace(f"{temporary}.index", f"{self.path}.{self.kind}")
        os.replace(temporary, self.path)
        shutil.rmtree(self.stage, ignore_errors=True)
        rows, parts = sum(m.rows for m in messages if m), sum(1 for m in messages if m and m.rows)
        self.say(f"write breakdown: variants={rows} parts={parts} join_ms={1000 * (joined - began):.2f} index_ms={1000 * (time.monotonic() - joined):.2f} index={self.kind}")

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class VcfSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_vcf"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VcfWriter(self.options["path"], self.options["header"], self.options["contigs"].split("\n"), self.options.get("index", "csi"), self.options.get("verbose") == "true")


def write_vcf(variants: DataFrame, path: str, reference: str, contigs: list[tuple[str, int]], samples: list[str], index: str = "csi", verbose: bool = False) -> None:
    """variants: as the plan returns them. path must be on a file system that all executors mount."""
    if index not in ("csi", "tbi"):
        raise ValueError(f"{index} is no index type; csi and tbi are")
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    variants.sparkSession.dataSource.register(VcfSink)
    lines = vcf_line(variants).select("ref_id", "pos", "line").orderBy("ref_id", "pos")
    named = {"header": header(reference, contigs, samples), "contigs": "\n".join(n for n, _ in contigs), "index": index, "verbose": str(verbose).lower()}
    lines.write.format("sitewright_vcf").options(**named).mode("append").save(os.path.abspath(path))
