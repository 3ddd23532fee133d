"""Sorted, wrapped and blocked sequence files with their indexes."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.bases import line_layout
from ..operators.intervals import few
from ..schemas import CHUNK
from ..sources import bgzf
from ..sources.fasta import has_index, lengths, read_reference

WIDTH = 60
# Suffixes that the name of a prepared file replaces, tried in this order, and its own suffix.
SUFFIXES = (".fa.gz", ".fasta.gz", ".fna.gz", ".gz", ".fa", ".fasta", ".fna")
PREPARED = ".sorted.fa.gz"


def prepared_path(path: str) -> str:
    folder, name = os.path.split(path)
    for suffix in SUFFIXES:
        if name.endswith(suffix):
            return os.path.join(folder, name[: -len(suffix)] + PREPARED)
    return os.path.join(folder, name + PREPARED)


def laid_out(reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """name, chunk_id, body: the bytes of the file that each row makes, its header and line ends included. The
    lines of a record depend on no other row but its length."""
    size = lengths(reference)
    rows = reference.join(F.broadcast(size) if few(size) else size, "name")
    first, end = F.col("chunk_id") * chunk, F.col("chunk_id") * chunk + F.length("seq")
    head = F.least((-first) % WIDTH + F.when((-first) % WIDTH < 0, WIDTH).otherwise(0), F.length("seq").cast("long")).cast("int")
    rest = F.regexp_replace(F.expr("substring(seq, head + 1)"), f"(.{{{WIDTH}}})", "$1\n")
    # a line that began in the row before ends here if it gets its last base here
    opened = F.when(F.col("head") > 0, F.concat(F.expr("left(seq, head)"), F.when((first + F.col("head")) % WIDTH == 0, "\n").otherwise(""))).otherwise("")
    closed = F.when((end == F.col("length")) & ((end % WIDTH != 0) | (end == 0)), "\n").otherwise("")
    title = F.when(F.col("chunk_id") == 0, F.concat(F.lit(">"), "name", F.lit("\n"))).otherwise("")
    return rows.withColumn("head", head).select("name", "chunk_id", F.concat(title, opened, rest, closed).alias("body"))


def index_rows(size: DataFrame) -> DataFrame:
    """name, length, offset, line_bases, line_width of the records of a file sorted by name, from their lengths.
    One row a record goes through the window."""
    width, line = line_layout(F.col("length"), WIDTH)
    rows = size.withColumns({"line_bases": width, "line_width": line})
    lines = F.expr("(length + line_bases - 1) div line_bases")
    body = F.when(F.col("length") == 0, F.lit(1).cast("long")).otherwise(F.col("length") + lines)
    head = F.octet_length("name") + 2
    before = F.sum(head + body).over(W.orderBy("name").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("name", "length", (F.coalesce(before, F.lit(0)) + head).alias("offset"), "line_bases", "line_width")


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    blocks: list[tuple[int, int]]
    size: tuple[int, int]


class FastaWriter(DataSourceWriter):
    """Each task writes the blocks of its rows to a file beside the output; on commit they are joined, and the
    places of the blocks (.gzi) shifted."""

    def __init__(self, path: str):
        self.path, self.stage = path, f"{path}.{uuid.uuid4().hex[:12]}.parts"
        os.makedirs(self.stage, exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        task = TaskContext.get()
        path = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        with open(path, "wb") as fh:
            out = bgzf.Writer(fh)
            for row in rows:
                out.write(row["body"].encode())
            out.flush()
        return Part(task.partitionId(), path, [(0, 0), *out.index] if out.at else [], (out.at, out.passed))

    def commit(self, messages: list[Part | None]) -> None:
        index, at, passed = [], 0, 0
        with open(f"{self.stage}/whole", "wb") as fh:
            for part in sorted((m for m in messages if m and m.blocks), key=lambda m: m.number):
                with open(part.path, "rb") as own:
                    shutil.copyfileobj(own, fh, 1 << 20)
                index += [(at + a, passed + b) for a, b in part.blocks]
                at, passed = at + part.size[0], passed + part.size[1]
            fh.write(bgzf.EOF)
        with open(f"{self.path}.gzi", "wb") as fh:
            fh.write(struct.pack("<Q", max(0, len(index) - 1)) + b"".join(struct.pack("<2Q", *x) for x in index[1:]))
        os.replace(f"{self.stage}/whole", self.path)
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class FastaSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_fasta_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FastaWriter(self.options["path"])


def write_fasta(reference: DataFrame, path: str, chunk: int = CHUNK) -> int:
    """Sequences by name in byte order, lines of WIDTH bases, with .fai and .gzi beside the file. Rows (of
    ``chunk`` bases) are wrapped where they are, sorted over all partitions and compressed by as many tasks;
    the driver joins their files. Returns the number of records."""
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    reference.sparkSession.dataSource.register(FastaSink)
    index = index_rows(lengths(reference)).orderBy("name").collect()
    laid_out(reference, chunk).orderBy("name", "chunk_id").write.format("sitewright_fasta_sink").mode("append").save(path)
    with open(f"{path}.fai.part", "w", encoding="utf-8") as fh:
        fh.writelines("\t".join(map(str, x)) + "\n" for x in index)
    os.replace(f"{path}.fai.part", f"{path}.fai")
    return len(index)


def prepare_reference(spark: SparkSession, path: str) -> str:
    """A reference with indexes: the file itself if it has them, else one prepared before, else one made now."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if has_index(path):
        return path
    made = prepared_path(path)
    if all(os.path.exists(p) for p in (made, f"{made}.fai", f"{made}.gzi")):
        return made
    write_fasta(read_reference(spark, path), made)
    return made
