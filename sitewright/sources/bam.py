"""BAM files as DataFrames.

A file is read in splits of its compressed bytes. A split begins at the first block after its start; the first
record in it is found by trying each byte of the block until a chain of records that make sense follows. A
record belongs to the split in which it begins. ``ord`` is the record's virtual offset, so the order of records
is that of the file however it was split. Files must be on a file system that all executors mount.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import ALIGNMENTS, CONTIGS, READ_GROUPS
from . import bgzf

# Fixed values of the format.
SEQUENCE = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
_PAIRS = [SEQUENCE[i >> 4] + SEQUENCE[i & 15] for i in range(256)]
_PHRED = bytes(min(q, 93) + 33 for q in range(256))
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Records in a row that must make sense where a split begins; bytes of a split; records of a batch.
CHAIN, SPLIT, BATCH = 4, 64 << 20, 8192
#: A read group of a type that is no text is an error once the read is used; it travels as this and the type.
BAD_TYPE = "\0"


@dataclass(frozen=True)
class Header:
    contigs: tuple[tuple[str, int], ...]
    read_groups: tuple[tuple[str, str | None], ...]
    #: Virtual offset of the first record.
    end: int


class _Stream:
    """Bytes over blocks, with virtual offsets."""

    def __init__(self, fh, start: int = 0):
        self.blocks = bgzf.blocks(fh, start)
        self.data, self.at, self.spans = b"", 0, []

    def more(self) -> bool:
        for offset, data in self.blocks:
            if data:
                self.data, self.spans = self.data[self.at :] + data, [(p - self.at, o, s) for p, o, s in self.spans if p + s > self.at] + [(len(self.data) - self.at, offset, len(data))]
                self.at = 0
                return True
        return False

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def tell(self) -> int:
        for p, offset, size in reversed(self.spans):
            if p <= self.at:
                return offset << 16 | (self.at - p)
        return 0


def read_header(path: str) -> Header:
    with open(path, "rb") as fh:
        s = _Stream(fh)
        if s.take(4) != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        text = s.take(struct.unpack("<i", s.take(4))[0]).rstrip(b"\0").decode()
        contigs = []
        for _ in range(struct.unpack("<i", s.take(4))[0]):
            name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
            contigs.append((name, struct.unpack("<i", s.take(4))[0]))
        s.need(1)
        groups = []
        for line in text.splitlines():
            if line.startswith("@RG\t"):
                fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
                if "ID" in fields:
                    groups.append((fields["ID"], fields.get("SM")))
        return Header(tuple(contigs), tuple(groups), s.tell())


def _tags(data: bytes) -> Iterator[tuple[bytes, str, bytes]]:
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            yield name, kind, data[at:end]
            at = end + 1
        elif kind == "B":
            n = _SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
            yield name, kind, data[at : at + 5 + n]
            at += 5 + n
        else:
            yield name, kind, data[at : at + _SIZES[kind]]
            at += _SIZES[kind]


def decode(rec: bytes, bases: bool = True) -> tuple:
    """ref_id, pos, flag, mapq, rg, cigar, seq, qual of a record without its length. Without bases the last three
    are null and cost nothing."""
    ref, pos, n_name, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", rec)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", rec, at) if bases else ()
    at += 4 * n_ops
    seq = "".join(map(_PAIRS.__getitem__, rec[at : at + (n + 1) // 2]))[:n] if bases else None
    at += (n + 1) // 2
    qual = rec[at : at + n] if bases else b""
    rg, long = None, None
    for name, kind, value in _tags(rec[at + n :]):
        if name == b"RG":
            rg = value.decode() if kind in "ZH" else BAD_TYPE + kind
        elif name == b"CG" and kind == "B" and value[:1] == b"I":
            long = struct.unpack_from(f"<{(len(value) - 5) // 4}I", value, 5)
    place = ref if ref >= 0 else None, pos + 1 if pos >= 0 else None, flag, mapq if mapq != 255 else None, rg
    if not bases:
        return *place, None, None, None
    if long is not None and n_ops == 2 and ops[0] == n << 4 | 4 and ops[1] & 15 == 3:
        ops = long
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops)
    absent = not n or qual == b"\xff" * n
    return *place, cigar, seq, "" if absent else qual.translate(_PHRED).decode()


def _sensible(data: bytes, at: int, contigs: Sequence[tuple[str, int]]) -> int | None:
    """The end of the record at a place, if what stands there can be one."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fixed = 32 + n_name + 4 * n_ops + (n + 1) // 2 + n
    if n < 0 or n_name < 1 or not fixed <= size <= 1 << 28:
        return None
    for r, p in ((ref, pos), (mate, mate_pos)):
        if not -1 <= r < len(contigs) or p < -1 or (r >= 0 and p > contigs[r][1]):
            return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops]
    if any(ops[i] & 15 > 8 for i in range(0, len(ops) - 3, 4)):
        return None
    return at + 4 + size


def _chain(s: _Stream, at: int, contigs: Sequence[tuple[str, int]]) -> bool:
    """Whether CHAIN records that make sense, or fewer up to the end of the file, begin at a place."""
    for seen in range(CHAIN):
        while len(s.data) < at + 36:
            if not s.more():
                return seen > 0 and at == len(s.data)
        end = _sensible(s.data, at, contigs)
        if end is None:
            return False
        while len(s.data) < end:
            if not s.more():
                return False
        if _sensible(s.data, at, contigs) is None:  # the name and the operations are all there now
            return False
        at = end
    return True


def first_record(fh, start: int, stop: int, contigs: Sequence[tuple[str, int]]) -> int | None:
    """Virtual offset of the first record that begins in a block from start on and before stop. A record may
    span many blocks, so blocks without a beginning are passed over."""
    while start < stop:
        fh.seek(start)
        window = fh.read(1 << 17)
        found = None
        for m in re.finditer(rb"\x1f\x8b\x08\x04", window):
            size = bgzf.block_size(window[m.start() : m.start() + 64])
            try:
                if size and next(bgzf.blocks(fh, start + m.start())):
                    found = start + m.start()
                    break
            except (ValueError, struct.error, zlib.error):
                continue
        if found is None or found >= stop:
            return None
        s = _Stream(fh, found)
        if not s.more():
            return None
        block = len(s.data)
        for at in range(block if s.spans[0][1] == found else 0):
            if _chain(s, at, contigs):
                return found << 16 | at
        start = found + size
    return None


@dataclass
class Split(InputPartition):
    path: str
    file_idx: int
    start: int
    end: int
    contigs: tuple = field(default=())
    first: int | None = None


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, skip: int = 0, refs: set[int] | None = None, bases: bool = True):
        self.paths, self.split, self.skip, self.refs, self.bases = paths, split, skip, refs, bases

    def partitions(self) -> list[InputPartition]:
        out = []
        for i, path in enumerate(self.paths):
            head, size = read_header(path), os.path.getsize(path)
            for start in range(0, max(size, 1), self.split):
                out.append(Split(path, i, start, min(size, start + self.split), head.contigs, head.end if start == 0 else None))
        return out

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as fh:
            at = part.first if part.first is not None else first_record(fh, part.start, part.end, part.contigs)
            if at is None or at >> 16 >= part.end:
                return
            s = _Stream(fh, at >> 16)
            if not s.need((at & 0xFFFF) + 1):
                return
            s.at = at & 0xFFFF
            rows = []
            while s.need(4):
                place = s.tell()
                if place >> 16 >= part.end:
                    break
                n = struct.unpack("<i", s.take(4))[0]
                rec = s.take(n)
                # a read that the call drops by flag or contig is passed over before it is decoded
                if self.skip and struct.unpack_from("<H", rec, 14)[0] & self.skip:
                    continue
                if self.refs is not None and struct.unpack_from("<i", rec)[0] not in self.refs:
                    continue
                rows.append((part.file_idx, place, *decode(rec, self.bases)))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in ALIGNMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


class BamSource(DataSource):
    """Options: paths (line by line, in the order of files), split (compressed bytes of a task), skip (reads
    with any of these flags are passed over), refs (contigs read, separated by commas), bases (false: no cigar, seq
    and qual)."""

    @classmethod
    def name(cls) -> str:
        return "sitewright_bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        refs = {int(x) for x in o["refs"].split(",") if x} if "refs" in o else None
        return BamReader(o["paths"].split("\n"), int(o.get("split", SPLIT)), int(o.get("skip", 0)), refs, o.get("bases", "true") == "true")


def read_alignments(spark: SparkSession, paths: list[str], split: int = SPLIT, skip: int = 0, refs: list[int] | None = None, bases: bool = True) -> DataFrame:
    spark.dataSource.register(BamSource)
    rows = spark.read.format("sitewright_bam").option("paths", "\n".join(paths)).options(split=split, skip=skip, bases=bases)
    return (rows if refs is None else rows.option("refs", ",".join(map(str, refs)))).load()


def reconciled(paths: list[str]) -> list[Header]:
    """The headers of all inputs, whose contigs must be the same in the same order."""
    if not paths:
        raise ValueError("no input files")
    heads = [read_header(p) for p in paths]
    for p, h in zip(paths, heads, strict=True):
        if h.contigs != heads[0].contigs:
            raise ValueError(f"the contigs of {p} differ from those of {paths[0]}")
    return heads


def contigs(spark: SparkSession, head: Header) -> DataFrame:
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(head.contigs)], CONTIGS)


def read_groups(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, READ_GROUPS)
