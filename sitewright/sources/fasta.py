"""Sequence files as DataFrames of bounded rows.

A row has at most CHUNK bases, so a chromosome is never one value, and a task reads about RANGE bases:

* files with an index (.fai; blocked ones need .gzi too) are read by ranges of contigs, each from its offset;
* plain files without an index are passed once for the places of records, then read by ranges of bytes;
* other compressed files have no place to begin but the start, and are one task.
"""

from __future__ import annotations

import bisect
import gzip
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CHUNK
from . import bgzf
from .text import index_path, read_index

COMPRESSED = (".gz", ".bgz", ".bgzf")
#: Bases of a task, about; bytes read at once.
RANGE, BLOCK = 1 << 24, 1 << 20
_SPACE = b" \t\n\v\f\r"


def is_compressed(path: str) -> bool:
    return path.lower().endswith(COMPRESSED)


def has_index(path: str) -> bool:
    return bool(index_path(path)) and (not is_compressed(path) or os.path.exists(f"{path}.gzi"))


def pieces(fh, path: str, state: tuple[str | None, bool] = (None, True), number: int = 1) -> Iterator[tuple[str, object]]:
    """("name", name) at each header, ("bases", bytes) for what stands between, and ("block", whether a line
    begins, or None within a header) after each block of bytes read. state: the record at the first byte, and
    whether a line begins there. No line is held but a header."""
    name, fresh = state
    header: list[bytes] | None = None
    while block := fh.read(BLOCK):
        at = 0
        while at < len(block):
            if header is None and fresh and block[at : at + 1] == b">":
                header, at = [], at + 1
            if header is not None:
                end = block.find(b"\n", at)
                header.append(block[at : end if end >= 0 else len(block)])
                at = end + 1 if end >= 0 else len(block)
                if end < 0:
                    break
                words, header, fresh = b"".join(header).split(), None, True
                if not words:
                    raise ValueError(f"empty header at line {number} of {path}")
                name, number = words[0].decode(), number + 1
                yield "name", name
                continue
            end = block.find(b"\n>", at)
            stop = len(block) if end < 0 else end + 1
            number += block.count(b"\n", at, stop)
            bases = block[at:stop].translate(None, _SPACE)
            fresh = block[stop - 1 : stop] == b"\n"
            at = stop
            if bases:
                if name is None:
                    raise ValueError(f"a sequence before any header at line {number - fresh} of {path}")
                yield "bases", bases
        yield "block", fresh if header is None else None
    if header is not None:
        words = b"".join(header).split()
        if not words:
            raise ValueError(f"empty header at line {number} of {path}")
        yield "name", words[0].decode()


def _open(path: str):
    return gzip.open(path, "rb") if is_compressed(path) else open(path, "rb")


def records(path: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, str]]:
    """name, chunk_id, seq in the order of the file. White space is dropped, case is kept; a record without
    bases has one empty chunk."""
    names: set[str] = set()
    with _open(path) as fh:
        yield from chunked(_once(pieces(fh, path), path, names), chunk)
    if not names:
        raise ValueError(f"no sequences in {path}")


def _once(found: Iterator[tuple[str, object]], path: str, names: set[str]) -> Iterator[tuple[str, object]]:
    for kind, value in found:
        if kind == "name":
            if value in names:
                raise ValueError(f"{path} has two sequences named {value}")
            names.add(value)
        yield kind, value


def chunked(found: Iterator[tuple[str, object]], chunk: int, name: str | None = None, passed: int = 0, wanted: int | None = None) -> Iterator[tuple[str, int, str]]:
    """Pieces to rows. From the middle of a record, ``passed`` bases on, rows begin with the first whole chunk;
    with ``wanted``, rows end with the chunk in which that many bases are through."""
    held, n, through = bytearray(), -(-passed // chunk), 0
    skip = n * chunk - passed
    for kind, value in found:
        if kind == "block":
            continue
        if kind == "name":
            if name is not None and (held or not n):
                yield name, n, held.decode()
            if wanted is not None and through >= wanted:
                return
            name, held, n, skip = value, bytearray(), 0, 0
            continue
        through += len(value)
        if skip:
            cut = min(skip, len(value))
            value, skip = value[cut:], skip - cut
        held += value
        whole = len(held) - len(held) % chunk
        for a in range(0, whole, chunk):
            yield name, n, held[a : a + chunk].decode()
            n += 1
            if wanted is not None and through - (len(held) - a - chunk) >= wanted:
                return
        del held[:whole]
    if name is not None and not skip and (held or not n):
        yield name, n, held.decode()


@dataclass
class Ranges(InputPartition):
    """Of an indexed file: name, offset, bases and bytes of a line, first base and end of each range."""

    ranges: list[tuple[str, int, int, int, int, int]]


@dataclass
class Bytes(InputPartition):
    """Of a plain file: its first byte, the record there, its bases before, whether a line begins, and bases up
    to the next partition (none for the last)."""

    start: int = 0
    name: str | None = None
    passed: int = 0
    fresh: bool = True
    wanted: int | None = None


def _cuts(path: str, span: int) -> list[Bytes]:
    """Partitions of a plain file without an index."""
    out, names = [Bytes()], set()
    name, passed, through = None, 0, 0
    with open(path, "rb") as fh:
        for kind, value in _once(pieces(fh, path), path, names):
            if kind == "name":
                name, passed = value, 0
            elif kind == "bases":
                passed, through = passed + len(value), through + len(value)
            elif through >= span and passed and value is not None:
                out[-1].wanted, through = through, 0
                out.append(Bytes(fh.tell(), name, passed, value))
    if not names:
        raise ValueError(f"no sequences in {path}")
    return out


class Blocked:
    """A blocked file as its uncompressed bytes, entered by its index (.gzi)."""

    def __init__(self, path: str):
        with open(f"{path}.gzi", "rb") as fh:
            n = struct.unpack("<Q", fh.read(8))[0]
            pairs = struct.unpack(f"<{2 * n}Q", fh.read(16 * n))
        self.fh, self.places, self.starts = open(path, "rb"), [0, *pairs[::2]], [0, *pairs[1::2]]
        self.at = 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        k = bisect.bisect_right(self.starts, self.at) - 1
        out, need = [], self.at - self.starts[k] + n
        for _, data in bgzf.blocks(self.fh, self.places[k]):
            out.append(data)
            need -= len(data)
            if need <= 0:
                break
        a = self.at - self.starts[k]
        got = b"".join(out)[a : a + n]
        self.at += len(got)
        return got

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.fh.close()


def opened(path: str):
    """The uncompressed bytes of a plain or blocked file, at any offset."""
    return Blocked(path) if is_compressed(path) else open(path, "rb")


def place(base: int, offset: int, line_bases: int, line_width: int) -> int:
    """The byte at which a base of a record stands."""
    n = max(1, line_bases)
    return offset + base // n * line_width + base % n


class FastaReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, span: int, only: dict[str, list[list[int]]] | None):
        self.path, self.chunk, self.only = path, chunk, only
        self.span = max(chunk, span - span % chunk)

    def partitions(self) -> list[InputPartition]:
        if not has_index(self.path):
            return [Bytes()] if is_compressed(self.path) else _cuts(self.path, self.span)
        out, held = [], 0
        for name, (length, offset, bases, width) in read_index(index_path(self.path)).items():
            if length and not bases:
                raise ValueError(f"the index gives {name} lines without bases")
            whole = [[0, max(1, -(-length // self.chunk)) - 1]]
            for first, last in whole if self.only is None else self.only.get(name, []):
                a, end = first * self.chunk, min(length, (last + 1) * self.chunk)
                while a < end or (a == end == 0):
                    b = min(end, a + self.span)
                    if not out or held + b - a > self.span:
                        out.append(Ranges([]))
                        held = 0
                    out[-1].ranges.append((name, offset, bases, width, a, b))
                    held += b - a
                    a = b if b else 1
        return out or [Ranges([])]

    def read(self, part: Ranges | Bytes) -> Iterator[tuple]:
        if isinstance(part, Bytes):
            if is_compressed(self.path):
                yield from records(self.path, self.chunk)
                return
            with open(self.path, "rb") as fh:
                fh.seek(part.start)
                yield from chunked(pieces(fh, self.path, (part.name, part.fresh)), self.chunk, part.name, part.passed, part.wanted)
            return
        with opened(self.path) as fh:
            for name, offset, bases, width, first, end in part.ranges:
                # a read of many chunks costs one entry into the file
                for a in range(first, max(end, first + 1), BLOCK - BLOCK % self.chunk or self.chunk):
                    b = min(end, a + (BLOCK - BLOCK % self.chunk or self.chunk))
                    fh.seek(place(a, offset, bases, width))
                    seq = fh.read(place(b, offset, bases, width) - place(a, offset, bases, width)).translate(None, _SPACE).decode()
                    if len(seq) != b - a:
                        raise ValueError(f"{self.path} ends within {name}")
                    for k in range(0, max(1, b - a), self.chunk):
                        yield name, (a + k) // self.chunk, seq[k : k + self.chunk]


class FastaSource(DataSource):
    """Options: path, chunk (bases of a row), range (bases of a task), only (JSON: for each name the ranges of
    chunks to read, of indexed files)."""

    @classmethod
    def name(cls) -> str:
        return "sitewright_fasta"

    def schema(self) -> str:
        return "name string, chunk_id long, seq string"

    def reader(self, schema) -> DataSourceReader:
        only = self.options.get("only")
        return FastaReader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("range", RANGE)), json.loads(only) if only else None)


def read_reference(spark: SparkSession, path: str, chunk: int = CHUNK, span: int = RANGE, only: dict[str, list[list[int]]] | None = None) -> DataFrame:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(FastaSource)
    rows = spark.read.format("sitewright_fasta").option("chunk", chunk).option("range", span)
    return (rows.option("only", json.dumps(only)) if only is not None and has_index(path) else rows).load(path)


def needed(merged: DataFrame, names: list[str], chunk: int = CHUNK, most: int = 200_000) -> dict[str, list[list[int]]] | None:
    """The chunks that merged targets touch, as ranges for each name; all (None) if the ranges are too many."""
    rows = merged.select("ref_id", F.expr(f"start div {chunk}").alias("a"), F.expr(f"(end - 1) div {chunk}").alias("b")).distinct()
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        return None
    out: dict[str, list[list[int]]] = {n: [] for n in names}
    for r in sorted(got):
        own = out[names[r.ref_id]]
        if own and r.a <= own[-1][1] + 1:
            own[-1][1] = max(own[-1][1], r.b)
        else:
            own.append([r.a, r.b])
    return out


def lengths(reference: DataFrame) -> DataFrame:
    return reference.groupBy("name").agg(F.sum(F.length("seq")).cast("long").alias("length"))
