"""Coordinate indexes (CSI and TBI) of sorted, blocked files."""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field

from ..sources import bgzf

# Fixed values of the formats: bits of the smallest bin, levels of bins, and the tabix header of a VCF.
MIN_SHIFT, DEPTH = 14, 5
VCF_HEADER = (2, 1, 2, 0, ord("#"), 0)


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds a 0-based half-open interval."""
    shift, first = MIN_SHIFT, ((1 << 3 * DEPTH) - 1) // 7
    for level in range(DEPTH, 0, -1):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
        shift += 3
        first -= 1 << 3 * (level - 1)
    return 0


@dataclass
class Contig:
    """bins: chunks of virtual offsets; windows: the least offset of records that begin in each."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)

    def add(self, begin: int, end: int, start: int, stop: int) -> None:
        chunks = self.bins.setdefault(bin_of(begin, end), [])
        if chunks and chunks[-1][1] >= start:
            chunks[-1] = chunks[-1][0], stop
        else:
            chunks.append((start, stop))
        for w in range(begin >> MIN_SHIFT, ((end - 1) >> MIN_SHIFT) + 1):
            self.windows.setdefault(w, start)

    def extend(self, other: Contig, shift: int) -> None:
        """Add what a later part of the file has, whose first block lies ``shift`` bytes on."""
        by = shift << 16
        for b, chunks in other.bins.items():
            self.bins.setdefault(b, []).extend((x + by, y + by) for x, y in chunks)
        for w, at in other.windows.items():
            self.windows.setdefault(w, at + by)

    def offsets(self) -> list[int]:
        """The linear index: empty windows take the offset of the one before."""
        out, last = [], 0
        for w in range(max(self.windows, default=-1) + 1):
            last = self.windows.get(w, last)
            out.append(last)
        return out


def _names(names: list[str]) -> bytes:
    text = b"".join(n.encode() + b"\0" for n in names)
    return struct.pack("<6i", *VCF_HEADER) + struct.pack("<i", len(text)) + text


def _blocked(data: bytes) -> bytes:
    out = io.BytesIO()
    w = bgzf.Writer(out)
    w.write(data)
    w.finish()
    return out.getvalue()


def _least(offsets: list[int], b: int) -> int:
    """The least offset that a record overlapping a bin can have, by the linear index of its contig."""
    first, shift = 0, MIN_SHIFT + 3 * DEPTH
    while b >= first + (1 << (MIN_SHIFT + 3 * DEPTH - shift)):
        first += 1 << (MIN_SHIFT + 3 * DEPTH - shift)
        shift -= 3
    begin = (b - first) << shift >> MIN_SHIFT
    return offsets[begin] if begin < len(offsets) else 0


def csi(contigs: dict[int, Contig], names: list[str]) -> bytes:
    """One entry for each contig of the header, with the names as a tabix header for tools that look for it."""
    aux = _names(names)
    out = [b"CSI\1", struct.pack("<3i", MIN_SHIFT, DEPTH, len(aux)), aux, struct.pack("<i", len(names))]
    for i in range(len(names)):
        c = contigs.get(i, Contig())
        offsets = c.offsets()
        out.append(struct.pack("<i", len(c.bins)))
        for b, chunks in sorted(c.bins.items()):
            out.append(struct.pack("<IQi", b, _least(offsets, b), len(chunks)))
            out += [struct.pack("<2Q", *x) for x in chunks]
    return _blocked(b"".join(out))


def tbi(contigs: dict[int, Contig], names: list[str]) -> bytes:
    """One entry for each contig that has records."""
    there = [i for i in range(len(names)) if i in contigs]
    out = [b"TBI\1", struct.pack("<i", len(there)), _names([names[i] for i in there])]
    for i in there:
        c = contigs[i]
        out.append(struct.pack("<i", len(c.bins)))
        for b, chunks in sorted(c.bins.items()):
            out.append(struct.pack("<Ii", b, len(chunks)))
            out += [struct.pack("<2Q", *x) for x in chunks]
        offsets = c.offsets()
        out.append(struct.pack("<i", len(offsets)))
        out.append(struct.pack(f"<{len(offsets)}Q", *offsets))
    return _blocked(b"".join(out))


def read(data: bytes) -> dict:
    """What an index of either kind holds: kind, names, and for each entry its bins."""
    raw = b"".join(d for _, d in bgzf.blocks(io.BytesIO(data)))
    kind, at = raw[:3].decode(), 4
    if kind == "CSI":
        shift, depth, n_aux = struct.unpack_from("<3i", raw, at)
        aux, at = raw[at + 12 : at + 12 + n_aux], at + 12 + n_aux
        names = aux[28:].split(b"\0")[:-1]
        n = struct.unpack_from("<i", raw, at)[0]
        at += 4
    else:
        n = struct.unpack_from("<i", raw, at)[0]
        size = struct.unpack_from("<i", raw, at + 28)[0]
        names = raw[at + 32 : at + 32 + size].split(b"\0")[:-1]
        at += 32 + size
    entries = []
    for _ in range(n):
        bins = {}
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            b, at = struct.unpack_from("<I", raw, at)[0], at + 4 + 8 * (kind == "CSI")
            k, at = struct.unpack_from("<i", raw, at)[0], at + 4
            bins[b] = [struct.unpack_from("<2Q", raw, at + 16 * i) for i in range(k)]
            at += 16 * k
        if kind == "TBI":
            at += 4 + 8 * struct.unpack_from("<i", raw, at)[0]
        entries.append(bins)
    return {"kind": kind, "names": [x.decode() for x in names], "entries": entries}
