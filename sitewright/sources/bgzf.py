"""Blocked gzip: reading from any block, writing with virtual offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed values of the format: the empty last block, and the most bytes that a block holds here.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAYLOAD = 0xFF00


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with these 18 or more, if one does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    if struct.unpack_from("<I", block, len(block) - 8)[0] != zlib.crc32(data):
        raise ValueError("a BGZF block does not match its checksum")
    return data


def blocks(fh: BinaryIO, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of each block from one that begins at start."""
    fh.seek(start)
    while head := fh.read(18):
        size = block_size(head)
        if size is None:
            raise ValueError(f"no BGZF block at byte {start}")
        block = head + fh.read(size - len(head))
        if len(block) < size:
            raise ValueError(f"the BGZF block at byte {start} is cut off")
        yield start, inflate(block)
        start += size


def deflate(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) + 26 > 0xFFFF:
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


class Writer:
    """Writes blocks; `tell` is the virtual offset of the next byte. The last block is written by `finish`."""

    def __init__(self, fh: BinaryIO):
        self.fh, self.held, self.at, self.passed = fh, bytearray(), 0, 0
        #: (compressed, uncompressed) offset of each block after the first
        self.index: list[tuple[int, int]] = []

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= PAYLOAD:
            self.flush(PAYLOAD)

    def flush(self, n: int | None = None) -> None:
        n = len(self.held) if n is None else n
        if n:
            block = deflate(bytes(self.held[:n]))
            if self.at:
                self.index.append((self.at, self.passed))
            self.fh.write(block)
            self.at += len(block)
            self.passed += n
            del self.held[:n]

    def finish(self) -> None:
        self.flush()
        self.fh.write(EOF)
