"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by a 64-bit hash of the text (texts with equal hashes share a group). The
smallest capacity for which greedy filling needs no more than the given shards is found by binary search over
group sizes, and the groups are cut there. The driver never sees all groups: sizes are summed by the first
BITS of the hash, and only cells in which a cut could fall are divided further, until none is left. So what it
holds depends on the number of shards, not on the rows.

Null text has no bytes; each row counts one byte more than its text. A group is never split, so a shard is as
large as its largest group if that exceeds the mean. Rows are numbered within a shard without gaps; rows with
equal ids in no promised order. With fewer groups than shards some shards are empty. Columns other than the
two named are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filled, joined, save

BITS = 10
#: Rows that one numbering task gets, about.
RUN = 100_000


class Cells:
    """Pieces in order: (first key, bits, bytes, whether it is one group)."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]]):
        self.pieces = sorted(pieces)
        self.ends = list(accumulate(p[2] for p in self.pieces))
        self.total = self.ends[-1] if self.ends else 0

    def cuts(self, capacity: int, shards: int, loose: bool) -> list[int] | None:
        """Byte positions of greedy cuts, if the shards suffice; loose: a piece that is not one group may be
        cut anywhere."""
        at, out = 0, []
        for _ in range(shards):
            if at >= self.total:
                return out
            end = at + capacity
            k = bisect_right(self.ends, end)
            if loose and k < len(self.ends) and not self.pieces[k][3]:
                at = min(end, self.total)
            else:
                stop = self.ends[k - 1] if k else 0
                if stop <= at:
                    return None
                at = stop
            out.append(at)
        return out if at >= self.total else None

    def least(self, shards: int, loose: bool) -> int:
        lo, hi = -(-self.total // shards), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cuts(mid, shards, loose) is not None else (mid + 1, hi)
        return lo


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """groups: key, size. The keys at which the shards after the first begin."""

    def summed(df: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
        cell = F.shiftright("key", 64 - bits).alias("cell")
        got = df.groupBy(cell).agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        return [(r.lo if r.lo == r.hi else r.cell << (64 - bits), bits, r.size, r.lo == r.hi) for r in got.collect()]

    cells = Cells(summed(groups, BITS))
    if not cells.total:
        return []
    while True:
        lo, hi = cells.least(shards, True), cells.least(shards, False)
        if lo >= hi:
            break
        # every cut for a capacity between the two lies between the cuts for these
        a, b = cells.cuts(lo, shards, True), cells.cuts(hi, shards, False)
        split = set()
        for i, x in enumerate(a[:-1]):
            y = b[i] if i < len(b) else cells.total
            first, last = bisect_right(cells.ends, min(x, y)), bisect_right(cells.ends, max(x, y))
            split |= {k for k in range(max(0, first - 1), min(last + 1, len(cells.pieces))) if not cells.pieces[k][3]}
        if not split:
            break
        held = [cells.pieces[k] for k in sorted(split)]
        kept = [p for k, p in enumerate(cells.pieces) if k not in split]
        by_bits: dict[int, list[int]] = {}
        for key, bits, _, _ in held:
            by_bits.setdefault(bits, []).append(key >> (64 - bits))
        for bits, keys in by_bits.items():
            inside = groups.where(F.shiftright("key", 64 - bits).isin(keys))
            kept += summed(inside, min(64, bits + BITS))
        cells = Cells(kept)
    ends = cells.cuts(hi, shards, False)
    firsts = [cells.pieces[bisect_right(cells.ends, e)][0] for e in ends if e < cells.total]
    return firsts


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    text = filled(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    rows = save(rows, "shard-rows")
    cuts = cut_keys(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    # numbering: rows are dealt to runs by id, runs are counted, and each run starts after those before it
    runs = max(4, -(-rows.count() // (RUN * shards)))
    placed = rows.select("id", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(runs)).alias("run"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = placed.withColumn("rn", F.row_number().over(W.partitionBy("shard", "run").orderBy("id", "crc")))
    out = joined(numbered, starts, ["shard", "run"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
