"""Near duplicates by b-bit MinHash.

One pass over the texts makes, for each document, a key of its whole shingle set, a key for each band of its
minima, and a signature that keeps BITS bits of each minimum. Documents of equal sets count as one from there
on. Documents that share a band meet; the matching bits of their signatures, corrected for the matches that
chance gives, estimate the similarity, and those far below the threshold are let go. What remains hangs
together in clusters, whose full sets are compared exactly: a link rests on sets, never on an estimate.

Bands are as many as lose a pair at the threshold with a chance under 1e-6; the estimate must fall five
standard deviations short to reject. Groups of copies are linked through single members, so a large group
makes few rows; see graph.link_groups for groups beyond the size of a task.

Null text counts as empty. A text without words has an empty set and is linked with nothing; one with fewer
words than a shingle has one shingle. Rows with equal ids are one document. A row without an id is linked
with nothing and is its own. Of an empty table the result is empty. Columns other than the two named are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import drop, filled, joined, joined_hot, save, short_batches
from .graph import FEW, Sets, components, link_groups, sized

SHINGLE, ROWS, BITS = 5, 5, 4
#: Docs of a group that one task compares, at most.
LIMIT = 1024
#: Groups of more chunks than this are dealt before any shuffle.
HOT = 100


def bands_for(similarity: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    n = math.ceil(math.log(miss) / math.log(1 - similarity**rows))
    return n + n * rows % 2


def least_estimate(similarity: float, hashes: int) -> float:
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * similarity
    return similarity - 5 * math.sqrt(p * (1 - p) / hashes) / (1 - chance)


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set: a 32-bit multiply and add."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    y = (x >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(y), 256):
        np.minimum(out, (y[k : k + 256, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, bands: int, id_col: str, text_col: str) -> DataFrame:
    """doc, n, set_a, set_b (the set's key), bands, bits for each row."""
    hashes = bands * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        a = rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        place = (np.arange(1, hashes + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            data, ends = W.texts(batch.column(1))
            rows = batch.num_rows
            n, keys = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            minima = np.zeros((rows, hashes), np.uint32)
            for i, j in W.blocks(ends):
                h, _, _, at = W.word_hashes(data, ends[i : j + 1], lower=True)
                for k in range(j - i):
                    x = np.unique(W.shingles(h[at[k] : at[k + 1]], SHINGLE))
                    if len(x):
                        n[i + k] = len(x)
                        keys[i + k] = np.add.reduce(x), np.add.reduce(W.mix(x + np.uint64(77)))
                        minima[i + k] = _minima(x, a, b)
            mixed = W.mix(minima.astype(np.uint64) + place)
            band = W.mix(mixed.reshape(rows, bands, ROWS).sum(axis=2, dtype=np.uint64)) if rows else mixed
            low = (mixed & np.uint64(15)).astype(np.uint8)
            bits = (low[:, ::2] << 4) | low[:, 1::2]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(keys[:, 0].view(np.int64)) if rows else pa.array([], pa.int64()),
                    pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, rows * bands + 1, bands, dtype=np.int32), band.reshape(-1).view(np.int64)),
                    pa.array([x.tobytes() for x in bits], pa.binary()),
                ],
                ["doc", "n", "set_a", "set_b", "bands", "bits"],
            )
        W.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), filled(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(sign, "doc long, n long, set_a long, set_b long, bands array<long>, bits binary")


_ZEROS = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def estimate(x: np.ndarray, y: np.ndarray, hashes: int) -> np.ndarray:
    """The similarity that matching bits show, less the matches that chance gives."""
    chance = 1 / (1 << BITS)
    return (_ZEROS[x ^ y].sum(axis=-1, dtype=np.int64) / hashes - chance) / (1 - chance)


def estimating(hashes: int, least: float):
    """Kernel over signatures. Each row is held against the first of its group, all groups at once; only in
    groups where that leaves rows apart are the others compared."""

    def kernel(t: pa.Table, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        heads = t.column("heads").to_numpy()
        sizes = np.diff(cuts)
        first = np.repeat(cuts[:-1], sizes)
        near = np.concatenate([estimate(sig[k : k + 65536], sig[first[k : k + 65536]], hashes) >= least for k in range(0, len(first), 65536)])
        a, b = [np.flatnonzero(near)], [first[near]]
        apart = np.add.reduceat((~near).astype(np.int64), cuts[:-1])
        for g in np.flatnonzero((apart > 0) & (sizes > 2)):
            lo, hi = cuts[g], cuts[g + 1]
            sets = Sets(hi - lo)
            sets.unite(0, np.flatnonzero(near[lo:hi]))
            for i in range(1, int(heads[lo:hi].sum())):
                rest = np.flatnonzero(sets.of != sets.of[i])
                rest = rest[rest > i]
                if not len(rest):
                    continue
                got = rest[estimate(sig[lo + rest], sig[lo + i], hashes) >= least]
                if len(got):
                    sets.unite(i, got)
                    a.append(lo + got)
                    b.append(np.full(len(got), lo + i))
        return np.concatenate(a), np.concatenate(b)

    return lambda: kernel


def comparing(percent: int):
    """Kernel over full sets: 100 * intersection >= percent * union."""

    def kernel(t: pa.Table, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = [np.frombuffer(x, np.uint64) for x in t.column("full").to_pylist()]
        heads = t.column("heads").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = full[lo:hi]
            n = np.array([len(x) for x in own])
            sets = Sets(hi - lo)
            for i in range(int(heads[lo:hi].sum())):
                rest = np.flatnonzero((sets.of != sets.of[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                rest = rest[rest > i]
                if not len(rest):
                    continue
                every = np.concatenate([own[j] for j in rest])
                at = np.minimum(np.searchsorted(own[i], every), n[i] - 1)
                both = np.add.reduceat((own[i][at] == every).astype(np.int64), np.append(0, np.cumsum(n[rest])[:-1]))
                got = rest[100 * both >= percent * (n[rest] + n[i] - both)]
                if len(got):
                    sets.unite(i, got)
                    a.append(lo + got)
                    b.append(np.full(len(got), lo + i))
        return np.concatenate(a), np.concatenate(b)

    return lambda: kernel


def full_sets(rows: DataFrame) -> DataFrame:
    """gid, lead, chunks, doc, text to the same with full (the sorted shingles of the whole text) for text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = W.texts(batch.column(4))
            out = []
            for i, j in W.blocks(ends):
                h, _, _, at = W.word_hashes(data, ends[i : j + 1], lower=True)
                out += [np.unique(W.shingles(h[at[k] : at[k + 1]], SHINGLE)).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["gid", "lead", "chunks", "doc", "full"])
        W.give_back()

    return rows.select("gid", "lead", "chunks", "doc", "text").mapInArrow(shingle, "gid long, lead long, chunks int, doc long, full binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, limit: int = LIMIT) -> DataFrame:
    """id, n_shingles, component_id, kept for each row."""
    with short_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, percent, limit)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int, limit: int) -> DataFrame:
    bands = bands_for(percent / 100)
    hashes = bands * ROWS
    signed = save(signatures(docs, bands, id_col, text_col), "near-signatures")
    key = ["set_a", "set_b", "n"]
    # one row stands for each set; where an id has several texts, each of its sets does
    heads = signed.where("n > 0 AND doc IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc", "bands", "bits")).alias("h"), F.count("*").alias("rows"))
    heads = save(heads.select(*key, "h.*", "rows"), "near-heads")
    shared = heads.select(F.explode("bands").alias("gid"), "doc", *key)
    groups = save(sized(shared, limit), "near-bands")
    # each set is judged by its own signature
    bits = heads.select(*key, "bits")
    edges = link_groups(joined_hot(shared, groups, ["gid"], "chunks", "inner", hot=HOT).join(bits, key).drop(*key), groups, estimating(hashes, least_estimate(percent / 100, hashes)), limit)
    drop(groups)
    clusters = components(edges).select(F.col("node").alias("doc"), F.col("component").alias("gid"))
    groups = save(sized(clusters, limit), "near-clusters")
    members = save(joined_hot(clusters, groups, ["gid"], "chunks", "inner", hot=HOT), "near-members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), filled(F.col(text_col).cast("string")).alias("text"))
    links = link_groups(full_sets(joined(texts, members, ["doc"], rows=FEW)), groups, comparing(percent), limit)
    # an id of several sets hangs together with the ids that stand for them
    several = signed.where("doc IS NOT NULL").groupBy("doc").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"), F.count("*").alias("times")).where("a <> b")
    several = save(several.select("doc", "times"), "near-several")
    more = bool(several.limit(1).count())
    if more:
        own_sets = joined_hot(signed.where("n > 0").select("doc", *key), several, ["doc"], "times", "inner", FEW).drop("times").distinct()
        links = links.union(own_sets.join(heads.select(*key, F.col("doc").alias("head")), key).select(F.col("doc").alias("a"), F.col("head").alias("b")))
    labels = components(links).withColumnRenamed("node", "doc")
    named = joined(heads.select(*key, "doc", "rows"), labels, ["doc"], "left", FEW)
    named = save(named.select(*key, "rows", F.coalesce("component", "doc").alias("component_id")), "near-named")
    # a set may be that of a third of all rows; rows without words or without an id have no label to look up
    rows, none = signed.select("doc", *key), F.lit(None).cast("long")
    out = joined_hot(rows.where("n > 0 AND doc IS NOT NULL"), named, key, "rows", "left", FEW).drop("rows")
    out = out.unionByName(rows.where("n = 0 AND doc IS NOT NULL").withColumn("component_id", none))
    if more:
        by_doc = several.join(labels, "doc", "left").select("doc", "times", F.coalesce("component", "doc").alias("of_doc"))
        out = joined_hot(out, save(by_doc, "near-of-doc"), ["doc"], "times", "left", FEW).drop("times")
    else:
        out = out.withColumn("of_doc", none)
    out = out.unionByName(rows.where("doc IS NULL").withColumns({"component_id": none, "of_doc": none}))
    own = F.when(F.col("of_doc").isNotNull(), F.col("of_doc")).when(F.col("n") == 0, F.col("doc")).when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc").eqNullSafe(own).alias("kept"))
