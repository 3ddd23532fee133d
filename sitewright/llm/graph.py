"""Connected components, and links within groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, joined, save


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, as stars within each partition: node, root."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= SPILL:
                yield star(up, root)
                up.clear()
        yield star(up, root)

    def star(up, root) -> pa.RecordBatch:
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) from edges a, b. Each round, a node takes the least label
    of its neighbours, and then its label's label; a round is one shuffle of minima, combined before it, and
    lookups of labels, which are broadcast only while they are few. No node's neighbours are ever gathered."""
    stars = save(contracted(edges.where("a <> b")), "edges")
    both = save(stars.union(stars.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # the label's label
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = joined(labels, jump, ["label"], "left", FEW).select("node", F.coalesce("far", "label").alias("now"), "label")
        near = joined(both.withColumnRenamed("b", "node"), labels, ["node"], "inner", FEW).select(F.col("a").alias("node"), F.col("label").alias("now"), F.lit(None).cast("long").alias("label"))
        after = jumped.unionByName(near).groupBy("node").agg(F.min("now").alias("now"), F.max("label").alias("label"))
        after = save(after.select("node", F.col("now").alias("label"), (F.col("now") != F.col("label")).alias("changed")), "labels")
        drop(labels)
        labels = after.select("node", "label")
        if not after.where("changed").limit(1).count():
            drop(stars, both)
            return labels.withColumnRenamed("label", "component")


#: Rows of labels that are broadcast, at most; nodes that a task contracts at once.
FEW, SPILL = 300_000, 1_000_000


class Sets:
    """Union-find over the rows of one group; a set's name is its first row."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, i: int, others: np.ndarray) -> None:
        names = np.unique(np.append(self.of[others], self.of[i]))
        if len(names) > 1:
            self.of[np.isin(self.of, names[1:])] = names[0]


#: For rows of one group and which of them lead: the pairs of rows that are linked, or enough of them that the
#: same rows hang together.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, of batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != held[-1].column(k)[-1].as_py()
        at = np.flatnonzero(change)
        if not len(at):
            held.append(batch)
            continue
        if at[-1]:
            held.append(batch.slice(0, int(at[-1])))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(int(at[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def sized(members: DataFrame, limit: int) -> DataFrame:
    """gid, lead (the smallest doc) and chunks of each group of several docs."""
    size = members.groupBy("gid").agg(F.count("*").alias("n"), F.min("doc").alias("lead")).where("n > 1")
    return size.select("gid", "lead", F.ceil(F.col("n") / limit).cast("int").alias("chunks"))


def link_groups(rows: DataFrame, groups: DataFrame, kernel_of: Callable[[], Callable], limit: int, parts: int | None = None) -> DataFrame:
    """Edges a, b between the docs of each group (rows: gid, lead, chunks, doc and what the kernel reads;
    groups: as `sized` makes them), such that docs which the kernel links, directly or through others, are
    connected.

    A task takes at most about ``limit`` docs of a group. A larger group is dealt into chunks by hash, and its
    smallest doc goes to each of them. Docs that the first pass leaves apart from that doc's component are
    then compared with all docs of the group, chunk by chunk: exact, and linear in the group while few of its
    docs are apart."""
    some = bool(groups.where("chunks > 1").limit(1).count())
    rows = save(rows, "group-rows") if some else rows
    deal = F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int")
    lead = (F.col("doc") == F.col("lead")) & (F.col("chunks") > 1)
    chunk = F.explode(F.when(lead, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(deal))) if some else F.lit(0)
    first = rows.withColumns({"chunk": chunk, "other": F.lit(0), "heads": F.lit(True)})
    out = save(_linked(first, kernel_of, parts), "group-links")
    if not some:
        return out
    large = rows.where("chunks > 1")
    comp = components(out)
    leads = groups.where("chunks > 1").join(comp.select(F.col("node").alias("lead"), F.col("component").alias("of")), "lead", "left")
    apart = large.join(comp.withColumnRenamed("node", "doc"), "doc", "left").join(leads.select("gid", F.coalesce("of", "lead").alias("of")), "gid")
    apart = save(apart.where(F.coalesce("component", "doc") != F.col("of")).drop("component", "of"), "group-apart")
    few = apart.groupBy("gid").agg(F.ceil(F.count("*") / limit).cast("int").alias("others"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    heads = apart.join(few, "gid").withColumns({"other": F.pmod(F.xxhash64("doc"), F.col("others")).cast("int"), "chunk": span("chunks"), "heads": F.lit(True)})
    rest = large.join(few, "gid").withColumns({"chunk": deal, "other": span("others"), "heads": F.lit(False)})
    return out.union(_linked(heads.unionByName(rest).drop("others"), kernel_of, parts))


def _linked(rows: DataFrame, kernel_of, parts: int | None) -> DataFrame:
    keys = ["gid", "chunk", "other"]
    dealt = rows.drop("lead", "chunks")
    dealt = (dealt.repartition(parts, *keys) if parts else dealt.repartition(*keys)).sortWithinPartitions(*keys, F.desc("heads"), "doc")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = kernel_of()
        for t in runs(batches, keys):
            cut = np.zeros(t.num_rows, bool)
            cut[0] = True
            for k in keys:
                v = t.column(k).to_numpy()
                cut[1:] |= v[1:] != v[:-1]
            a, b = kernel(t, np.append(np.flatnonzero(cut), t.num_rows))
            doc = t.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b])], ["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")
