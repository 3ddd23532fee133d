import random

import pytest
from pyspark.sql import functions as F

from models import fold, walk
from sitewright.functions import bases
from sitewright.functions.cigar import blocks
from sitewright.operators import calling, intervals, pileup, reads, samples
from sitewright.params import CallParams, fraction

COUNTS = "nA long, nC long, nG long, nT long"


@pytest.mark.parametrize("cigar,pos,sites", [("4M1I3M", 10, list(range(10, 17))), ("3S2M2D2M2H", 10, [10, 11, 14, 15]), ("2=1X2N1M", 10, [10, 11, 12, 15]), ("5M", 3, [3, 4, 5, 6, 7]), ("2P3M", 1, [1, 2, 3]), ("4I", 1, []), ("*", 1, [])])
def test_cigar(spark, cigar, pos, sites):
    got = spark.createDataFrame([(cigar,)], "c string").select(blocks(F.col("c")).alias("b")).first().b
    each = [(pos + b.r + k, b.q + k) for b in got for k in range(b.len)]
    assert [p for p, _ in each] == sites
    assert each == list(walk(cigar, pos))


def test_cigar_random(spark):
    rng = random.Random(1)
    made = ["".join(f"{rng.randint(1, 9)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 8))) for _ in range(200)]
    for r in spark.createDataFrame([(c,) for c in made], "c string").select("c", blocks(F.col("c")).alias("b")).collect():
        assert [(1 + b.r + k, b.q + k) for b in r.b for k in range(b.len)] == list(walk(r.c, 1))


def test_interval_union(spark):
    rng = random.Random(2)
    rows = [(r, s, s + rng.randint(-3, 30)) for r in range(40) for s in (rng.randint(0, 300) for _ in range(rng.randint(1, 25)))]
    got = {(r.ref_id, r.start, r.end) for r in intervals.union(spark.createDataFrame(rows, "ref_id int, start long, end long")).collect()}
    want = set()
    for r in {x[0] for x in rows}:
        last = None
        for s, e in sorted((s, e) for q, s, e in rows if q == r and e > s):
            if last and s <= last[1]:
                last[1] = max(last[1], e)
            else:
                if last:
                    want.add((r, *last))
                last = [s, e]
        if last:
            want.add((r, *last))
    assert got == want


@pytest.mark.parametrize("rows,want", [([(10, 20), (15, 30)], [(10, 30)]), ([(0, 10), (10, 20)], [(0, 20)]), ([(10, 10), (20, 30)], [(20, 30)])])
def test_interval_cases(spark, rows, want):
    got = intervals.union(spark.createDataFrame([(0, *r) for r in rows], "ref_id int, start long, end long"))
    assert [(r.start, r.end) for r in got.orderBy("start").collect()] == want


def test_inside(spark):
    t = spark.createDataFrame([(0, 10, 20), (0, 30, 40)], "ref_id int, start long, end long")
    p = spark.createDataFrame([(0, x) for x in (9, 10, 15, 20, 25, 35, 40)], "ref_id int, pos0 long")
    assert sorted(r.pos0 for r in intervals.inside(p, t).collect()) == [10, 15, 35]
    assert intervals.inside(p, t.where("false")).count() == 0


@pytest.mark.parametrize("dst,src,cap,want", [([10, 0, 0, 0], [0, 5, 5, 0], 30, [10, 5, 5, 0]), ([0, 0, 0, 0], [1, 1, 1, 1], 3, [1, 1, 1, 0]), ([30, 0, 0, 0], [0, 5, 5, 0], 30, [30, 0, 0, 0]), ([1, 0, 0, 0], [3, 3, 0, 0], 4, [3, 1, 0, 0]), ([5, 0, 0, 0], [3, 0, 0, 0], 1000, [8, 0, 0, 0])])
def test_merge_cases(spark, dst, src, cap, want):
    rows = spark.createDataFrame([(0, 1, 0, 0, *dst), (0, 1, 0, 1, *src)], f"ref_id int, pos long, sample_idx int, file_idx int, {COUNTS}")
    r = pileup.merged(rows, cap).first()
    assert [r.nA, r.nC, r.nG, r.nT] == want == fold(dst, src, cap)


def test_merge_random(spark):
    rng = random.Random(3)
    for cap in (0, 1, 3, 10, 50):
        rows, want = [], {}
        for p in range(150):
            total = [0] * 4
            for f in range(rng.randint(1, 5)):
                c = [rng.randint(0, 9) for _ in range(4)]
                s = sum(c)
                while s > cap and cap:  # a file is capped before the merge
                    c = fold([0] * 4, c, cap)
                    s = sum(c)
                rows.append((0, p, 0, f, *c))
                total = fold(total, c, cap)
            want[p] = total
        got = pileup.merged(spark.createDataFrame(rows, f"ref_id int, pos long, sample_idx int, file_idx int, {COUNTS}"), cap)
        assert {r.pos: [r.nA, r.nC, r.nG, r.nT] for r in got.collect()} == want


@pytest.mark.parametrize("cap", [3, 1500])
def test_depth_cap(spark, cap):
    rng = random.Random(4)
    rows = [(0, i, 0, 0, rng.randint(1, 3), rng.choice("ACGT")) for i in range(4000)]
    obs = spark.createDataFrame(rows, "file_idx int, ord long, sample_idx int, ref_id int, pos long, base string")
    for r in pileup.capped_counts(obs.repartition(3), cap).collect():
        first = [b for *_, p, b in rows if p == r.pos][:cap]
        assert [r.nA, r.nC, r.nG, r.nT] == [first.count(b) for b in "ACGT"]


@pytest.mark.parametrize("ref,counts,least,want", [("A", [10, 3, 1, 0], 1, ("C", 3)), ("A", [10, 2, 0, 0], 5, None), ("N", [0, 5, 0, 0], 1, None), ("A", [10, 0, 0, 0], 1, None), ("C", [5, 10, 1, 0], 1, ("A", 5)), ("A", [5, 2, 0, 2], 1, ("C", 2)), ("A", [10, 0, 0, 0], 0, None), ("G", [4, 0, 9, 4], 1, ("A", 4))])
def test_choose_alt(spark, ref, counts, least, want):
    rows = spark.createDataFrame([(ref, *counts)], f"ref string, {COUNTS}")
    got = calling.with_alt(rows, least).first()
    assert (got and (got.alt, got.alt_count)) == want


@pytest.mark.parametrize("counts,gt", [([0, 0, 0, 0], "./."), ([0, 0, 3, 0], "0/0"), ([4, 0, 0, 0], "0/0"), ([0, 2, 0, 0], "1/1"), ([1, 2, 0, 0], "0/1"), ([1, 2, 5, 0], "0/1")])
def test_genotype(spark, counts, gt):
    s = spark.createDataFrame([counts], COUNTS).select(F.struct("*").alias("s"))
    r = s.select(bases.sample_call(F.lit("A"), F.lit("C"), F.col("s")).alias("c")).first().c
    assert (r.gt, r.dp, r.ad_ref, r.ad_alt) == (gt, sum(counts), counts[0], counts[1])


def test_base_index(spark):
    got = spark.createDataFrame([(b,) for b in "ACGTacgtNn-X"], "b string").select(bases.base_index(F.col("b")).alias("i")).collect()
    assert [r.i for r in got] == [0, 1, 2, 3, 0, 1, 2, 3, None, None, None, None]
    assert spark.range(4).select(bases.index_base(F.col("id").cast("int")).alias("b")).collect()[2].b == "G"


def test_clip_once_by_bins(spark, monkeypatch):
    t = spark.createDataFrame([(0, 5, 40_000), (0, 50_000, 50_010)], "ref_id int, start long, end long")
    b = spark.createDataFrame([(0, 0, 60_000, 0)], "ref_id int, bs long, be long, q0 long")
    want = sorted((r.lo, r.hi) for r in reads.clipped(b, t).collect())
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", -1)
    assert sorted((r.lo, r.hi) for r in reads.clipped(b, t).collect()) == want == [(5, 40_000), (50_000, 50_010)]


def test_reference_bounds(spark):
    ref = calling.chunked(spark.createDataFrame([("c", "acgtnACG")], "name string, seq string"), 3)
    contigs = spark.createDataFrame([(0, "c", 8)], "ref_id int, name string, length long")
    sites = spark.createDataFrame([(0, p) for p in range(1, 9)], "ref_id int, pos long")
    assert [r.ref for r in calling.reference_bases(sites, ref, contigs, 3).orderBy("pos").collect()] == list("ACGTNACG")
    for p in (0, 9, 100):
        with pytest.raises(Exception, match="outside the reference"):
            calling.reference_bases(spark.createDataFrame([(0, p)], "ref_id int, pos long"), ref, contigs, 3).collect()


def test_samples(spark):
    rgs = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", None), ("1", "a")], "rg string, sample string")
    assert [(r.sample, r.sample_idx) for r in samples.sample_index(rgs).orderBy("sample").collect()] == [("a", 0), ("b", 1)]
    assert [(r.rg, r.n_samples) for r in samples.conflicts(rgs).collect()] == [("1", 2)]


def test_params():
    for bad in ({"min_mapq": 61}, {"min_baseq": -1}, {"min_alt_fraction": 1.5}, {"max_depth": -1}):
        with pytest.raises(ValueError):
            CallParams(**bad)
    with pytest.raises(ValueError):
        fraction("nan")
    assert fraction("1") == 1 and fraction("0") == 0
