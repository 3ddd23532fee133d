"""One query for each operator family over the projected tables, and SQL that another engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries
from .functions import bases
from .functions.cigar import blocks
from .operators import calling, intervals, pileup, reads, samples
from .params import CallParams
from .plans import projection as P
from .plans.call_targets import call_targets as call
from .sinks.fasta import index_rows

MAPQ, BASEQ, CAP, CHUNK = 20, 20, 2, 512

READ_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _keyed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.col(f"ord.{k}").alias(k) for k in READ_KEYS], *more)


def _retained(spark, sf):
    return reads.retained(P.alignments(spark, sf), _targets(spark, sf), P.read_groups(spark, sf), P.samples(spark, sf), MAPQ)


def _targets(spark, sf):
    return intervals.union(P.raw_targets(spark, sf))


def _observations(spark, sf):
    return reads.observations(reads.clipped(reads.aligned_blocks(_retained(spark, sf)), _targets(spark, sf)), BASEQ)


def _merged(spark, sf):
    return pileup.merged(pileup.capped_counts(_observations(spark, sf), CAP), CAP)


def _with_ref(spark, sf, keep=False):
    return calling.reference_bases(calling.site_totals(_merged(spark, sf), keep), P.reference(spark, sf, CHUNK), P.contigs(spark, sf), CHUNK)


def flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(reads.usable(P.alignments(spark, sf)), "flag")


def mapq_filter(spark, sf):
    return _keyed(P.alignments(spark, sf).where(reads.mapq_pass(MAPQ)), "mapq")


def target_contig_semi(spark, sf):
    return _keyed(reads.on_target_contigs(P.alignments(spark, sf), _targets(spark, sf)), "ref_id")


def rg_sample_join(spark, sf):
    return _keyed(reads.with_sample(P.alignments(spark, sf), P.read_groups(spark, sf), P.samples(spark, sf)), "rg", "sample_idx")


def unresolved_rg_anti(spark, sf):
    return _keyed(reads.without_sample(P.alignments(spark, sf), P.read_groups(spark, sf)), "rg")


def scan_metrics(spark, sf):
    return reads.scan_metrics(P.alignments(spark, sf), _targets(spark, sf), P.read_groups(spark, sf), MAPQ)


def interval_union(spark, sf):
    return _targets(spark, sf)


def point_in_targets(spark, sf):
    points = P.alignments(spark, sf).select("ref_id", (F.col("pos") - 1).alias("pos0")).distinct()
    return intervals.inside(points, _targets(spark, sf))


def cigar_blocks(spark, sf):
    b = P.alignments(spark, sf).withColumn("b", F.explode(blocks(F.col("cigar"))))
    return b.groupBy("cigar", F.col("b.r").alias("r"), F.col("b.q").alias("q"), F.col("b.len").alias("len")).agg(F.count("*").alias("n"))


def pileup_observations(spark, sf):
    return _keyed(_observations(spark, sf), "file_idx", "sample_idx", "ref_id", "pos", "base")


def pileup_counts(spark, sf):
    return pileup.counts(_observations(spark, sf))


def depth_cap_first_n(spark, sf):
    return pileup.capped_counts(_observations(spark, sf), CAP)


def capped_merge(spark, sf):
    return _merged(spark, sf)


def site_totals(spark, sf):
    return calling.site_totals(_merged(spark, sf)).withColumn("dp", bases.depth())


def reference_base_join(spark, sf):
    return _with_ref(spark, sf).select("ref_id", "chrom", "pos", "ref")


def choose_alt(spark, sf):
    return calling.with_alt(_with_ref(spark, sf)).select("chrom", "pos", "ref", "alt", "alt_count", "dp")


def alt_fraction_filter(spark, sf):
    return calling.fraction_pass(calling.with_alt(_with_ref(spark, sf), 2), 0.5).select("chrom", "pos", "ref", "alt", "alt_count", "dp", "alt_fraction")


def _called(spark, sf):
    return calling.dense_calls(calling.with_alt(_with_ref(spark, sf, keep=True)), P.samples(spark, sf).count())


def genotypes(spark, sf):
    s = _called(spark, sf).select("chrom", "pos", F.posexplode("samples").alias("sample_idx", "s")).where("s.dp > 0")
    return s.select("chrom", "pos", "sample_idx", "s.gt", "s.dp", "s.ad_ref", "s.ad_alt")


def dense_sample_calls(spark, sf):
    s = _called(spark, sf).select("chrom", "pos", F.posexplode("samples").alias("sample_idx", "s"))
    return s.select("chrom", "pos", "sample_idx", F.concat("s.gt", F.lit(":"), "s.dp", F.lit(":"), "s.ad_ref", F.lit(","), "s.ad_alt").alias("call"))


def vcf_lines(spark, sf):
    return calling.vcf_line(_called(spark, sf)).select("line")


def fai_layout(spark, sf):
    """The index of the region names as a sequence file sorted by name, each sequence as long as its key says."""
    n = P.contigs(spark, sf).select("name", (F.col("ref_id") * 37).cast("long").alias("length"))
    return index_rows(n)


def sample_index(spark, sf):
    return P.samples(spark, sf)


def rg_conflicts(spark, sf):
    by_key = P.read_groups(spark, sf).withColumn("rg", (F.col("rg").cast("int") % 7).cast("string"))
    return samples.conflicts(by_key)


def call_targets(spark, sf):
    """The flagship: the whole call, each sample's genotype among its columns as text."""
    v = call(P.alignments(spark, sf), _targets(spark, sf), P.read_groups(spark, sf), P.samples(spark, sf), P.contigs(spark, sf), P.reference(spark, sf, CHUNK), CallParams(max_depth=CAP), chunk=CHUNK)
    each = F.transform("samples", lambda s: F.concat(s["gt"], F.lit(":"), s["dp"], F.lit(":"), s["ad_ref"], F.lit(","), s["ad_alt"]))
    return v.select("ref_id", "chrom", "pos", "ref", "alt", "alt_count", "dp", "alt_fraction", F.array_join(each, "\t").alias("calls"))


def call_targets_deep(spark, sf):
    """The same with the usual depth cap, which few groups reach."""
    v = call(P.alignments(spark, sf), _targets(spark, sf), P.read_groups(spark, sf), P.samples(spark, sf), P.contigs(spark, sf), P.reference(spark, sf, CHUNK), chunk=CHUNK)
    return v.select("ref_id", "chrom", "pos", "ref", "alt", "alt_count", "dp", "alt_fraction")


QUERIES = {
    f.__name__: f
    for f in (
        flag_filter, mapq_filter, target_contig_semi, rg_sample_join, unresolved_rg_anti, scan_metrics, interval_union, point_in_targets, cigar_blocks,
        pileup_observations, pileup_counts, depth_cap_first_n, capped_merge, site_totals, reference_base_join, choose_alt, alt_fraction_filter, genotypes,
        dense_sample_calls, vcf_lines, fai_layout, sample_index, rg_conflicts, call_targets, call_targets_deep,
    )
} | file_queries.QUERIES

_PARTS = {
    "reads": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS file_idx,
               CAST(l_partkey % 5 AS INT) AS ref_id, 1 + (l_orderkey * 7 + l_linenumber * 13) % 2000 AS pos,
               CASE l_linenumber WHEN 7 THEN 1024 WHEN 6 THEN 256 ELSE 16 END AS flag, CAST(l_quantity AS INT) AS mapq,
               CAST(l_suppkey AS VARCHAR) AS rg
        FROM lineitem""",
    "rgs": """
        SELECT CAST(s_suppkey AS VARCHAR) AS rg, CASE WHEN n_nationkey <> 0 THEN n_name END AS sample
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "samples": """
        SELECT sample, CAST(row_number() OVER (ORDER BY sample) - 1 AS INT) AS sample_idx
        FROM (SELECT DISTINCT sample FROM rgs WHERE sample IS NOT NULL)""",
    "points": """
        SELECT DISTINCT ref_id, p FROM (
            SELECT CAST(p_partkey % 4 AS INT) AS ref_id, unnest(range(start, start + p_partkey % 17 - 4)) AS p
            FROM (SELECT p_partkey, (p_partkey * 131) % 2000 - (p_partkey * 131) % 2000 % 200 + p_size % 20 AS start FROM part))""",
    "targets": """
        SELECT ref_id, min(p) AS "start", max(p) + 1 AS "end"
        FROM (SELECT ref_id, p, p - row_number() OVER (PARTITION BY ref_id ORDER BY p) AS island FROM points) GROUP BY ref_id, island""",
    "kept": """
        SELECT reads.*, sample_idx FROM reads JOIN rgs USING (rg) JOIN samples USING (sample)
        WHERE flag & 3844 = 0 AND mapq >= 20 AND ref_id IN (SELECT ref_id FROM points)""",
    "runs": """
        SELECT * FROM (VALUES (0, 0, 0, 12), (1, 0, 3, 9), (2, 0, 0, 4), (2, 4, 5, 7), (3, 0, 0, 4), (3, 6, 4, 8), (4, 0, 0, 5), (4, 55, 5, 7),
                              (5, 0, 0, 6), (5, 6, 6, 1), (5, 7, 7, 5)) AS t(kind, r, q, len)""",
    "steps": """
        SELECT kept.*, pos + r + k AS site, q + k AS i
        FROM kept JOIN (SELECT kind, r, q, unnest(range(len)) AS k FROM runs) ON l_linenumber % 6 = kind""",
    "seen": """
        SELECT s.* EXCLUDE (site, i), site, (l_suppkey * 3 + i * 7 + l_partkey) % 41 AS quality,
               CASE WHEN (l_partkey + 3 * i) % 11 = 0 THEN substr('TGCA', CAST(1 + l_partkey % 4 AS INT), 1)
                    ELSE substr('ACGTACGTACGTACGTACGTACN', CAST(1 + ((s.pos + i) * (s.pos + i) * 31 + (s.pos + i) * 17 + s.ref_id * 7) % 23 AS INT), 1) END AS base
        FROM steps s JOIN points ON s.ref_id = points.ref_id AND s.site - 1 = points.p""",
    "obs": "SELECT * FROM seen WHERE quality >= 20 AND base <> 'N'",
    "first": """
        SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY ref_id, site, sample_idx, file_idx
                                                     ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) <= 2""",
    "perfile": """
        SELECT ref_id, site AS pos, sample_idx, file_idx, count(*) FILTER (base = 'A') AS nA, count(*) FILTER (base = 'C') AS nC,
               count(*) FILTER (base = 'G') AS nG, count(*) FILTER (base = 'T') AS nT
        FROM first GROUP BY ref_id, site, sample_idx, file_idx""",
    "long4": """
        SELECT ref_id, pos, sample_idx, file_idx, unnest([0, 1, 2, 3]) AS b, unnest([nA, nC, nG, nT]) AS n, nA + nC + nG + nT AS st,
               least(nA + nC + nG + nT, greatest(2 - coalesce(before, 0), 0)) AS space
        FROM (SELECT *, sum(nA + nC + nG + nT) OVER (PARTITION BY ref_id, pos, sample_idx ORDER BY file_idx
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM perfile)""",
    "shared": """
        SELECT *, n * space // st AS part, row_number() OVER (PARTITION BY ref_id, pos, sample_idx, file_idx ORDER BY (n * space) % st DESC, b) AS rank,
               space - sum(n * space // st) OVER (PARTITION BY ref_id, pos, sample_idx, file_idx) AS extra FROM long4""",
    "merged": """
        SELECT ref_id, pos, sample_idx, CAST(sum(v) FILTER (b = 0) AS BIGINT) AS nA, CAST(sum(v) FILTER (b = 1) AS BIGINT) AS nC,
               CAST(sum(v) FILTER (b = 2) AS BIGINT) AS nG, CAST(sum(v) FILTER (b = 3) AS BIGINT) AS nT
        FROM (SELECT *, part + CASE WHEN rank <= extra THEN 1 ELSE 0 END AS v FROM shared) GROUP BY ref_id, pos, sample_idx""",
    "sites": """
        SELECT ref_id, pos, CAST(sum(nA) AS BIGINT) AS nA, CAST(sum(nC) AS BIGINT) AS nC, CAST(sum(nG) AS BIGINT) AS nG, CAST(sum(nT) AS BIGINT) AS nT,
               CAST(sum(nA + nC + nG + nT) AS BIGINT) AS dp FROM merged GROUP BY ref_id, pos""",
    "based": """
        SELECT sites.*, r_name AS chrom, substr('ACGTACGTACGTACGTACGTACN', CAST(1 + (pos * pos * 31 + pos * 17 + ref_id * 7) % 23 AS INT), 1) AS ref
        FROM sites JOIN region ON r_regionkey = ref_id""",
    "options": """
        SELECT ref_id, pos, unnest(['A', 'C', 'G', 'T']) AS base, unnest([nA, nC, nG, nT]) AS n FROM based WHERE ref <> 'N'""",
    "best": """
        SELECT b.ref_id, chrom, b.pos, ref, o.base AS alt, o.n AS alt_count, dp, o.n / dp AS alt_fraction
        FROM based b JOIN options o ON b.ref_id = o.ref_id AND b.pos = o.pos AND o.base <> b.ref WHERE o.n > 0
        QUALIFY row_number() OVER (PARTITION BY b.ref_id, b.pos ORDER BY o.n DESC, o.base) = 1""",
    "dense": """
        SELECT b.ref_id, chrom, b.pos, ref, alt, alt_count, b.dp AS total, alt_fraction, s.sample_idx,
               coalesce(nA + nC + nG + nT, 0) AS dp,
               coalesce(CASE ref WHEN 'A' THEN nA WHEN 'C' THEN nC WHEN 'G' THEN nG ELSE nT END, 0) AS ad_ref,
               coalesce(CASE alt WHEN 'A' THEN nA WHEN 'C' THEN nC WHEN 'G' THEN nG ELSE nT END, 0) AS ad_alt
        FROM best b CROSS JOIN samples s LEFT JOIN merged m ON m.ref_id = b.ref_id AND m.pos = b.pos AND m.sample_idx = s.sample_idx""",
    "calls": """
        SELECT *, CASE WHEN dp = 0 THEN './.' WHEN ad_alt = 0 THEN '0/0' WHEN ad_ref = 0 THEN '1/1' ELSE '0/1' END AS gt FROM dense""",
}


def _sql(select: str, **other: str) -> str:
    parts = {**_PARTS, **other}
    return "WITH " + ",".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + select


_KEYS = ", ".join(READ_KEYS)
_DEEP = _PARTS["first"].replace("<= 2", "<= 100000"), _PARTS["long4"].replace("greatest(2 -", "greatest(100000 -")
_CALL = "gt || ':' || dp || ':' || ad_ref || ',' || ad_alt"

ORACLES = {
    "flag_filter": _sql(f"SELECT {_KEYS}, flag FROM reads WHERE flag & 3844 = 0"),
    "mapq_filter": _sql(f"SELECT {_KEYS}, mapq FROM reads WHERE mapq >= 20"),
    "target_contig_semi": _sql(f"SELECT {_KEYS}, ref_id FROM reads WHERE ref_id IN (SELECT ref_id FROM points)"),
    "rg_sample_join": _sql(f"SELECT {_KEYS}, rg, sample_idx FROM reads JOIN rgs USING (rg) JOIN samples USING (sample)"),
    "unresolved_rg_anti": _sql(f"SELECT {_KEYS}, rg FROM reads WHERE rg NOT IN (SELECT rg FROM rgs WHERE sample IS NOT NULL)"),
    "scan_metrics": _sql("""
        SELECT file_idx, count(*) AS seen, count(*) FILTER (flag & 3844 <> 0) AS skipped_flags,
               count(*) FILTER (flag & 3844 = 0 AND hit AND NOT known) AS skipped_rg,
               count(*) FILTER (flag & 3844 = 0 AND hit AND known AND mapq >= 20) AS retained
        FROM (SELECT *, ref_id IN (SELECT ref_id FROM points) AS hit, rg IN (SELECT rg FROM rgs WHERE sample IS NOT NULL) AS known FROM reads) GROUP BY file_idx"""),
    "interval_union": _sql("SELECT * FROM targets"),
    "point_in_targets": _sql("SELECT DISTINCT reads.ref_id, pos - 1 AS pos0 FROM reads JOIN points ON reads.ref_id = points.ref_id AND pos - 1 = p"),
    "cigar_blocks": _sql("""
        SELECT cigar, CAST(r AS BIGINT) AS r, CAST(q AS BIGINT) AS q, CAST(len AS BIGINT) AS len, count(*) AS n
        FROM reads JOIN runs ON l_linenumber % 6 = kind JOIN (VALUES (0, '12M'), (1, '3S9M'), (2, '4M1I7M'), (3, '4M2D8M'), (4, '5M50N7M'), (5, '2H6=1X5M')) AS c(k, cigar) ON k = kind
        GROUP BY ALL"""),
    "pileup_observations": _sql(f"SELECT {_KEYS}, file_idx, sample_idx, ref_id, site AS pos, base FROM obs"),
    "pileup_counts": _sql("SELECT * FROM perfile", first="SELECT * FROM obs"),
    "depth_cap_first_n": _sql("SELECT * FROM perfile"),
    "capped_merge": _sql("SELECT * FROM merged"),
    "site_totals": _sql("SELECT * FROM sites"),
    "reference_base_join": _sql("SELECT ref_id, chrom, pos, ref FROM based"),
    "choose_alt": _sql("SELECT chrom, pos, ref, alt, alt_count, dp FROM best"),
    "alt_fraction_filter": _sql("SELECT chrom, pos, ref, alt, alt_count, dp, alt_fraction FROM best WHERE alt_count >= 2 AND alt_fraction >= 0.5"),
    "genotypes": _sql("SELECT chrom, pos, sample_idx, gt, dp, ad_ref, ad_alt FROM calls WHERE dp > 0"),
    "dense_sample_calls": _sql(f"SELECT chrom, pos, sample_idx, {_CALL} AS call FROM calls"),
    "vcf_lines": _sql(f"""
        SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || total || chr(9) || 'GT:DP:AD'
               || chr(9) || string_agg({_CALL}, chr(9) ORDER BY sample_idx) AS line
        FROM calls GROUP BY chrom, pos, ref, alt, total"""),
    "fai_layout": """
        WITH n AS (SELECT r_name AS name, CAST(r_regionkey * 37 AS BIGINT) AS length FROM region),
        l AS (SELECT *, CASE WHEN length = 0 THEN 1 ELSE least(length, 60) END AS line_bases FROM n),
        s AS (SELECT *, strlen(name) + 2 AS head, CASE WHEN length = 0 THEN 1 ELSE length + (length + line_bases - 1) // line_bases END AS body FROM l)
        SELECT name, length, CAST(coalesce(sum(head + body) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS BIGINT) AS "offset",
               CAST(line_bases AS BIGINT) AS line_bases, CAST(line_bases + 1 AS BIGINT) AS line_width FROM s""",
    "sample_index": _sql("SELECT * FROM samples"),
    "rg_conflicts": _sql("SELECT CAST(CAST(rg AS INT) % 7 AS VARCHAR) AS rg, count(DISTINCT sample) AS n_samples FROM rgs WHERE sample IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sample) > 1"),
    "call_targets": _sql(f"""
        SELECT ref_id, chrom, pos, ref, alt, alt_count, total AS dp, alt_fraction, string_agg({_CALL}, chr(9) ORDER BY sample_idx) AS calls
        FROM calls GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY ref_id, chrom, pos, ref, alt, alt_count, total, alt_fraction")),
    "call_targets_deep": _sql("SELECT ref_id, chrom, pos, ref, alt, alt_count, dp, alt_fraction FROM best", first=_DEEP[0], long4=_DEEP[1]),
} | file_queries.oracles(_sql, _CALL)
