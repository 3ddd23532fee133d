"""Queries that pass through files: the projected tables are written in the formats that a call reads and writes,
in the shared folder, and read back by the sources. With SQL for the same rows."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import bases
from .operators import intervals, pileup, reads
from .params import CallParams
from .plans import projection as P
from .plans.call_targets import call_targets, file_counts
from .shared import shared_folder
from .sinks import fasta as fasta_sink
from .sinks import index as ix
from .sinks.vcf import write_vcf
from .sources import bam, bgzf, fasta, text

CAP, CHUNK = 2, 512
#: Reads that a task writes to BAM. It is the first number while that makes no more than DEALT tasks, for which Spark's
#: shuffle holds no rows in memory; then tasks grow up to the second number, and their number grows after that.
FEW_READS, MANY_READS, DEALT = 1 << 16, 1 << 21, 200
# Bases as hexadecimal digits, qualities without their offset.
_CODES = str.maketrans({b: f"{i:x}" for i, b in enumerate(bam.SEQUENCE)})
_PLAIN = bytes((q - 33) % 256 for q in range(256))


def _folder(spark: SparkSession) -> str:
    """A new folder; sources and sinks of files need one that is mounted."""
    base = shared_folder(spark)
    scheme, _, rest = base.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"files need a folder that all executors mount, not {base}")
    path = f"{rest if not rest.startswith('//') else rest[2:]}/files-{uuid.uuid4().hex[:12]}"
    os.makedirs(path)
    return path


def _write(path: str, content: str) -> str:
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(content)
    return path


def _header(spark: SparkSession, sf: str) -> bytes:
    """The head of a BAM file: contigs in order, each read group with its sample if it has one."""
    groups = P.read_groups(spark, sf).orderBy(F.col("rg").cast("int")).collect()
    contigs = P.contigs(spark, sf).orderBy("ref_id").collect()
    lines = "@HD\tVN:1.6\n" + "".join(f"@RG\tID:{g.rg}" + (f"\tSM:{g.sample}" if g.sample else "") + "\n" for g in groups)
    out = b"BAM\1" + struct.pack("<i", len(lines)) + lines.encode() + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(c.name) + 1) + c.name.encode() + b"\0" + struct.pack("<i", c.length) for c in contigs)


@cache
def _operations(cigar: str) -> bytes:
    ops, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | bam.OPERATIONS.index(c))
            n = ""
    return struct.pack(f"<{len(ops)}I", *ops)


def _record(ref: int, pos: int, flag: int, mapq: int, rg: str, cigar: str, seq: str, qual: str) -> bytes:
    ops, n = _operations(cigar), len(seq)
    body = ops + bytes.fromhex((seq + "=" * (n % 2)).translate(_CODES)) + qual.encode().translate(_PLAIN) + b"RGZ" + rg.encode() + b"\0"
    return struct.pack("<iiiBBHHHiiii", 34 + len(body), ref, pos - 1, 2, mapq, 0, len(ops) // 4, flag, n, -1, -1, 0) + b"r\0" + body


def _tasks(reads_: int) -> int:
    return max(1, -(-reads_ // MANY_READS), min(DEALT, -(-reads_ // FEW_READS)))


def _parts(spark: SparkSession, sf: str, folder: str) -> list[Row]:
    """file_idx, number, path, n: files of BGZF blocks without a header, which hold the reads of an input in order
    when they are joined by number. Reads are sorted over all partitions, by the few columns that they are made
    from, so neither an input nor its reads' text goes through one task. Equal lines make equal records, so they
    may be dealt to many tasks in any order."""
    lines = P.lines(spark, sf)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, files = task.partitionId(), {}
        for batch in batches:
            for i, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i not in files:
                    fh = open(f"{folder}/{i}-{number}-{task.taskAttemptId()}", "wb")
                    files[i] = [fh, bgzf.Writer(fh), 0]
                files[i][1].write(_record(*fields))
                files[i][2] += 1
        for fh, out, _ in files.values():
            out.flush()
            fh.close()
        rows = [(i, number, fh.name, n) for i, (fh, _, n) in files.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("file_idx", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n", pa.int64())])
    dealt = lines.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(_tasks(lines.count()), "file_idx", *P.ORD, "copy").drop("copy")
    rows = P.reads_of(dealt.sortWithinPartitions("file_idx", *P.ORD)).select("file_idx", "ref_id", "pos", "flag", "mapq", "rg", "cigar", "seq", "qual")
    return rows.mapInArrow(write, "file_idx int, number int, path string, n long").collect()


def _bams(spark: SparkSession, sf: str) -> list[str]:
    """The projected reads as one BAM file for each input, also for one without reads, so that the order of paths
    is that of inputs. The driver joins compressed parts behind the header."""
    folder, head = _folder(spark), _header(spark, sf)
    stage = f"{folder}/parts"
    os.makedirs(stage)
    parts = sorted(_parts(spark, sf, stage), key=lambda p: p.number)
    for i in range(P.FILES):
        with open(f"{stage}/whole", "wb") as fh:
            first = bgzf.Writer(fh)
            first.write(head)
            first.flush()
            for part in parts:
                if part.file_idx == i:
                    with open(part.path, "rb") as own:
                        shutil.copyfileobj(own, fh, 1 << 20)
                    os.remove(part.path)
            fh.write(bgzf.EOF)
        os.replace(f"{stage}/whole", f"{folder}/{i}.bam")
    shutil.rmtree(stage, ignore_errors=True)
    return text.input_paths([folder])


def bam_records(spark, sf):
    found = bam.read_alignments(spark, _bams(spark, sf), 1 << 20)
    return found.groupBy("file_idx", "ref_id", "pos", "flag", "mapq", "rg", "cigar", "seq", "qual").agg(F.count("*").alias("n"))


def bam_skipped_early(spark, sf):
    """The reads that a call decodes, by contig: those of other flags or contigs are passed over in the file."""
    refs = [r.ref_id for r in intervals.union(P.raw_targets(spark, sf)).select("ref_id").distinct().collect()]
    found = bam.read_alignments(spark, _bams(spark, sf), 1 << 20, reads.SKIPPED_FLAGS, refs)
    return found.groupBy("file_idx", "ref_id").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def _one_header(spark, sf) -> bam.Header:
    path = f"{_folder(spark)}/head.bam"
    with open(path, "wb") as fh:
        out = bgzf.Writer(fh)
        out.write(_header(spark, sf))
        out.finish()
    return bam.reconciled([path, path])[1]


def bam_contigs(spark, sf):
    return bam.contigs(spark, _one_header(spark, sf))


def bam_read_groups(spark, sf):
    return bam.read_groups(spark, list(_one_header(spark, sf).read_groups))


def bam_samples(spark, sf):
    """Samples of headers, in byte order, and how many read groups each has."""
    names, groups = text.collect_samples([_one_header(spark, sf)])
    rows = bam.read_groups(spark, groups).groupBy("sample").agg(F.count("*").alias("n_groups"))
    return rows.join(spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample string, sample_idx int"), "sample")


def input_files(spark, sf):
    """BAM files in folders, the suffix in either case, each once, in the order of paths."""
    folder, some = _folder(spark), []
    for r in P._read(spark, sf, "nation").collect():
        os.makedirs(f"{folder}/{r.n_regionkey}", exist_ok=True)
        some.append(_write(f"{folder}/{r.n_regionkey}/{r.n_name}.{'BAM' if r.n_nationkey % 2 else 'bam'}", ""))
        _write(f"{folder}/{r.n_regionkey}/{r.n_name}.txt", "")
    found = text.input_paths([folder, *some[:5]])
    return spark.createDataFrame([(i, p[len(folder) + 1 :]) for i, p in enumerate(found)], "file_idx int, path string")


def input_list(spark, sf):
    names = [r.n_name for r in P._read(spark, sf, "nation").collect()]
    path = _write(f"{_folder(spark)}/list", "# files\n\n" + "".join(f"  {n}.bam \n" for n in [*names, *names[:3]]))
    return spark.createDataFrame(list(enumerate(text.input_paths(bamlist=path))), "file_idx int, path string")


def bed_targets(spark, sf):
    """The targets of a BED file with comments and further fields; empty intervals go."""
    path = f"{_folder(spark)}/bed"
    named = P.raw_targets(spark, sf).join(F.broadcast(P.contigs(spark, sf)), "ref_id")
    lines = named.select(F.concat_ws("\t", "name", F.col("start").cast("string"), F.greatest("end", F.lit(0)).cast("string"), F.lit("more")).alias("value"))
    lines.union(spark.createDataFrame([("# comment",), ("",)], "value string")).write.text(path)
    return text.read_targets(spark, path, P.contigs(spark, sf))


def group_map(spark, sf):
    """Samples in the order in which a map of read groups names them."""
    rows = P.read_groups(spark, sf).orderBy(F.col("rg").cast("int")).collect()
    path = _write(f"{_folder(spark)}/map", "# map\n\nlone\n" + "".join(f"{r.rg} \t {r.sample} more\n" for r in rows if r.sample))
    names, _ = text.collect_samples([], text.read_rg_map(path))
    return spark.createDataFrame(list(enumerate(names)), "sample_idx int, sample string")


def _reference(spark, sf) -> str:
    """The reference as a plain file in the order of contigs, with lines of 70 and no index. A name ends at a
    space, so names have none."""
    rows = P.reference(spark, sf, 1 << 20).join(F.broadcast(P.contigs(spark, sf).select("name", "ref_id")), "name").orderBy("ref_id").collect()
    return _write(f"{_folder(spark)}/ref.fa", "".join(f">{r.name.replace(' ', '_')} more\n" + "".join(r.seq[i : i + 70] + "\n" for i in range(0, len(r.seq), 70)) for r in rows))


def fasta_records(spark, sf):
    return fasta.read_reference(spark, _reference(spark, sf), CHUNK, 1024).select("name", "chunk_id", "seq")


def _prepared(spark, sf) -> str:
    return fasta_sink.prepare_reference(spark, _reference(spark, sf))


def fasta_sorted(spark, sf):
    """The lines of the prepared file: records by name, 60 bases a line."""
    lines = spark.read.text(_prepared(spark, sf))
    return lines.select(F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))


def fasta_index(spark, sf):
    rows = [(n, *x) for n, x in text.read_index(text.index_path(_prepared(spark, sf))).items()]
    return spark.createDataFrame(rows, "name string, length long, offset long, line_bases long, line_width long")


def fasta_random_access(spark, sf):
    """Of the prepared, blocked file only the chunks that targets touch, by both of its indexes."""
    names = [r.name.replace(" ", "_") for r in P.contigs(spark, sf).orderBy("ref_id").collect()]
    only = fasta.needed(intervals.union(P.raw_targets(spark, sf)), names, 60)
    return fasta.read_reference(spark, _prepared(spark, sf), 60, 240, only).select("name", "chunk_id", "seq")


def _call(spark, sf) -> DataFrame:
    targets = intervals.union(P.raw_targets(spark, sf))
    return call_targets(P.alignments(spark, sf), targets, P.read_groups(spark, sf), P.samples(spark, sf), P.contigs(spark, sf), P.reference(spark, sf, CHUNK), CallParams(max_depth=CAP), CHUNK)


def _vcf(spark, sf, kind: str) -> str:
    path = f"{_folder(spark)}/calls.vcf.gz"
    contigs = [(c.name, c.length) for c in P.contigs(spark, sf).orderBy("ref_id").collect()]
    names = [r.sample for r in P.samples(spark, sf).orderBy("sample_idx").collect()]
    write_vcf(_call(spark, sf), path, "ref.fa", contigs, names, kind)
    return path


def vcf_file(spark, sf):
    """The lines of the written file in their order, header and records."""
    lines = spark.read.text(_vcf(spark, sf, "csi"))
    return lines.select(F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))


def _indexed(spark, sf, kind: str) -> DataFrame:
    """The records that the index leads to: contig and bin of the index, position of the record."""
    path = _vcf(spark, sf, kind)
    with open(f"{path}.{kind}", "rb") as fh:
        held = ix.read(fh.read())
    with open(path, "rb") as fh:
        blocks = dict(bgzf.blocks(fh))
    out = []
    for name, bins in zip(held["names"], held["entries"], strict=True):
        for b, chunks in bins.items():
            for a, z in chunks:
                data = b"".join(d[: z & 0xFFFF] if o == z >> 16 else d for o, d in sorted(blocks.items()) if a >> 16 <= o <= z >> 16)[a & 0xFFFF :]
                out += [(name, b, *line.split("\t")[:2]) for line in data.decode().splitlines()]
    return spark.createDataFrame(out, "name string, bin int, chrom string, pos string").select("name", "bin", "chrom", F.col("pos").cast("long").alias("pos"))


def vcf_csi(spark, sf):
    return _indexed(spark, sf, "csi")


def vcf_tbi(spark, sf):
    return _indexed(spark, sf, "tbi")


def base_observations(spark, sf):
    targets = intervals.union(P.raw_targets(spark, sf))
    return pileup.base_observations(file_counts(P.alignments(spark, sf), targets, P.read_groups(spark, sf), P.samples(spark, sf), CallParams()))


def base_codes(spark, sf):
    """Each code as its base, and that base as a code again; codes beyond four have none."""
    base = bases.index_base(F.col("r_regionkey"))
    return P._read(spark, sf, "region").select(F.col("r_regionkey").alias("code"), base.alias("base"), bases.base_index(F.lower(base)).alias("again"))


def unsound_reads(spark, sf):
    """Aligned blocks where some reads have no contig, no start or qualities of another length."""
    key, line = F.col("ord.l_orderkey"), F.col("ord.l_linenumber")
    some = P.alignments(spark, sf).withColumns({
        "ref_id": F.when(key % 13 != 0, F.col("ref_id")), "pos": F.when((key + line) % 17 != 0, F.col("pos")), "qual": F.when((key + line) % 19 == 0, "II").otherwise(F.col("qual")),
    })
    return reads.aligned_blocks(reads.usable(some)).groupBy("ref_id", "bs", "be", "q0").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bam_records, bam_skipped_early, bam_contigs, bam_read_groups, bam_samples, input_files, input_list, bed_targets, group_map, fasta_records, fasta_sorted,
        fasta_index, fasta_random_access, vcf_file, vcf_csi, vcf_tbi, base_observations, base_codes, unsound_reads,
    )
}

_CYCLE = P.REFERENCE_CYCLE
_BASES = f"array_to_string([substr('{_CYCLE}', CAST(1 + (p * p * 31 + p * 17 + r_regionkey * 7) % 23 AS INT), 1) for p in range(first, last)], '')"


def oracles(sql, call: str) -> dict[str, str]:
    """sql: puts the common parts before a query; call: a sample's text in a record."""
    cigars = "CASE l_linenumber % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(P.CIGARS)) + " END"
    seq = f"""array_to_string([CASE WHEN (l_partkey + 3 * i) % 11 = 0 THEN substr('TGCA', CAST(1 + l_partkey % 4 AS INT), 1)
              ELSE substr('{_CYCLE}', CAST(1 + ((pos + i) * (pos + i) * 31 + (pos + i) * 17 + ref_id * 7) % 23 AS INT), 1) END for i in range(12)], '')"""
    qual = "array_to_string([chr(CAST((l_suppkey * 3 + i * 7 + l_partkey) % 41 + 33 AS INT)) for i in range(12)], '')"
    chunks = lambda size: f"""
        SELECT replace(r_name, ' ', '_') AS name, r_regionkey, c AS chunk_id, 1 + c * {size} AS first, least({P.LENGTH}, (c + 1) * {size}) + 1 AS last
        FROM region, (SELECT unnest(range({-(-P.LENGTH // size)})) AS c)"""  # noqa: E731
    names = "(SELECT string_agg(sample, chr(9) ORDER BY sample_idx) FROM samples)"
    record = f"""chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || total || chr(9) || 'GT:DP:AD'
                 || chr(9) || string_agg({call}, chr(9) ORDER BY sample_idx)"""
    head = f"""
        SELECT 0 AS part, 0 AS a, 0 AS b, '##fileformat=VCFv4.3' AS line UNION ALL SELECT 1, 0, 0, '##source=sitewright call-targets' UNION ALL SELECT 2, 0, 0, '##reference=ref.fa'
        UNION ALL SELECT 3, r_regionkey, 0, '##contig=<ID=' || r_name || ',length={P.LENGTH}>' FROM region
        UNION ALL SELECT 4, 0, 0, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">' UNION ALL SELECT 5, 0, 0, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'
        UNION ALL SELECT 6, 0, 0, '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">'
        UNION ALL SELECT 7, 0, 0, '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths for the ref and alt alleles">'
        UNION ALL SELECT 8, 0, 0, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', {names})
        UNION ALL SELECT 9, ref_id, pos, {record} FROM calls GROUP BY ref_id, chrom, pos, ref, alt, total"""
    indexed = sql("SELECT chrom AS name, CAST(4681 + ((pos - 1) >> 14) AS INT) AS bin, chrom, pos FROM best")
    lines = f"""SELECT row_number() OVER (ORDER BY name, kind, first) - 1 AS number, CASE kind WHEN 0 THEN '>' || name ELSE {_BASES} END AS line
                FROM (SELECT name, r_regionkey, 1 AS kind, first, last FROM ({chunks(60)}) UNION ALL SELECT replace(r_name, ' ', '_'), r_regionkey, 0, 0, 0 FROM region)"""
    return {
        "bam_records": sql(f"SELECT file_idx, ref_id, pos, flag, mapq, rg, {cigars} AS cigar, {seq} AS seq, {qual} AS qual, count(*) AS n FROM reads GROUP BY ALL"),
        "bam_skipped_early": sql("SELECT file_idx, ref_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM reads WHERE flag & 3844 = 0 AND ref_id IN (SELECT ref_id FROM points) GROUP BY ALL"),
        "bam_contigs": f"SELECT CAST(r_regionkey AS INT) AS ref_id, r_name AS name, CAST({P.LENGTH} AS BIGINT) AS length FROM region",
        "bam_read_groups": sql("SELECT * FROM rgs"),
        "bam_samples": sql("SELECT sample, n_groups, sample_idx FROM samples JOIN (SELECT sample, count(*) AS n_groups FROM rgs GROUP BY sample) USING (sample)"),
        "input_files": """
            SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS file_idx, path
            FROM (SELECT n_regionkey || '/' || n_name || CASE n_nationkey % 2 WHEN 1 THEN '.BAM' ELSE '.bam' END AS path FROM nation)""",
        "input_list": "SELECT CAST(row_number() OVER (ORDER BY n_name || '.bam') - 1 AS INT) AS file_idx, n_name || '.bam' AS path FROM nation",
        "bed_targets": """
            SELECT CAST(p_partkey % 4 AS INT) AS ref_id, start, start + p_partkey % 17 - 4 AS "end"
            FROM (SELECT p_partkey, (p_partkey * 131) % 2000 - (p_partkey * 131) % 2000 % 200 + p_size % 20 AS start FROM part) WHERE p_partkey % 17 > 4""",
        "group_map": sql("SELECT CAST(row_number() OVER (ORDER BY min(CAST(rg AS INT))) - 1 AS INT) AS sample_idx, sample FROM rgs WHERE sample IS NOT NULL GROUP BY sample"),
        "fasta_records": f"SELECT name, chunk_id, {_BASES} AS seq FROM ({chunks(CHUNK)})",
        "fasta_sorted": lines,
        "fasta_index": f"""
            SELECT replace(r_name, ' ', '_') AS name, CAST({P.LENGTH} AS BIGINT) AS length,
                   CAST(sum(strlen(r_name) + 2 + {P.LENGTH + P.LENGTH // 60}) OVER (ORDER BY replace(r_name, ' ', '_')) - {P.LENGTH + P.LENGTH // 60} AS BIGINT) AS "offset",
                   CAST(60 AS BIGINT) AS line_bases, CAST(61 AS BIGINT) AS line_width FROM region""",
        "fasta_random_access": sql(f"""
            SELECT name, chunk_id, {_BASES} AS seq FROM ({chunks(60)})
            WHERE (r_regionkey, chunk_id) IN (SELECT (ref_id, p // 60) FROM points)"""),
        "vcf_file": sql(f"SELECT row_number() OVER (ORDER BY part, a, b) - 1 AS number, line FROM ({head})"),
        "vcf_csi": indexed,
        "vcf_tbi": indexed,
        "base_observations": sql("SELECT file_idx, count(*) AS n FROM obs GROUP BY file_idx"),
        "base_codes": "SELECT r_regionkey AS code, ['A', 'C', 'G', 'T'][r_regionkey + 1] AS base, CASE WHEN r_regionkey < 4 THEN r_regionkey END AS again FROM region",
        "unsound_reads": sql("""
            SELECT ref_id, pos - 1 + r AS bs, pos - 1 + r + len AS be, CAST(q AS BIGINT) AS q0, count(*) AS n FROM reads JOIN runs ON l_linenumber % 6 = kind
            WHERE flag & 3844 = 0 AND l_orderkey % 13 <> 0 AND (l_orderkey + l_linenumber) % 17 <> 0 AND (l_orderkey + l_linenumber) % 19 <> 0 GROUP BY ALL"""),
    }
