import gzip
import io
import random
import struct

import pytest

from models import call, write_bam
from sitewright import cli
from sitewright.params import CallParams
from sitewright.plans.run import run
from sitewright.sinks import fasta as out_fasta
from sitewright.sinks import index as ix
from sitewright.sources import bam, bgzf, fasta, text

CONTIGS = [("chrB", 400), ("chrA", 300)]


def reads_of(rng, n, groups):
    out = []
    for _ in range(n):
        cigar, size = rng.choice([("30M", 30), ("5S25M", 30), ("10M2I18M", 30), ("12M4D18M", 30), ("8M20N22M", 30), ("3H30M", 30)])
        seq = "".join(rng.choice("ACGTACGTACGTN") for _ in range(size))
        qual = [rng.randint(0, 45) for _ in range(size)] if rng.random() < 0.97 else []
        out.append({"ref": rng.choice([0, 0, 1, None]), "pos": rng.randint(1, 240), "flag": rng.choice([0, 16, 0, 0, 4, 256, 512, 1024, 2048]), "mapq": rng.choice([None, 10, 20, 60, 60]), "rg": rng.choice([*groups, "none", None]), "cigar": cigar, "seq": seq, "qual": qual})
    return out


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("bams"), random.Random(5)
    groups = {"g1": "s2", "g2": "s1", "g3": None, "g4": "s2"}
    files = [reads_of(rng, 900, groups), reads_of(rng, 700, groups)]
    (folder / "sub").mkdir()
    paths = [str(folder / "a.bam"), str(folder / "sub" / "b.BAM")]
    for p, f in zip(paths, files):
        write_bam(p, CONTIGS, list(groups.items()), f)
    seqs = {n: "".join(rng.choice("ACGTacgtN") for _ in range(size)) for n, size in CONTIGS}
    ref = folder / "ref.fa"
    ref.write_text("".join(f">{n} words\n" + "\n".join(s[i : i + 50] for i in range(0, len(s), 50)) + "\n" for n, s in seqs.items()))
    bed = folder / "t.bed"
    bed.write_text("# comment\n\nchrB\t20\t120\tx\nchrB\t100\t180\nchrA\t30\t30\nchrX\t5\t5\nchrA\t40\t90\n")
    return {"folder": folder, "paths": paths, "files": files, "groups": groups, "seqs": seqs, "ref": str(ref), "bed": str(bed), "targets": [(0, 20, 180), (1, 40, 90)]}


def lines(path):
    with gzip.open(path, "rt") as fh:
        return fh.read().splitlines()


@pytest.mark.parametrize("split", [1 << 20, 3000, 800])
def test_bam_splits(spark, data, split):
    got = bam.read_alignments(spark, data["paths"], split).orderBy("file_idx", "ord").collect()
    want = [(i, r) for i, f in enumerate(data["files"]) for r in f]
    assert len(got) == len(want)
    for g, (i, r) in zip(got, want):
        assert (g.file_idx, g.ref_id, g.pos, g.flag, g.mapq, g.rg, g.cigar, g.seq) == (i, r["ref"], r["pos"], r["flag"], r["mapq"], r["rg"], r["cigar"], r["seq"])
        assert [ord(c) - 33 for c in g.qual] == r["qual"]


@pytest.mark.parametrize("split", [1500, 9000])
def test_records_longer_than_splits(spark, tmp_path, split):
    rng = random.Random(15)
    long = [{"ref": 0, "pos": 1 + i, "flag": 0, "mapq": 60, "rg": "g", "cigar": f"{n}M", "seq": "".join(rng.choice("ACGT") for _ in range(n)), "qual": [rng.randint(0, 40) for _ in range(n)]} for i, n in enumerate([6000, 20, 9000, 3000, 1, 7000])]
    write_bam(tmp_path / "long.bam", CONTIGS, [("g", "s")], long)
    got = bam.read_alignments(spark, [str(tmp_path / "long.bam")], split).orderBy("ord").collect()
    assert [(r.pos, r.seq) for r in got] == [(r["pos"], r["seq"]) for r in long]


def test_bam_header(data):
    h = bam.read_header(data["paths"][0])
    assert list(h.contigs) == CONTIGS and dict(h.read_groups) == data["groups"]


def test_call_end_to_end(spark, data):
    for index, cap, least, part in (("csi", 100_000, 1, 0.0), ("tbi", 3, 2, 0.4), ("csi", 0, 1, 0.0)):
        out = str(data["folder"] / "out" / f"{index}{cap}.vcf.gz")
        run(spark, data["ref"], data["bed"], out, inputs=[str(data["folder"])], index=index, params=CallParams(max_depth=cap, min_alt_count=least, min_alt_fraction=part), split=4000, metrics=True)
        got = lines(out)
        body = [x for x in got if x[0] != "#"]
        assert body == call(data["files"], data["targets"], data["groups"], ["s1", "s2"], data["seqs"], CONTIGS, cap=cap, least=least, part=part)
        assert got[0] == "##fileformat=VCFv4.3" and got[2] == f"##reference={data['ref']}" and got[3] == "##contig=<ID=chrB,length=400>"
        assert [x for x in got if x.startswith("#CHROM")][0].split("\t")[9:] == ["s1", "s2"]
        raw = open(out, "rb").read()
        assert raw.endswith(bgzf.EOF) and raw.count(bgzf.EOF) == 1
        held = ix.read(open(f"{out}.{index}", "rb").read())
        found = []
        blocks = {o: d for o, d in bgzf.blocks(io.BytesIO(raw))}
        starts = sorted(blocks)
        for bins in held["entries"]:
            for chunks in bins.values():
                for a, b in chunks:
                    piece = blocks[a >> 16][a & 0xFFFF : (b & 0xFFFF) if b >> 16 == a >> 16 else None]
                    for o in starts[starts.index(a >> 16) + 1 :]:
                        if o < b >> 16:
                            piece += blocks[o]
                        elif o == b >> 16:
                            piece += blocks[o][: b & 0xFFFF]
                    found += piece.decode().splitlines()
        assert sorted(found) == sorted(body)


def test_rg_map_and_cli(spark, data):
    folder = data["folder"]
    (folder / "rg.txt").write_text("# map\ng3 z\ng1   a extra\nlone\ng2 a\n")
    (folder / "list.txt").write_text("\n".join(["# list", "", *reversed(data["paths"])]) + "\n")
    out = str(folder / "cli.vcf.gz")
    args = ["--log-file", str(folder / "logs" / "log"), "-vv", "call-targets", "--bamlist", str(folder / "list.txt"), "-r", data["ref"], "-T", data["bed"], "-o", out, "--rg-map", str(folder / "rg.txt")]
    assert cli.main(args) == 0
    body = [x for x in lines(out) if x[0] != "#"]
    assert body == call(data["files"], data["targets"], {"g3": "z", "g1": "a", "g2": "a"}, ["z", "a"], data["seqs"], CONTIGS)
    assert "retained=" in (folder / "logs" / "log").read_text() and "base_obs=" in (folder / "logs" / "log").read_text()
    assert "stage=write_vcf" in (folder / "logs" / "log").read_text()
    assert cli.main([*args[:-1], str(folder / "missing")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["call-targets", "-i", "x", "--bamlist", "y", "-r", "r", "-T", "t", "-o", "o"])


def test_bad_rg_type(spark, data, tmp_path):
    bad = dict(data["files"][0][0], ref=0, pos=50, flag=0, rg_tag=b"RGi" + struct.pack("<i", 7))
    for read, fails in ((bad, True), (dict(bad, flag=4), False)):
        write_bam(tmp_path / "x.bam", CONTIGS, list(data["groups"].items()), [read])
        go = lambda: run(spark, data["ref"], data["bed"], str(tmp_path / "o.vcf.gz"), inputs=[str(tmp_path / "x.bam")])
        if fails:
            with pytest.raises(Exception, match="unexpected type"):
                go()
            assert not (tmp_path / "o.vcf.gz").exists()
        else:
            go()


def test_errors(spark, data, tmp_path):
    go = lambda **k: run(spark, k.pop("ref", data["ref"]), k.pop("bed", data["bed"]), str(tmp_path / "o.vcf.gz"), **({"inputs": data["paths"]} | k))
    with pytest.raises(FileNotFoundError):
        go(ref=str(tmp_path / "none.fa"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no input"):
        go(inputs=[str(tmp_path / "empty")])
    write_bam(tmp_path / "other.bam", CONTIGS[::-1], [("g1", "s")], [])
    with pytest.raises(ValueError, match="differ"):
        go(inputs=[*data["paths"], str(tmp_path / "other.bam")])
    for content, message in (("chrB\t1\n", "valid end"), ("chrB\tx\t5\n", "valid start"), ("chrX\t1\t5\n", "not in the header"), ("track x\n", "without a valid")):
        (tmp_path / "bad.bed").write_text(content)
        with pytest.raises(Exception, match=message):
            go(bed=str(tmp_path / "bad.bed"))
    (tmp_path / "none.bed").write_text("chrB\t5\t5\n")
    with pytest.raises(ValueError, match="no target"):
        go(bed=str(tmp_path / "none.bed"))
    (tmp_path / "rg").write_text("g1 a\ng1 b\n")
    with pytest.raises(ValueError, match="two samples"):
        go(rg_map=str(tmp_path / "rg"))
    (tmp_path / "rg").write_text("# none\n")
    with pytest.raises(ValueError, match="empty"):
        go(rg_map=str(tmp_path / "rg"))
    write_bam(tmp_path / "nosm.bam", CONTIGS, [("g1", None)], [])
    with pytest.raises(ValueError, match="no samples"):
        go(inputs=[str(tmp_path / "nosm.bam")])
    (tmp_path / "part.fa").write_text(">chrB\nACGT\n")
    with pytest.raises(ValueError, match="chrA"):
        go(ref=str(tmp_path / "part.fa"))
    (tmp_path / "short.fa").write_text(">chrB\nACGT\n>chrA\nACGT\n")
    with pytest.raises(Exception, match="outside the reference"):
        go(ref=str(tmp_path / "short.fa"))


@pytest.mark.parametrize("content,message", [(">\nAC\n", "empty header"), (">a\nA\n>a b\nC\n", "two sequences"), ("AC\n>a\n", "before any header"), ("\n", "no sequences")])
def test_bad_fasta(tmp_path, content, message):
    (tmp_path / "x.fa").write_text(content)
    with pytest.raises(ValueError, match=message):
        list(fasta.records(str(tmp_path / "x.fa")))


def test_fasta_export(spark, tmp_path):
    rng = random.Random(6)
    seqs = {"chr2": "TTAA", "chr10": "".join(rng.choice("ACGTacgt") for _ in range(70_000)), "chr1": "ACGT" * 30, "empty": ""}
    (tmp_path / "x.fasta.gz").write_bytes(gzip.compress("".join(f">{n}  more\n {s[:77]}\n{s[77:]}\n\n" for n, s in seqs.items()).encode()))
    path = out_fasta.prepare_reference(spark, str(tmp_path / "x.fasta.gz"))
    assert path == str(tmp_path / "x.sorted.fa.gz")
    got = lines(path)
    assert [x[1:] for x in got if x[0:1] == ">"] == sorted(seqs)
    assert {n: s for n, s in zip(sorted(seqs), "\n".join(got).replace("\n", " ").split(">")[1:])}.keys() == seqs.keys()
    plain = gzip.open(path, "rb").read()
    for n, (length, offset, width, size) in text.read_index(path + ".fai").items():
        assert length == len(seqs[n]) and (width, size) == ((1, 2) if not length else (min(60, length), min(60, length) + 1))
        assert b"".join(plain[offset : offset + length + length // width + 1].split(b">")[0].split()).decode() == seqs[n]
    count, *pairs = struct.unpack(f"<{(len(open(path + '.gzi', 'rb').read())) // 8}Q", open(path + ".gzi", "rb").read())
    offsets = [(o, d) for o, d in bgzf.blocks(open(path, "rb")) if d]
    passed = [sum(len(d) for _, d in offsets[:i]) for i in range(len(offsets))]
    assert list(zip(pairs[::2], pairs[1::2])) == list(zip([o for o, _ in offsets[1:]], passed[1:])) and count == len(offsets) - 1
    before = (tmp_path / "x.sorted.fa.gz").stat().st_mtime_ns
    assert out_fasta.prepare_reference(spark, str(tmp_path / "x.fasta.gz")) == path and (tmp_path / "x.sorted.fa.gz").stat().st_mtime_ns == before
    assert out_fasta.prepare_reference(spark, path) == path


def test_indexed_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1\nACGTA\nCGT\n>chr2\nTT\n")
    (tmp_path / "r.fa.fai").write_text("chr1\t8\t6\t5\t6\nshort\nchr2\t2\t22\t2\t3\n")
    assert out_fasta.prepare_reference(spark, str(tmp_path / "r.fa")) == str(tmp_path / "r.fa")
    rows = fasta.read_reference(spark, str(tmp_path / "r.fa"), 3).orderBy("name", "chunk_id").collect()
    assert [(r.name, r.chunk_id, r.seq) for r in rows] == [("chr1", 0, "ACG"), ("chr1", 1, "TAC"), ("chr1", 2, "GT"), ("chr2", 0, "TT")]


@pytest.mark.parametrize("name,want", [("a.fa.gz", "a"), ("a.fasta.gz", "a"), ("a.fna.gz", "a"), ("a.gz", "a"), ("a.fa", "a"), ("a.fasta", "a"), ("a.fna", "a"), ("a.txt", "a.txt")])
def test_prepared_path(name, want):
    assert out_fasta.prepared_path(f"/x/{name}") == f"/x/{want}.sorted.fa.gz"


def wrapped(seqs, width):
    return "".join(f">{n} more\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in seqs.items())


@pytest.mark.parametrize("width,span", [(50, 300), (7, 1000), (10**6, 300), (61, 1 << 24)])
def test_fasta_in_ranges(spark, tmp_path, monkeypatch, width, span):
    """Plain, indexed and blocked files give the same rows, whatever the ranges, and lines may be endless."""
    rng = random.Random(width)
    seqs = {f"c{i}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((5000, 0, 1, 299, 300, 301, 2000, 0, 64))}
    (tmp_path / "p.fa").write_text(wrapped(seqs, width))
    want = sorted((n, k, s[k * 100 : k * 100 + 100]) for n, s in seqs.items() for k in range(max(1, -(-len(s) // 100))))
    plain = fasta.FastaReader(str(tmp_path / "p.fa"), 100, span, None)
    monkeypatch.setattr(fasta, "BLOCK", 97)
    parts = plain.partitions()
    assert sorted(r for p in parts for r in plain.read(p)) == want and (len(parts) > 5) == (span < 5000)
    assert list(fasta.records(str(tmp_path / "p.fa"), 100)) == [(n, k, s[k * 100 : k * 100 + 100]) for n, s in seqs.items() for k in range(max(1, -(-len(s) // 100)))]
    monkeypatch.setattr(bgzf, "PAYLOAD", 256)
    path = str(tmp_path / "o.fa.gz")
    assert out_fasta.write_fasta(fasta.read_reference(spark, str(tmp_path / "p.fa"), 100, span), path, 100) == len(seqs)
    assert gzip.open(path, "rt").read() == "".join(f">{n}\n" + ("".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) or "\n") for n, s in sorted(seqs.items()))
    (tmp_path / "o.fa").write_bytes(gzip.open(path, "rb").read())
    (tmp_path / "o.fa.fai").write_bytes(open(path + ".fai", "rb").read())
    for p in (path, str(tmp_path / "o.fa")):
        reader = fasta.FastaReader(p, 100, span, None)
        assert sorted(r for x in reader.partitions() for r in reader.read(x)) == want and (len(reader.partitions()) > 5) == (span < 5000)
        some = fasta.FastaReader(p, 100, span, {"c0": [[3, 5], [49, 49]], "c7": [[0, 0]]})
        assert sorted(r for x in some.partitions() for r in some.read(x)) == [r for r in want if (r[0] == "c0" and r[1] in (3, 4, 5, 49)) or r[0] == "c7"]


def test_long_line(tmp_path):
    import time

    (tmp_path / "l.fa").write_bytes(b">a\n" + b"ACGTN" * 4_000_000)
    began = time.monotonic()
    assert sum(len(s) for _, _, s in fasta.records(str(tmp_path / "l.fa"))) == 20_000_000 and time.monotonic() - began < 2


def test_bam_read_in_part(spark, data):
    """Reads that the source passes over, and columns that it does not decode, change nothing else."""
    every = bam.read_alignments(spark, data["paths"], 3000)
    some = bam.read_alignments(spark, data["paths"], 3000, 0xF04, [1])
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.where("ref_id = 1 AND (flag & 3844) = 0").collect())) and some.count() > 50
    assert bam.read_alignments(spark, data["paths"], refs=[]).count() == 0
    light = bam.read_alignments(spark, data["paths"], 3000, bases=False)
    key = ["file_idx", "ord", "ref_id", "pos", "flag", "mapq", "rg"]
    assert sorted(map(repr, light.select(*key).collect())) == sorted(map(repr, every.select(*key).collect())) and light.where("seq IS NOT NULL OR qual IS NOT NULL OR cigar IS NOT NULL").count() == 0


def test_linked_folders(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bam").write_bytes(b"")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "y.BAM").write_bytes(b"")
    (tmp_path / "a" / "other").symlink_to(tmp_path / "b")
    assert {p.rsplit("/", 1)[1] for p in text.input_paths([str(tmp_path)])} == {"x.bam", "y.BAM"}
