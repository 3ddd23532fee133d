"""Plain models of what the engine computes, and bytes of BAM files for tests."""

import re
import struct
from collections import Counter, defaultdict

from sitewright.sources import bgzf

BASES = "ACGT"


def walk(cigar, pos):
    """(reference position, read index) of each aligned base."""
    i = 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            yield from ((pos + k, i + k) for k in range(n))
        pos += n if op in "M=XDN" else 0
        i += n if op in "M=XIS" else 0


def fold(dst, src, cap):
    """Add counts of one more file up to a cap, by largest remainders."""
    room = min(max(cap - sum(dst), 0), sum(src))
    if not room:
        return list(dst)
    exact = [n * room for n in src]
    add = [e // sum(src) for e in exact]
    order = sorted(range(4), key=lambda b: (-(exact[b] % sum(src)), b))
    for b in order[: room - sum(add)]:
        add[b] += 1
    return [d + a for d, a in zip(dst, add)]


def call(files, targets, groups, samples, reference, contigs, mapq=20, baseq=20, cap=100_000, least=1, part=0.0):
    """VCF body lines. files: lists of dicts with ref, pos, flag, mapq, rg, cigar, seq, qual."""
    inside = defaultdict(set)
    for r, a, b in targets:
        inside[r].update(range(a, b))
    total = defaultdict(lambda: [[0] * 4 for _ in samples])
    for reads in files:
        own = defaultdict(lambda: [0] * 4)
        for r in reads:
            if r["flag"] & (4 | 256 | 512 | 1024 | 2048) or r["ref"] is None or r["ref"] not in inside or groups.get(r["rg"]) is None or (r["mapq"] or 0) < mapq:
                continue
            if r["pos"] is None or len(r["seq"]) != len(r["qual"]):
                continue
            for p, i in walk(r["cigar"], r["pos"]):
                if p - 1 in inside[r["ref"]] and i < len(r["seq"]) and r["qual"][i] >= baseq and r["seq"][i].upper() in BASES:
                    c = own[r["ref"], p, samples.index(groups[r["rg"]])]
                    if sum(c) < cap:
                        c[BASES.index(r["seq"][i].upper())] += 1
        for (ref, p, s), c in own.items():
            total[ref, p][s] = fold(total[ref, p][s], c, cap)
    out = []
    for (ref, p), per in sorted(total.items()):
        base = reference[contigs[ref][0]][p - 1].upper()
        sums = Counter({b: sum(c[k] for c in per) for k, b in enumerate(BASES)})
        if base not in BASES:
            continue
        alt = max((b for b in BASES if b != base), key=lambda b: (sums[b], -BASES.index(b)))
        dp = sum(sums.values())
        if sums[alt] < max(1, least) or sums[alt] / dp < part:
            continue
        cells = []
        for c in per:
            r, a, d = c[BASES.index(base)], c[BASES.index(alt)], sum(c)
            cells.append(f"{'./.' if not d else '0/0' if not a else '1/1' if not r else '0/1'}:{d}:{r},{a}")
        out.append("\t".join([contigs[ref][0], str(p), ".", base, alt, ".", "PASS", f"DP={dp}", "GT:DP:AD", *cells]))
    return out


def bam_record(r, name=b"read"):
    ops = [(int(n), "MIDNSHP=X".index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
    codes = "=ACMGRSVTWYHKDBN"
    seq = [codes.index(b) for b in r["seq"]] + [0] * (len(r["seq"]) % 2)
    body = struct.pack("<iiBBHHHiiii", -1 if r["ref"] is None else r["ref"], (r["pos"] or 0) - 1, len(name) + 1, 255 if r["mapq"] is None else r["mapq"], 0, len(ops), r["flag"], len(r["seq"]), -1, -1, 0)
    body += name + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(seq[i] << 4 | seq[i + 1] for i in range(0, len(seq), 2))
    body += bytes(r["qual"]) if len(r["qual"]) == len(r["seq"]) else b"\xff" * len(r["seq"])
    body += b"NMi" + struct.pack("<i", 1)
    if r.get("rg_tag"):
        body += r["rg_tag"]
    elif r["rg"] is not None:
        body += b"RGZ" + r["rg"].encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def write_bam(path, contigs, groups, reads, block=700):
    text = "@HD\tVN:1.6\n" + "".join(f"@RG\tID:{g}" + (f"\tSM:{s}" if s else "") + "\n" for g, s in groups)
    data = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, size in contigs:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    data += b"".join(bam_record(r, b"r%d" % i) for i, r in enumerate(reads))
    with open(path, "wb") as fh:
        for i in range(0, len(data), block):
            fh.write(bgzf.deflate(data[i : i + block]))
        fh.write(bgzf.EOF)
