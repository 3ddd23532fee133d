"""Bases, alleles and genotypes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
COUNTS = tuple(f"n{b}" for b in BASES)


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, null for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def index_base(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, BASES)), i)


def depth(counts: Column | None = None) -> Column:
    """The sum of the four counts, of columns or of a struct's fields."""
    each = [counts[n] if counts is not None else F.col(n) for n in COUNTS]
    return each[0] + each[1] + each[2] + each[3]


def count_of(base: Column, counts: Column | None = None) -> Column:
    out = F.lit(0).cast("long")
    for b, n in zip(BASES, COUNTS, strict=True):
        out = F.when(base == b, counts[n] if counts is not None else F.col(n)).otherwise(out)
    return out


def choose_alt(ref: Column) -> Column:
    """struct(alt, alt_count): the base other than ref with the highest count, the first of equals in the order
    A, C, G, T; count 0 if the others have none."""
    options = F.array(*[F.struct(F.col(n).alias("n"), F.lit(-i).alias("rank"), F.lit(b).alias("base")) for i, (b, n) in enumerate(zip(BASES, COUNTS, strict=True))])
    best = F.array_max(F.filter(options, lambda x: x["base"] != ref))
    return F.struct(best["base"].alias("alt"), best["n"].alias("alt_count"))


def genotype(dp: Column, ref_count: Column, alt_count: Column) -> Column:
    return F.when(dp == 0, "./.").when(alt_count == 0, "0/0").when(ref_count == 0, "1/1").otherwise("0/1")


def sample_call(ref: Column, alt: Column, counts: Column) -> Column:
    """struct(gt, dp, ad_ref, ad_alt) from a struct of four counts. Depth has third alleles too."""
    dp, r, a = depth(counts), count_of(ref, counts), count_of(alt, counts)
    return F.struct(genotype(dp, r, a).alias("gt"), dp.alias("dp"), r.alias("ad_ref"), a.alias("ad_alt"))


def line_layout(length: Column, width: int = 60) -> tuple[Column, Column]:
    """Bases and bytes of a line in an index of a sequence file whose lines have ``width`` bases."""
    bases = F.when(length == 0, F.lit(1).cast("long")).otherwise(F.least(length, F.lit(width).cast("long")))
    return bases, bases + 1
