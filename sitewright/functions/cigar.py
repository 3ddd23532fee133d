"""CIGAR strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blocks(cigar: Column) -> Column:
    """array(struct(r, q, len)): runs of aligned bases, with their offsets from the alignment's start (r) and
    from the read's (q). Insertions and soft clips pass over read bases, deletions and skips over reference
    bases, hard clips and padding over neither. A single run, as most reads have, is taken without a fold."""
    long = lambda n: F.lit(n).cast("long")
    whole = F.struct(long(0).alias("r"), long(0).alias("q"), F.regexp_extract(cigar, r"^(\d+)", 1).cast("long").alias("len"))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    none = F.array().cast("array<struct<r:bigint,q:bigint,len:bigint>>")
    start = F.struct(long(0).alias("r"), long(0).alias("q"), none.alias("out"))

    def step(acc: Column, op: Column) -> Column:
        n = F.substring(op, F.lit(1), F.length(op) - 1).cast("long")
        kind = F.right(op, F.lit(1))
        both, read, ref = kind.isin("M", "=", "X"), kind.isin("I", "S"), kind.isin("D", "N")
        block = F.struct(acc["r"].alias("r"), acc["q"].alias("q"), n.alias("len"))
        return F.struct(
            F.when(both | ref, acc["r"] + n).otherwise(acc["r"]).alias("r"),
            F.when(both | read, acc["q"] + n).otherwise(acc["q"]).alias("q"),
            F.when(both & (n > 0), F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(cigar.rlike(r"^\d{1,10}[M=X]$"), F.array(whole)).otherwise(F.aggregate(ops, start, step, lambda acc: acc["out"]))
