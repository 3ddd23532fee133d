"""Mixing of sources to target weights by hash-threshold histograms.

Each document has a number from its id alone (48 bits). A source's words are summed by the number's first 12
bits; where the running sum meets the budget, only that bucket is divided by the next 12 bits, and so on. The
documents below the threshold found are taken once more than the others: a filter, no sort of documents.
A larger budget takes all that a smaller one takes.

Null text has size 0; null source is a source of its own and comes last. Documents of size 0 take part and
take nothing. Rows with equal ids are taken or left together. If no row has words, all targets are 0. Of an
empty table the result is empty. `mix` reads no other columns; `mixed` keeps them all, and their names must not
start with ``_mix_`` or be ``_joined_hot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, filled, joined, joined_hot, save

WEIGHTS = (3, 1, 2)
BITS, LEVELS = 12, 4
#: A source is taken so many times, at most.
MOST = 2


def number_of(id_col: str):
    """48 bits of the id's MD5: the same on each run and for each budget."""
    return F.conv(F.substring(F.md5(filled(F.col(id_col).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_key(source_col: str):
    """A source as a key for joins, null too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        source_key(source_col).alias("source_key"),
        F.regexp_count(filled(F.col(text_col).cast("string")), F.lit(WORD)).cast("long").alias("size"),
        number_of(id_col).alias("number"),
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, num: int = 3, den: int = 2, most: int = MOST) -> DataFrame:
    """Adds target to source_key, source, source_size. The budget is num/den of all sizes; what a source
    cannot use beyond ``most`` times its size goes to the others by weight. Sources fill up in the order of
    size over weight, so the level at which the rest stands follows from running sums: no iteration. One row a
    source goes through the windows."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", weight)
    by_ratio = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    t = t.withColumns(
        {
            "all_size": F.sum("source_size").over(everything),
            "filled": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # den times the budget that is left once all earlier sources are full
    left = F.col("all_size") * num - F.col("filled") * (most * den)
    t = t.withColumns({"left": left, "full": left * F.col("weight") >= F.col("source_size") * F.col("rest_weight") * (most * den)})
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("left").alias("left"), F.col("rest_weight").alias("rest")))).over(everything)
    t = t.withColumn("first", first)
    share = (F.col("weight") * F.col("first.left")).cast("double") / (F.col("first.rest") * den).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return t.select(*totals.columns, target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: copies (that every document gets) and bound (documents with a smaller number get one
    more). Each level sums words by source and bucket, over the boundary buckets of the level above alone."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.select("source_key", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift, last = BITS * (LEVELS - 1 - level), level == LEVELS - 1
        inside = rows.withColumn("prefix", F.shiftright("number", shift + BITS))
        if level:
            inside = joined(inside, state.select("source_key", "prefix"), ["source_key", "prefix"], "left_semi")
        hist = inside.groupBy("source_key", F.shiftright("number", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        hist = hist.withColumn("upto", F.sum("size").over(W.partitionBy("source_key").orderBy("bucket")))
        hist = joined(hist, state.select("source_key", "budget"), ["source_key"])
        # at the last level a bucket is one number: it is taken if that brings the sum nearer to the budget
        over = F.col("upto") - (F.col("size") / 2 if last else 0) > F.col("budget")
        found = hist.groupBy("source_key").agg(
            F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("size")).alias("below")))).alias("at"),
            F.max("bucket").alias("top"),
            F.max("upto").alias("all"),
        )
        left = F.col("budget") - F.coalesce("at.below", "all", F.lit(0))
        at = F.coalesce("at.bucket", F.col("top") + 1, F.shiftleft("prefix", BITS))
        state = save(state.join(found, ["source_key"], "left").select("source_key", "copies", left.alias("budget"), at.alias("prefix")), "mix-level")
    return state.select("source_key", "copies", F.col("prefix").alias("bound"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source_key, source_size, rows, target, copies, bound for each source of `sizes`."""
    totals = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = save(targets(totals, weights), "mix-targets")
    return goals.join(thresholds(rows, goals), "source_key").drop("source")


def _copies(copies: str = "copies", number="number", bound: str = "bound"):
    """A full source has no budget left: a document without words before its bound gets no third copy."""
    number = F.col(number) if isinstance(number, str) else number
    return F.least(F.col(copies) + (number < F.col(bound)).cast("long"), F.lit(MOST).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """id, source, size, source_size, target, copies (0 to 2) and taken for each row."""
    rows = save(sizes(docs, id_col, text_col, source_col), "mix-rows")
    # a source may hold a third of all rows
    out = joined_hot(rows, plan(rows, weights), ["source_key"], "rows", "inner")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _copies().alias("copies"), (F.col("size") * _copies()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows themselves, each as often as the mix takes it; texts do not move."""
    rows = save(sizes(docs, id_col, text_col, source_col), "mix-rows")
    chosen = save(plan(rows, weights), "mix-plan")
    chosen = chosen.select(F.col("source_key").alias("_mix_key"), F.col("rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies"), F.col("bound").alias("_mix_bound"))
    keyed = docs.withColumn("_mix_key", source_key(source_col))
    times = _copies("_mix_copies", number_of(id_col), "_mix_bound")
    repeated = joined_hot(keyed, chosen, ["_mix_key"], "_mix_rows", "inner").withColumn("_mix_times", times).where("_mix_times > 0")
    return repeated.withColumn("_mix_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times")))).select(*docs.columns)
