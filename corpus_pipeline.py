"""From documents to shards: toxicity, near duplicates, benchmark passages, mixture, shards.

Each stage works on all rows that the stage before it kept. The first three only take rows away, the fourth
repeats rows, the last deals them to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import decontamination, mixing, near_dedup, sharding, toxicity
from sitewright.llm.common import drop, joined, limit_batches, save, table

#: Near duplicates share 80 of 100 five-word shingles.
PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score of 1/2 or more go. Labels of held-out documents are not learnt here either."""
    labels = table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    # this session is the pipeline's own, and the plan below runs when the stage's rows are written
    limit_batches(spark)
    return toxicity.score(docs, weights, score_col="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, each of its texts once. Rows
    without an id are linked with nothing, so all of them stay."""
    found = save(near_dedup.near_duplicates(docs, percent=PERCENT), "pipeline-near")
    kept = joined(docs, found.where("NOT kept").select("doc_id").distinct(), ["doc_id"], "left_anti", near_dedup.FEW)
    again = save(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    if not again.limit(1).count():
        return kept
    repeated = joined(kept, again, ["doc_id"], "left_semi", near_dedup.FEW).dropDuplicates(["doc_id", "text"])
    return joined(kept, again, ["doc_id"], "left_anti", near_dedup.FEW).unionByName(repeated)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go; rows without an id, each by itself."""
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.contaminated(docs.where("doc_id IS NOT NULL"), items)
    clean = joined(docs, save(found.select("doc_id").distinct(), "pipeline-leaks"), ["doc_id"], "left_anti")
    nameless = docs.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return clean
    # saved before its rows' numbers are used: they need not come out the same a second time
    keyed = save(nameless.withColumn("_row", F.monotonically_increasing_id()), "pipeline-nameless")
    found = decontamination.contaminated(keyed, items, id_col="_row")
    own = joined(keyed, save(found.select("_row").distinct(), "pipeline-leaks"), ["_row"], "left_anti")
    return clean.where("doc_id IS NOT NULL").unionByName(own.drop("_row"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: The stages are no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage read is deleted once its own rows are written; the tables that
    the result reads stay until `common.clear`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
