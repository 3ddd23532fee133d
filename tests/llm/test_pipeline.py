import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from sitewright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(names) + f" FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


def test_stages(spark):
    """Each stage works on what the one before kept, keeps the columns, and takes effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.save(stage(spark, docs, SF), "test-stage")
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        ids = [r.doc_id for r in after.collect()]
        assert set(ids) <= before and (name == "mixture" or len(ids) == len(set(ids)))
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
            assert len(toxic - set(ids)) >= 0.3 * len(toxic) and len(clean & set(ids)) >= 0.95 * len(clean & before)
        docs, before = after, set(ids)
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())


def test_repeated_rows(spark):
    """Of rows repeated with one id, the near-duplicate stage keeps one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    once = pipeline.without_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in pipeline.without_near_duplicates(spark, docs.union(docs), SF).collect()) == sorted(r.doc_id for r in once.collect())


def test_rows_without_id(spark):
    """Different texts without an id, or of one id, all stay; of rows without an id those with a passage go."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    made = [(None, "one two three four five six seven"), (None, "eight nine ten eleven twelve thirteen"), (None, f"so {item} it is"), (1, "a text of some words"), (1, "quite another one here"), (1, "a text of some words"), (2, f"here {item} again"), (3, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    near = pipeline.without_near_duplicates(spark, docs.where("doc_id IS NULL OR doc_id <> 2"), SF)
    assert sorted(map(repr, map(tuple, near.collect()))) == sorted(map(repr, [*made[:5], made[7]]))
    clean = pipeline.without_benchmark(spark, docs, SF)
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, [*made[:2], *made[3:6], made[7]]))


def test_by_brute_force(spark, tmp_path):
    """All stages over a made corpus against plain models of each."""
    import hashlib
    import random
    import re
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from sitewright.llm import decontamination, toxicity
    from test_llm_operators import WORD, brute_align, brute_near, brute_targets, least_capacity, vocabulary

    rng = random.Random(21)
    words, bad = vocabulary(rng, 600), ["vile", "rotten", "foul"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(20) for _ in range(4)]
    made, toxic = [], {}
    for i in range(260):
        w = text(rng.randint(1, 90))
        if i % 5 == 0:
            w += rng.choices(bad, k=4)
            rng.shuffle(w)
        elif i % 11 == 0:
            copy = list(rng.choice(items))
            for k in rng.sample(range(20), rng.randint(0, 8)):
                copy[k] = rng.choice(words)
            w[3:3] = copy
        elif i % 3 == 0 and made:
            w = made[rng.randrange(len(made))][1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        toxic[i] = int(any(x in bad for x in w))
        made.append((i, " ".join(w), "en", rng.choice(["a", "a", "a", "b", None]), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(made, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r[0]: r for r in made}
    after = []
    for _, stage in pipeline.STAGES:
        docs = pipeline.save(stage(spark, docs, str(tmp_path)), "test-brute")
        after.append(docs.collect())
    ids = [Counter(r.doc_id for r in rs) for rs in after]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(made, schema), labels).collect()}
    assert set(ids[0]) == {i for i, y in scored.items() if not y} and sum(toxic[i] == 0 for i in ids[0]) == sum(y == 0 for y in toxic.values()) and len(ids[0]) < 225
    _, component = brute_near([rows[i] for i in ids[0]], 80)
    assert set(ids[1]) == {i for i in ids[0] if component[i] == i} and len(ids[1]) < len(ids[0])
    plain = {i: re.findall(r"[^\W_]+", rows[i][1].lower()) for i in ids[1]}
    leaks = {i for i in ids[1] if any(brute_align(x, plain[i]) >= decontamination.LEAST * len(x) for x in items)}
    assert set(ids[2]) == set(ids[1]) - leaks and len(leaks) > 8
    size = {i: len(WORD.findall(rows[i][1])) for i in ids[2]}
    by_source = defaultdict(list)
    for i in ids[2]:
        by_source[rows[i][3]].append(i)
    want = Counter()
    for source, target in brute_targets({s: sum(size[i] for i in own) for s, own in by_source.items()}).items():
        own = sorted(by_source[source], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:12])
        whole = sum(size[i] for i in own)
        copies, upto = int(target // whole), 0
        budget, open_ = target - copies * whole, True
        for i in own:
            upto += size[i]
            open_ = open_ and upto - size[i] / 2 <= budget
            want[i] = copies + open_
    assert ids[3] == Counter({i: n for i, n in want.items() if n}) and max(want.values()) == 2
    assert ids[4] == ids[3]
    key = {r.doc_id: r.k for r in spark.createDataFrame(made, schema).select("doc_id", F.xxhash64("text").alias("k")).collect()}
    groups, load = Counter(), Counter()
    for r in after[4]:
        groups[key[r.doc_id]] += len(rows[r.doc_id][1].encode()) + 1
        load[r.shard] += r.size
    assert max(load.values()) == least_capacity([groups[k] for k in sorted(groups)], 8)


def test_shuffled(spark, monkeypatch):
    """The same rows where no table is broadcast."""
    from sitewright.llm import common

    want = sorted(map(repr, pipeline.run(spark, SF).drop("slot").collect()))
    monkeypatch.setattr(common, "small", lambda df, rows: False)
    assert sorted(map(repr, pipeline.run(spark, SF).drop("slot").collect())) == want
