import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitewright import file_queries
from sitewright.plans import projection
from sitewright.sources import bam

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry._core.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = duck.sql(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*sorted(df.columns)).collect()) == plain(want)
    assert want or name == "rg_conflicts" or name == "unresolved_rg_anti"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bam_parts(spark, tmp_path, monkeypatch):
    """No task writes an input alone, and joined parts hold the reads in order."""
    n = projection.lines(spark, SF).count()
    monkeypatch.setattr(file_queries, "FEW_READS", 500)
    parts = file_queries._parts(spark, SF, str(tmp_path))
    per_task = {k: sum(p.n for p in parts if p.number == k) for k in {p.number for p in parts}}
    assert sum(per_task.values()) == n and max(per_task.values()) < 3 * 500
    fields = ["file_idx", "ref_id", "pos", "flag", "mapq", "rg", "cigar", "seq", "qual"]
    want = projection.alignments(spark, SF).orderBy("file_idx", "ord").select(*fields).collect()
    paths = file_queries._bams(spark, SF)
    assert bam.read_alignments(spark, paths, 5000).orderBy("file_idx", "ord").select(*fields).collect() == want
    assert sorted(os.listdir(os.path.dirname(paths[0]))) == ["0.bam", "1.bam", "2.bam"]


def test_bam_tasks():
    """Reads of a task: bounded at any size, and no more tasks than the shuffle deals to without memory while they are."""
    for reads in (0, 1, 60_000, 600_000, 36_000_000, 216_000_000, 10**10):
        tasks = file_queries._tasks(reads)
        assert tasks >= 1 and math.ceil(reads / tasks) <= file_queries.MANY_READS and (tasks <= file_queries.DEALT or reads > file_queries.DEALT * file_queries.MANY_READS)


@pytest.mark.parametrize("kept", ["l_returnflag = 'N'", "false"])
def test_bam_of_inputs_without_reads(spark, tmp_path, kept):
    """Inputs keep their numbers where others have no reads."""
    for t in ("region", "nation", "supplier", "part"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").where(kept).write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as con:
        for t in ("region", "nation", "supplier", "part"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet' WHERE {kept}")
        for name in ("bam_records", "bam_skipped_early"):
            df = entry.queries()[name](spark, str(tmp_path))
            names = ", ".join(f'"{c}"' for c in sorted(df.columns))
            assert plain(df.select(*sorted(df.columns)).collect()) == plain(con.sql(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_skipped_in_joined_parts(spark, duck, monkeypatch):
    """Reads are passed over alike in files joined from many parts, whose blocks are short."""
    monkeypatch.setattr(file_queries, "FEW_READS", 100)
    assert file_queries._tasks(projection.lines(spark, SF).count()) > 50
    got = entry.queries()["bam_skipped_early"](spark, SF)
    want = duck.sql(f"SELECT file_idx, ref_id, n, sum_pos FROM ({entry.oracle_sql()['bam_skipped_early']})").fetchall()
    assert plain(got.select("file_idx", "ref_id", "n", "sum_pos").collect()) == plain(want)


def test_bam_of_equal_lines(spark, tmp_path, monkeypatch):
    """A line of many copies is not one task's."""
    for t in ("region", "nation", "supplier", "part"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    held = f"SELECT * FROM '{SF}/lineitem.parquet'"
    with duckdb.connect() as con:
        con.execute(f"COPY ({held} UNION ALL SELECT one.* FROM ({held} WHERE l_linenumber = 3 AND l_partkey % 5 = 1 LIMIT 1) one, range(6000)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
        for t in ("region", "nation", "supplier", "part", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        monkeypatch.setattr(file_queries, "FEW_READS", 500)
        (tmp_path / "stage").mkdir()
        parts = file_queries._parts(spark, str(tmp_path), str(tmp_path / "stage"))
        per_task = {k: sum(p.n for p in parts if p.number == k) for k in {p.number for p in parts}}
        assert sum(per_task.values()) == projection.lines(spark, SF).count() + 6000 and max(per_task.values()) < 3 * 500
        got = entry.queries()["bam_skipped_early"](spark, str(tmp_path))
        want = con.sql(f"SELECT file_idx, ref_id, n, sum_pos FROM ({entry.oracle_sql()['bam_skipped_early']})").fetchall()
        assert plain(got.select("file_idx", "ref_id", "n", "sum_pos").collect()) == plain(want)
