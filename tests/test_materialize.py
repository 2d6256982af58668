"""Intermediate tables: shared folder or an error, whole reads, folders that go."""

import os

import pytest
from helpers import SF_SMALL
from pyspark.sql import functions as F

from blotter.functions import joins
from blotter.plans import materialize as ma
from blotter.sources import fixtures


class _Conf(dict):
    def set(self, k, v):
        self[k] = v


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf(conf)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"])
def test_a_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ma.scratch_dir(_Session(**{"spark.master": master}))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_gets_a_temporary_folder(master):
    s = _Session(**{"spark.master": master})
    assert os.path.isdir(ma.scratch_dir(s)) and s.conf["spark.checkpoint.dir"] == ma.scratch_dir(s)


def test_a_set_folder_is_used():
    s = _Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared"})
    assert ma.scratch_dir(s) == "hdfs:///shared"


def test_missing_rows_are_an_error(spark, tmp_path):
    df = spark.range(10).repartition(3)
    again, size = ma.materialize_sized(df, verify=True)
    assert again.count() == size.rows == 10
    ma.check_rows(again, 10, "x")
    with pytest.raises(ma.IncompleteWrite, match="10 rows were written"):
        ma.check_rows(again.where("id < 7"), 10, "x")


def test_bytes_are_measured(spark):
    df = spark.createDataFrame([("a" * 1000, 1), (None, 2)], "s string, n long")
    assert 1000 < joins.measured_bytes(df) < 1200
    assert ma.materialize_sized(df)[1] == (2, joins.measured_bytes(df))
    assert joins.measured_bytes(df.where("false")) == 0


def test_warehouse_is_set_for_local_masters_only(monkeypatch):
    from blotter.plans import session
    seen = {}

    class Builder:
        def appName(self, _):
            return self

        def master(self, _):
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):
            raise StopIteration

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    for master, there in ((None, False), ("spark://h:1", False), ("local[2]", True)):
        seen.clear()
        with pytest.raises(StopIteration):
            session.build_session(master)
        assert ("spark.sql.warehouse.dir" in seen) is there


def test_report_set_drops_its_folder(spark):
    from blotter.operators.reports import report_set
    from blotter.params import Params
    from blotter.plans.registry import catalog_for
    with report_set(catalog_for(spark, SF_SMALL), Params()) as out:
        assert os.path.isdir(out.folder) and out["metrics_summary"].count() == 1
    assert not os.path.exists(out.folder)


def test_bucket_count_follows_the_input(spark, monkeypatch):
    from blotter.sources import fixtures
    assert fixtures.bucket_count(spark, SF_SMALL) == fixtures.LEAST_BUCKETS
    monkeypatch.setattr(fixtures, "BUCKET_BYTES", 4000)
    assert fixtures.bucket_count(spark, SF_SMALL) in (32, 64)


def test_a_bucket_has_about_the_same_bytes_at_any_size(spark, tmp_path, monkeypatch):
    """A task's memory follows from its bucket, so the number of buckets grows with the input."""
    monkeypatch.setattr(fixtures, "LEAST_BUCKETS", 1)
    found = []
    for rows in (1_000_000, 4_000_000):
        path = tmp_path / str(rows)
        spark.range(rows).select(F.rand(1).alias("x")).coalesce(1).write.parquet(str(path / "lineitem.parquet"))
        found.append(fixtures.bucket_count(spark, str(path)))
        size = sum(f.stat().st_size for f in (path / "lineitem.parquet").glob("*.parquet"))
        assert size / found[-1] <= 16 * 1024 * 1024
    assert found[0] == 1 and found[1] == 4
