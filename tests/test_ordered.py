"""Ordered results, and reports that leave nothing behind."""

import glob
import os

import pytest
from helpers import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.operators.reports import single_report, write_proofs
from blotter.params import Params
from blotter.plans.materialize import scratch_dir
from blotter.plans.ordered import DamagedOrder, read_ordered, write_ordered
from blotter.plans.registry import catalog_for
from blotter.sources.catalog import Catalog
from blotter.sources.schemas import RELATIONS

P = Params()


def with_ties(spark):
    """Dates made to tie, some report numbers NULL."""
    cat = catalog_for(spark, SF_MID)
    raw = {n: cat.raw(n) for n in RELATIONS}
    raw["incidents"] = raw["incidents"].withColumns({
        "report_date": F.date_trunc("year", "report_date").cast("timestamp_ntz"),
        "inc_report_number": F.when(F.col("incident_id") % 5 != 0, F.col("inc_report_number"))})
    return Catalog(raw)


def test_nine_proofs_come_back_in_order(spark, tmp_path):
    cat = with_ties(spark)
    write_proofs(cat, P, f"file://{tmp_path}")
    assert len(pr.ORDER) == 9
    for name, keys in pr.ORDER.items():
        got = read_ordered(spark, f"file://{tmp_path}/{name}").collect()
        places = [tuple((r[k] is None, "" if r[k] is None else r[k]) for k in keys) for r in got]
        assert places == sorted(places), name
        want = getattr(pr, name)(cat, P).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 3, name


def test_many_files_and_ties_keep_the_written_order(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7 % 50).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(df, f"file://{tmp_path}/a", ["k", "v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(glob.glob(f"{tmp_path}/a/rows/*.parquet")) > 1
    got = [tuple(r) for r in read_ordered(spark, f"file://{tmp_path}/a").collect()]
    assert got == sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0))


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    write_ordered(spark.range(100).repartition(3), path, ["id"])
    spark.range(5).withColumn("_place", F.lit(7).cast("long")).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(DamagedOrder):
        read_ordered(spark, path)
    other = f"file://{tmp_path}/b"
    spark.range(5).write.parquet(f"{other}/rows")
    with pytest.raises(DamagedOrder, match="no manifest"):
        read_ordered(spark, other)
    with pytest.raises(ValueError):
        write_ordered(spark.range(3).toDF("_place"), f"{tmp_path}/c", ["_place"])


def test_empty_result(spark, tmp_path):
    write_ordered(spark.range(0), f"file://{tmp_path}/a", ["id"])
    assert read_ordered(spark, f"file://{tmp_path}/a").collect() == []


@pytest.mark.parametrize("name", ["metrics_summary", "proof_avg_suspects", "vehicle_links"])
def test_single_reports_leave_nothing(spark, name):
    cat = catalog_for(spark, SF_SMALL)
    folder = f"{scratch_dir(spark).removeprefix('file://')}/materialized"

    def left():
        return {p for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p)}

    before = left()
    with single_report(cat, P, name) as df:
        rows = df.collect()
        assert rows and left() > before
    assert left() == before
    alone = getattr(me, name, None) or getattr(pr, name)
    assert sorted(map(str, rows)) == sorted(map(str, alone(cat, P).collect()))
