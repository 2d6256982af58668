"""Incident facts, id spans and heavy buckets: fewer scans, fewer row groups, even tasks."""

import datetime as dt
from collections import Counter
from statistics import median

import pytest
from helpers import SF_MID, SF_SMALL, incident, make_catalog, money, ts
from pyspark.sql import functions as F

from blotter.operators import cohort as co
from blotter.operators import facts as fa
from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.operators import rollups as ro
from blotter.operators import suspects as su
from blotter.operators.reports import report_set
from blotter.params import Params
from blotter.plans.inspect import plan_text, scans
from blotter.plans.registry import catalog_for
from blotter.sources.buckets import bucket_sizes, evened
from blotter.sources.catalog import Catalog
from blotter.sources.schemas import RELATIONS, SCHEMAS

P = Params()
ROLLUP_TABLES = ("offenses", "incidents", "inc_case_inc_status_vw", "incident_cases", "arrests", "incident_properties",
                 "incident_people", "incident_person_roles", "incident_vehicles")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_facts_are_the_rollups(spark):
    cat = catalog_for(spark, SF_MID)
    cohort = pr.described_cohort(cat, P)
    keys = cohort.keys
    facts = fa.incident_facts(cat, keys, fa.ALL)
    for rollup in (ro.case_numbers, ro.property_loss_rows, su.suspect_evidence, ro.vehicle_rollup):
        want = rollup(cat, keys)
        marks = [c for c in want.columns if c != "incident_id"]
        got = facts.select("incident_id", *marks).where(F.coalesce(*[F.col(c).cast("string") for c in marks]).isNotNull())
        assert same(got, want.where(F.coalesce(*[F.col(c).cast("string") for c in marks]).isNotNull())), rollup.__name__
    assert facts.groupBy("incident_id").count().where("count > 1").count() == 0
    arrests = ro.per_incident(keys, ro.arrest_rollup(cat, keys))
    assert same(facts.where("has_arrest = 1").select(*arrests.columns), arrests)


def test_shared_facts_equal_single_reports(spark):
    cat = catalog_for(spark, SF_SMALL)
    with report_set(cat, P) as out:
        for name, df in out.items():
            alone = me.metrics_summary(cat, P) if name == "metrics_summary" else getattr(pr, name)(cat, P)
            assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str), name


def test_narrowed_cohort_is_the_described_one(spark):
    cat = catalog_for(spark, SF_MID)
    wide = pr.inclusive_cohort(cat, P)
    assert same(wide.narrowed(P).rows, co.cohort_described(cat, P))


def test_each_table_is_scanned_once_per_set(spark, monkeypatch):
    """Counts the scans of all that a report set runs: its written tables when they are made, and its reports."""
    import blotter.plans.materialize as ma
    cat = catalog_for(spark, SF_MID)
    seen = Counter()

    def tell(df):
        text = plan_text(df, "simple")
        for t in ROLLUP_TABLES:
            # Scans of the plan before it runs, exchanges not yet reused: an upper bound.
            seen[t] += sum(f"_{t}[" in line or line.rstrip().endswith(f"_{t}") or f"_{t} " in line
                           for line in text.splitlines() if "FileScan parquet" in line)

    write = ma._write
    monkeypatch.setattr(ma, "_write", lambda df, *a, **k: (tell(df), write(df, *a, **k))[1])
    with report_set(cat, P) as out:
        for df in out.values():
            tell(df)
    # Arrests serve reports and persons (two groupings), so they are read for each.
    assert seen.pop("arrests") <= 2
    assert seen and set(seen.values()) == {1}, seen


def test_cohort_queries_scan_incidents_once(spark, monkeypatch):
    import blotter.plans.materialize as ma
    cat = catalog_for(spark, SF_MID)
    write, texts = ma._write, []
    monkeypatch.setattr(ma, "_write", lambda df, *a, **k: (texts.append(plan_text(df, "simple")), write(df, *a, **k))[1])
    for fn in (co.cohort_base, co.cohort_described, co.cohort_inclusive, co.cohort_incident_keys):
        texts.clear()
        texts.append(plan_text(fn(cat, P), "simple"))
        assert sum("PushedFilters: [IsNotNull(agncy_cd_agency_code)" in line
                   for t in texts for line in t.splitlines() if "FileScan" in line) == 1


# -- id spans -----------------------------------------------------------------

@pytest.fixture
def by_date(spark, tmp_path):
    """Stored relations whose ids grow with the report date, in many small row groups."""
    n = 4000
    rows = spark.range(n)
    day = F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(CAST(id * 1460 div 4000 AS INT))")
    data = {
        "incidents": rows.select(F.col("id").alias("incident_id"), F.concat(F.lit("R"), "id").alias("inc_report_number"),
                                 F.lit(P.agency).alias("agncy_cd_agency_code"), day.alias("report_date")),
        "offenses": rows.select(F.col("id").alias("inc_incident_id"), F.lit("OC1").alias("offns_cd_offense_code")),
        "incident_properties": rows.select(F.col("id").alias("incsup_incident_id"), F.lit(5).alias("value"),
                                           F.lit("7").alias("prop_loss_code")),
        "incident_vehicles": rows.select(F.col("id").alias("incident_id"), F.col("id").alias("vehicle_id")),
        "incident_people": rows.select(F.col("id").alias("inc_per_id"), F.col("id").alias("inc_incident_id"),
                                       F.lit("Y").alias("suspus_using_code")),
        "incident_cases": rows.select(F.col("id").alias("inc_case_id"), F.concat(F.lit("C"), "id").alias("inc_case_number")),
        "inc_case_inc_status_vw": rows.select(F.col("id").alias("incident_id"), F.col("id").alias("inc_case_id")),
    }
    base = make_catalog(spark)
    tables = {}
    for name in RELATIONS:
        df = data.get(name, base.raw(name))
        if name in data:
            have = set(df.columns)
            df = df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in SCHEMAS[name].fields])
            df.repartitionByRange(8, df.columns[0]).write.option("parquet.block.size", 4096).option(
                "parquet.page.size", 512).option("parquet.page.size.row.check.min", 10).option(
                "parquet.block.size.row.check.min", 10).parquet(str(tmp_path / name))
            df = spark.read.parquet(str(tmp_path / name))
        tables[name] = df
    return Catalog(tables)


def test_scans_skip_what_lies_outside_the_cohorts_ids(spark, by_date):
    """One year of four: about a quarter of each table's rows leaves the scans."""
    p = Params(report_year=1997)
    cohort = pr.described_cohort(by_date, p)
    assert 900 < cohort.size.rows < 1100
    for part in ("loss", "vehicles", "suspects", "case_numbers"):
        df = fa.incident_facts(by_date, cohort.keys, (part,))
        df.collect()
        read = [(t, n) for t, n in scans(df) if any(x in t for x in (
            "incident_properties", "incident_vehicles", "incident_people", "inc_case_inc_status_vw"))]
        assert read and all(n < 2000 for _, n in read), (part, read)
    rows = pr.proof_summed_loss_value(by_date, p, cohort).collect()
    assert len(rows) == cohort.size.rows and {r.total_loss_value for r in rows} == {money(5)}


def test_few_ids_are_listed(spark, by_date):
    p = Params(report_year=1997, report_number="R1500")
    cohort = pr.described_cohort(by_date, p)
    df = ro.property_loss(by_date, cohort.keys)
    assert [r.incident_id for r in df.collect()] == [1500]
    assert "In(incsup_incident_id" in plan_text(df) or "EqualTo(incsup_incident_id" in plan_text(df)


def test_empty_cohort_has_no_span(spark):
    cat = make_catalog(spark, incidents=[incident(1, "R1", ts(2020))], offenses=[(1, "OC1", None, None)])
    p = Params(report_year=1901)
    assert pr.proof_avg_suspects(cat, p).collect() == []
    assert me.metrics_summary(cat, p).collect()[0].total_reports == 0


# -- stored relations -------------------------------------------------------------

def test_files_of_a_bucketed_relation_do_not_grow_with_the_writing_tasks(spark):
    """Rows are gathered by bucket before they are written: four writing parts, still one file a bucket."""
    from blotter.sources.fixtures import _BUCKET, derive
    cat, derived = catalog_for(spark, SF_SMALL), derive(spark, SF_SMALL)
    for name in _BUCKET:
        assert len(cat.raw(name).inputFiles()) <= 8, name
    for name in ("inc_case_inc_status_vw", "incident_person_roles", "arrests"):
        assert same(cat.raw(name), derived[name]), name


def test_suspects_have_a_task_a_bucket(spark, tmp_path, monkeypatch):
    """More buckets, smaller tasks: people meet their incidents in as many tasks as there are buckets."""
    from blotter.sources import fixtures
    monkeypatch.setattr(fixtures, "BUCKET_BYTES", fixtures.BUCKET_BYTES // 2048)
    cat = fixtures.fixture_catalog(spark, SF_SMALL)
    n = fixtures.bucket_count(spark, SF_SMALL)
    assert n > fixtures.LEAST_BUCKETS
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert su._people(cat, None).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert same(su.suspect_counts(cat), su.suspect_counts(catalog_for(spark, SF_SMALL)))


def test_suspects_have_tasks_by_the_input_whatever_the_session_has(spark, monkeypatch):
    """Arrests meet people, and people their incident, in as many tasks as the bytes of the people ask for."""
    from blotter.sources import buckets
    want = [q(catalog_for(spark, SF_SMALL)).collect() for q in (su.suspect_counts, su.suspect_evidence)]
    people = catalog_for(spark, SF_SMALL).raw("incident_people")
    monkeypatch.setattr(buckets, "TASK_BYTES", buckets.stored_bytes(people) // 20)
    cat = Catalog({n: catalog_for(spark, SF_SMALL).raw(n) for n in RELATIONS})
    n = cat.tasks("incident_people")
    assert 20 <= n <= 21 and int(spark.conf.get("spark.sql.shuffle.partitions")) < n
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert su.person_rows(cat).rdd.getNumPartitions() == n
        plan = plan_text(su.suspect_counts(cat), "simple")
        assert plan.count(f", {n}), REPARTITION_BY_NUM") == 3  # people, arrests, suspects
        assert plan_text(su.suspect_evidence(cat), "simple").count(f", {n}), REPARTITION_BY_NUM") == 3
        assert sorted(su.suspect_counts(cat).collect()) == sorted(want[0])
        assert sorted(su.suspect_evidence(cat).collect()) == sorted(want[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_stored_bytes_are_those_of_the_files_read(spark, tmp_path):
    from blotter.sources.buckets import stored_bytes, tasks_for
    for name in ("a b", "c"):
        spark.range(1000).repartition(3).write.parquet(str(tmp_path / name))
    sizes = {n: [(f, f.stat().st_size) for f in (tmp_path / n).glob("*.parquet")] for n in ("a b", "c")}
    assert stored_bytes(spark.read.parquet(str(tmp_path / "a b"))) == sum(s for _, s in sizes["a b"])
    one, size = sizes["c"][0]
    assert stored_bytes(spark.read.parquet(str(one))) == size  # not its neighbours
    assert stored_bytes(spark.range(10)) == 0 and tasks_for(0) == 1


# -- heavy buckets ---------------------------------------------------------------

@pytest.fixture
def hot_arrests(spark, tmp_path):
    """A bucketed table of arrests in which one report has a third of the rows."""
    n = 60_000
    df = spark.range(n).select(
        F.col("id").alias("arrest_id"), F.concat(F.lit("A"), "id").alias("arrest_num"), F.lit(P.agency).alias("agency_code"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("R"), F.col("id") % 9000)).alias("inc_report_number"),
        F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("arrest_date"), F.col("id").alias("person_id"))
    df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["arrests"].fields])
    df.write.option("path", str(tmp_path / "arrests")).option("compression", "none").option(
        "parquet.block.size", 8192).option("parquet.page.size", 1024).option(
        "parquet.block.size.row.check.min", 10).option("parquet.page.size.row.check.min", 10).bucketBy(
        8, "inc_report_number").sortBy("inc_report_number").saveAsTable("hot_arrests")
    yield spark.table("hot_arrests")
    spark.sql("DROP TABLE hot_arrests")


def test_heavy_bucket_is_read_without_bucketing(spark, hot_arrests):
    sizes = bucket_sizes(hot_arrests)
    assert len(sizes) == 8 and sizes[-1] > 3 * median(sizes)
    assert evened(hot_arrests) is hot_arrests  # below the bytes that one task may read
    base = {n: make_catalog(spark).raw(n) for n in RELATIONS} | {"arrests": hot_arrests}
    plain, even = Catalog(base), Catalog(base, heavy_bucket_bytes=1)
    # Splits in the proportions of a large table: files of many splits, a small cost of opening one.
    small = {"spark.sql.files.maxPartitionBytes": str(sum(sizes) // 12), "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        def tasks(cat):
            rows = ro.arrest_rows(cat, None, ("arrest_id",))
            return [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]

        assert max(tasks(even)) <= 3 * median(tasks(even))
        for fn in (ro.arrest_flags, ro.arrest_counts, ro.arrest_rollup):
            got, want = fn(even), fn(plain)
            assert "Exchange" in plan_text(got, "simple") and "Exchange" not in plan_text(want, "simple")
            assert same(got, want), fn.__name__
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_other_tables_stay_as_they_are(spark, tmp_path, hot_arrests):
    df = spark.range(10)
    assert bucket_sizes(df) == [] and evened(df, 0) is df
    some = hot_arrests.where("arrest_id > 5")  # not a table as it stands: its files hold more rows
    assert evened(some, 0) is some
