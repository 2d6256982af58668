"""Test relations derived from the TPC-H style tables under /root/testdata.

The source database's records are private, so the 16 relations are derived,
deterministically, from ``orders``, ``lineitem``, ``part`` and ``customer``
(FIXTURES.md gives the same rules as text).  ``derive`` builds them as lazy
DataFrames over the parquet files; ``fixture_catalog`` writes them once, as
parquet under the shared scratch folder, and serves them like stored tables, so
the reports see plain column scans with predicate pushdown, as they would on
the real relations.  The derived relations grow with the scale factor and
every report reads its whole input.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.plans.materialize import scratch_dir
from blotter.sources.catalog import Catalog
from blotter.sources.schemas import MONEY, RELATIONS

# ---------------------------------------------------------------------------
# Fixed values of the derivation (must match FIXTURES.md and the oracle CTEs).
# ---------------------------------------------------------------------------
AGENCY_A, AGENCY_B = "TN0830400", "TN0830500"
OFFENSE_CODE_BY_REMAINDER = {
    0: "39-14-103 - 26A",
    1: "39-14-104 - 26A",
    2: "39-14-103 - 23C",
    3: "39-14-146",
    4: "39-14-146 (A)(1)",
    5: "39-14-146 (A)(2)",
}
NIBRS_OFFENSES = [
    ("39-14-103 - 26A", "26A"), ("39-14-103 - 23C", "23C"), ("39-14-146", "23C"),
    ("39-14-146", "23D"), ("39-14-146 (A)(1)", "23c"), ("39-14-146 (A)(2)", "23C"),
    ("39-14-146 (A)(2)", "23C"), ("OC-06", "26A"), ("OC-08", "13B"),
]
NIBRS_CODES = [("23C", "Shoplifting"), ("26A", "False Pretenses"), ("13B", "Simple Assault")]
EJS_CODES = [
    ("STATUS", "O", "Open - Active"), ("STATUS", "R", "Reopened"), ("STATUS", "C", "Closed"),
    ("STATUS", "A", "Cleared by Arrest"), ("STATUS", "N", None),
    ("REL", "SU", "Suspect"), ("REL", "OF", "Offender"), ("REL", "VI", "Victim"),
    ("REL", "WI", "Witness"), ("REL", "S", "Stranger"),
    ("PLACE", "0", "Department Store"), ("PLACE", "1", "Convenience Store"),
    ("PLACE", "2", "Parking Lot"), ("PLACE", "3", "Grocery"),
]
ROLE_CODES = [("S", "Subject"), ("V", "Victim"), ("W", "Witness"),
              ("SP", "Suspect Primary"), ("OP", "Offender Principal")]
RELATION_CODE_BY_REMAINDER = {0: "SU", 1: "OF", 2: "VI", 3: "WI", 4: "S", 5: "S/O",
                              6: None, 7: "susp2"}
ROLE_TYPE_BY_REMAINDER = {0: "S", 1: "so", 2: "V", 3: "W"}


def _pad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _case(key: Column, mapping: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        val = F.lit(v).cast("string")
        out = F.when(key == k, val) if out is None else out.when(key == k, val)
    return out.otherwise(default) if default is not None else out


def _offense_code(rem: Column) -> Column:
    return _case(rem, OFFENSE_CODE_BY_REMAINDER, F.concat(F.lit("OC-"), _pad(rem, 2)))


def _report_key(orderkey: Column) -> Column:
    # Two consecutive orders share one report number.
    return orderkey - orderkey % 2


def _report_number(orderkey: Column) -> Column:
    r = _report_key(orderkey)
    return F.when(r % 101 != 0, F.concat(F.lit("R"), _pad(r, 8)))


def _agency(orderkey: Column) -> Column:
    return F.when(_report_key(orderkey) % 10 < 6, F.lit(AGENCY_A)).otherwise(F.lit(AGENCY_B))


def _values(spark: SparkSession, rows: list, *names: str) -> DataFrame:
    """A small constant relation, built JVM-side (a local relation, no Python RDD)."""
    structs = [F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(sf_dir.rstrip("/") + f"/{name}.parquet")

    orders, lineitem = read("orders"), read("lineitem")
    part, customer = read("part"), read("customer")
    ok, lk = F.col("o_orderkey"), F.col("l_orderkey")

    incidents = orders.select(
        ok.alias("incident_id"),
        _report_number(ok).alias("inc_report_number"),
        _agency(ok).alias("agncy_cd_agency_code"),
        F.when(ok % 97 != 0, F.col("o_orderdate")).alias("report_date"),
    )
    offenses = lineitem.select(
        lk.alias("inc_incident_id"),
        _offense_code(F.col("l_partkey") % 20).alias("offns_cd_offense_code"),
        F.lit("PLACE").alias("place_code_type"),
        F.when(F.col("l_suppkey") % 6 != 5, (F.col("l_suppkey") % 6).cast("string"))
         .alias("place_place_code"),
    )
    pk = F.col("p_partkey")
    offense_codes = part.filter(pk < 19).select(
        _offense_code(pk).alias("offense_code"),
        F.when(pk != 5, F.concat(F.upper("p_name"), F.lit(" "), F.col("p_type")))
         .alias("offense_desc"),
    )
    status = F.col("o_orderstatus")
    incident_cases = orders.select(
        (ok + 1000000).alias("inc_case_id"),
        F.when(ok % 53 != 0, F.concat(F.lit("C"), _pad(ok, 8))).alias("inc_case_number"),
        F.lit("STATUS").alias("case_status_code_type"),
        F.when(status == "O", F.lit("O"))
         .when(status == "P", F.when(ok % 2 == 0, F.lit("R")).otherwise(F.lit("N")))
         .when(ok % 3 == 0, F.lit("C"))
         .when(ok % 3 == 1, F.lit("A"))
         .otherwise(F.lit("Z")).alias("case_status_code"),
    )

    def bridge(cond: Column, offset: int) -> DataFrame:
        return orders.filter(cond).select(ok.alias("incident_id"),
                                          (ok + offset).alias("inc_case_id"))

    case_bridge = (bridge(ok % 11 != 0, 1000000)
                   .unionAll(bridge(ok % 4 == 0, 1000001))
                   .unionAll(bridge(ok % 50 == 0, 1000000))
                   .unionAll(bridge(ok % 37 == 0, 9000000)))

    def arrest_block(cond: Column, id_offset: int, num: Column, days: int,
                     person_offset: int) -> DataFrame:
        return orders.filter(cond).select(
            (ok + id_offset).alias("arrest_id"),
            num.alias("arrest_num"),
            _agency(ok).alias("agency_code"),
            _report_number(ok).alias("inc_report_number"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("arrest_date"),
            (F.col("o_custkey") + person_offset).alias("person_id"),
        )

    arrests = arrest_block(ok % 3 == 0, 0, F.concat(F.lit("A"), _pad(ok, 8)), 3, 0).unionAll(
        arrest_block(ok % 15 == 0, 5000000,
                     F.when(ok % 30 != 0, F.concat(F.lit("B"), _pad(ok, 8))), 5, 1))

    ln = F.col("l_linenumber")
    per_id = (lk * 10 + ln).alias("inc_per_id")
    incident_people = lineitem.join(orders, lk == ok).select(
        per_id,
        lk.alias("inc_incident_id"),
        F.when(ln == 7, F.lit(None).cast("long"))
         .when(ln % 2 == 1, F.col("o_custkey"))
         .otherwise(F.col("l_suppkey")).alias("per_person_id"),
        F.lit("REL").alias("relation_code_type"),
        _case(F.col("l_partkey") % 8, RELATION_CODE_BY_REMAINDER).alias("reltn_relation_code"),
        F.when(F.col("l_quantity") < 3, F.lit("A")).alias("suspus_using_code"),
    )
    sk = F.col("l_suppkey")
    incident_person_roles = (
        lineitem.filter(sk % 5 != 4)
        .select(per_id, _case(sk % 5, ROLE_TYPE_BY_REMAINDER).alias("role_type"))
        .unionAll(lineitem.filter(sk % 7 == 0).select(per_id, F.lit("SP").alias("role_type")))
        .unionAll(lineitem.filter(sk % 11 == 0).select(per_id, F.lit("OP").alias("role_type")))
    )
    incident_properties = lineitem.select(
        lk.alias("incsup_incident_id"),
        F.when(ln != 6, F.col("l_extendedprice").cast(MONEY)).alias("value"),
        (F.col("l_partkey") % 9).cast("string").alias("prop_loss_code"),
        (sk % 7).cast("string").alias("status_code"),
    )
    incident_vehicles = lineitem.filter(F.col("l_returnflag") == "R").select(
        lk.alias("incident_id"),
        F.when(sk % 7 != 3, sk).alias("vehicle_id"),
        F.col("l_linestatus").alias("role_code"),
        (ln % 3).cast("string").alias("status_code"),
        F.when(ln % 2 == 0, F.col("l_shipdate")).alias("date_recovered"),
    )
    incident_addresses = orders.select(
        ok.alias("incident_id"), F.col("o_custkey").alias("address_id")).unionAll(
        orders.filter(ok % 5 == 0).select(ok.alias("incident_id"),
                                          (F.col("o_custkey") + 1).alias("address_id")))
    ck, nk = F.col("c_custkey"), F.col("c_nationkey")
    addresses = customer.select(
        ck.alias("address_id"),
        F.when(ck % 13 != 0, (ck % 900 + 100).cast("string")).alias("street_number"),
        F.when(ck % 3 == 1, F.lit("N")).when(ck % 3 == 2, F.lit("S"))
         .alias("dirct_cd_direction_code"),
        F.col("c_mktsegment").alias("street_name"),
        F.when(ck % 4 != 0, F.lit("ST")).alias("street_cd_street_type_code"),
        F.when(ck % 5 == 0, F.concat(F.lit("APT "), (ck % 50).cast("string")))
         .alias("sub_number"),
        F.concat(F.lit("CITY"), nk.cast("string")).alias("city"),
        F.lit("TN").alias("state_cd_state_code"),
        F.lpad((nk + 37000).cast("string"), 5, "0").alias("zip5"),
        F.when(ck % 2 != 0, ck % 10000).alias("zip4"),
    )
    return {
        "incidents": incidents,
        "offenses": offenses,
        "offense_codes": offense_codes,
        "nibrs_offenses": _values(spark, NIBRS_OFFENSES, "offense_code", "nibrs_code"),
        "nibrs_codes": _values(spark, NIBRS_CODES, "nibrs_code", "nibrs_desc"),
        "ejs_codes": _values(spark, EJS_CODES, "code_type", "code", "description"),
        "incident_cases": incident_cases,
        "inc_case_inc_status_vw": case_bridge,
        "arrests": arrests,
        "incident_people": incident_people,
        "incident_person_roles": incident_person_roles,
        "role_codes": _values(spark, ROLE_CODES, "role_type", "role_desc"),
        "incident_properties": incident_properties,
        "incident_vehicles": incident_vehicles,
        "incident_addresses": incident_addresses,
        "addresses": addresses,
    }


# Bump when the derivation or the layout changes, so a written copy is never
# reused stale.
FIXTURE_VERSION = "v6"

# Storage layout of the written relations.
#
# * The incident-keyed relations, incidents included (and the ones keyed by
#   case, person row, address and, for arrests, report), are *bucketed* on that
#   key, as external tables in the shared folder.  Aggregations and joins
#   on the bucket key then need no exchange: the rollups group by incident id
#   straight off the scan, and incidents join the other tables co-located.
# * One task reads a bucket, sorts it for a join or groups it, so its memory
#   follows from the bucket's bytes and the number of tasks from the number of
#   buckets.  That number grows with the input (``bucket_count``).
# * Rows are gathered by bucket before they are written.  Otherwise every task
#   writes a file for every bucket, and the number of files would grow with the
#   square of the input.  A large bucket is written by several tasks (AQE).
# * Within each bucket, incidents are sorted by report date, so every row
#   group covers a date range that the cohort's year filter skips by min/max
#   statistics.
# * The code tables are one file.
BUCKET_BYTES = 8 * 1024 * 1024
LEAST_BUCKETS, MOST_BUCKETS = 8, 65536
# So many relations are written at a time; the last tasks of one job leave cores to the next.
WRITERS = 4
_BUCKET = {
    "incidents": ("incident_id",), "offenses": ("inc_incident_id",), "incident_people": ("inc_incident_id",),
    "incident_properties": ("incsup_incident_id",), "incident_vehicles": ("incident_id",),
    "incident_addresses": ("incident_id",), "inc_case_inc_status_vw": ("incident_id",),
    "incident_person_roles": ("inc_per_id",), "incident_cases": ("inc_case_id",),
    "addresses": ("address_id",), "arrests": ("inc_report_number",),
}
# Sort order within buckets; the others hold their rows as they come, as a bucket is one
# row group or few and joins sort it anyway.
_BUCKET_SORT = {"incidents": ("report_date", "incident_id")}


def _table_name(out_dir: str, name: str) -> str:
    tag = "".join(c if c.isalnum() else "_" for c in out_dir.split("/fixtures/")[-1])
    return f"blotter_{tag}_{name}"


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """A power of two that keeps buckets of the largest input at about ``BUCKET_BYTES``."""
    plan = spark.read.parquet(f"{sf_dir}/lineitem.parquet")._jdf.queryExecution().optimizedPlan()
    n_bytes = int(str(plan.stats().sizeInBytes()))
    n = 1 << max(0, -(-n_bytes // BUCKET_BYTES) - 1).bit_length()
    return min(max(n, LEAST_BUCKETS), MOST_BUCKETS)


def write_fixtures(spark: SparkSession, sf_dir: str, out_dir: str, buckets: int) -> str:
    """Derive the 16 relations and write them as parquet under ``out_dir``."""
    def write(name: str, df: DataFrame) -> None:
        path = out_dir.rstrip("/") + "/" + name
        if name not in _BUCKET:
            df.coalesce(1).write.mode("overwrite").parquet(path)
            return
        key = _BUCKET[name]
        rows = (df.hint("rebalance", buckets, *[F.col(k) for k in key])
                .write.mode("overwrite").option("path", path).bucketBy(buckets, *key))
        if name in _BUCKET_SORT:
            rows = rows.sortBy(*_BUCKET_SORT[name])
        rows.saveAsTable(_table_name(out_dir, name))

    with ThreadPoolExecutor(WRITERS) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(write), name, df)
                   for name, df in derive(spark, sf_dir).items()]
        for job in started:
            job.result()
    return out_dir


def fixture_dir(spark: SparkSession, sf_dir: str, buckets: int) -> str:
    tag = sf_dir.rstrip("/").split("://")[-1].strip("/").replace("/", "_")
    return "/".join([scratch_dir(spark).rstrip("/"), "fixtures",
                     f"{FIXTURE_VERSION}-b{buckets}", tag])


def _bucketed(spark: SparkSession, out: str, name: str, buckets: int) -> DataFrame:
    """Register a written bucketed relation in this session's catalog; read it."""
    path = out + "/" + name
    table = _table_name(out, name)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                     for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet "
              f"CLUSTERED BY ({', '.join(_BUCKET[name])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _written(spark: SparkSession, out: str, buckets: int) -> dict[str, DataFrame] | None:
    """The written relations, or None if any is missing (e.g. an interrupted run).

    A parquet directory only becomes readable once its write job committed, so
    reading all 16 through Spark is the completeness check; it works on any
    file system the cluster uses.
    """
    try:
        return {n: _bucketed(spark, out, n, buckets) if n in _BUCKET
                else spark.read.parquet(out + "/" + n) for n in RELATIONS}
    except AnalysisException:
        return None


def _published(spark: SparkSession, base: str, buckets: int) -> dict[str, DataFrame] | None:
    """Relations of a complete, published fixture set under ``base``, if any."""
    try:
        paths = sorted(r[0] for r in spark.read.parquet(base + "/_published").collect())
    except AnalysisException:
        return None
    for path in paths:
        tables = _written(spark, path, buckets)
        if tables is not None:
            return tables
    return None


def fixture_catalog(spark: SparkSession, sf_dir: str, *, lazy: bool = False, **kw) -> Catalog:
    """Catalog over the derived relations.

    By default they are written once (per scratch directory) and read back as
    stored tables (plain or bucketed parquet), as the real relations would be
    stored; ``lazy=True`` keeps them as unmaterialized derivations instead.

    Each writer writes into its own directory and then publishes it by adding
    its path to a small pointer table, so concurrent first runs never
    overwrite a set another process is reading; readers take any published,
    complete set.
    """
    if lazy:
        return Catalog(derive(spark, sf_dir), **kw)
    buckets = bucket_count(spark, sf_dir)
    base = fixture_dir(spark, sf_dir, buckets)
    tables = _published(spark, base, buckets)
    if tables is None:
        out = base + "/" + uuid.uuid4().hex
        write_fixtures(spark, sf_dir, out, buckets)
        spark.range(1).select(F.lit(out).alias("path")) \
            .write.mode("append").parquet(base + "/_published")
        tables = _written(spark, out, buckets)
    return Catalog(tables, **kw)
