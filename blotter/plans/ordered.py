"""Ordered sink: a sorted result in files, with a manifest of the order.

A DataFrame's order is lost once it is written.  Here each row gets its place in
the order (range partition, then row), the rows are written as parquet, one file
or more a range, and a manifest keeps for every file its rows, its first and last
place and the sort keys there.  Reading checks the files against the manifest
and brings the rows back in their order, by sorting on the place alone; nulls and
ties come as they were written.  The manifest has a row a file; rows stay in Spark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "_place"


class DamagedOrder(RuntimeError):
    """Files and manifest of an ordered result do not agree."""


def _files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest: a row a file."""
    at = F.struct(*keys)
    return rows.withColumn("file", F.col("_metadata.file_name")).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(PLACE).alias("first_place"), F.max(PLACE).alias("last_place"),
        F.to_json(F.min_by(at, PLACE)).alias("first_key"), F.to_json(F.max_by(at, PLACE)).alias("last_key"))


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes ``df``, sorted by ``keys`` (ascending, NULLs last), to a new folder."""
    if PLACE in df.columns:
        raise ValueError(f"a column is named {PLACE}")
    placed = (df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
              .withColumn(PLACE, F.monotonically_increasing_id()))
    placed.write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    manifest = _files(rows, keys).withColumn("keys", F.array(*[F.lit(k) for k in keys]))
    # The manifest comes last: without it, the folder is no result.
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows in their order; raises ``DamagedOrder`` if files are missing, changed or out of order."""
    try:
        told = spark.read.parquet(f"{path}/manifest").collect()  # a row a file
    except AnalysisException as e:
        raise DamagedOrder(f"{path} has no manifest") from e
    rows = spark.read.parquet(f"{path}/rows")
    keys = list(told[0]["keys"]) if told else []
    found = {r.file: r for r in _files(rows, keys).collect()} if told else {}
    for t in told:
        f = found.pop(t.file, None)
        if f is None:
            raise DamagedOrder(f"{path}: {t.file} is missing")
        if any(f[c] != t[c] for c in ("n_rows", "first_place", "last_place", "first_key", "last_key")):
            raise DamagedOrder(f"{path}: {t.file} is not what the manifest says")
    if found or not told and not rows.isEmpty():
        raise DamagedOrder(f"{path}: {sorted(found)} are not in the manifest")
    steps = sorted(told, key=lambda t: t.first_place)
    if any(a.last_place >= b.first_place for a, b in zip(steps, steps[1:])):
        raise DamagedOrder(f"{path}: files overlap in their order")
    return rows.orderBy(PLACE).drop(PLACE)
