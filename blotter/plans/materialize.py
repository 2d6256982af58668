"""Materializing a shared intermediate (the cohort) once per report.

A report joins half a dozen rollups to its cohort and restricts each rollup to
the cohort's incidents, so the cohort appears in the plan many times.  It is
written once, as a parquet table in the cluster's shared folder named by
``spark.checkpoint.dir``, and read back:

* the lineage of every later stage starts at that table, so a lost executor
  costs a re-read, not a recomputation of the scans and joins behind it;
* the planner sizes the re-read table from its real file size.  (A
  ``Dataset.checkpoint()`` would keep the *estimate* of the plan that produced
  it, which is the size of the whole scanned table, so a small cohort would
  never be broadcast.)

The folder must be shared: with a non-local master an unset
``spark.checkpoint.dir`` is an error, and the re-read row count must equal the
written one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blotter.functions.joins import row_bytes


class Size(NamedTuple):
    rows: int
    bytes: int


class Span(NamedTuple):
    """The ids of a written table: least and greatest, and all of them where they are few."""

    low: int
    high: int
    ids: tuple[int, ...] | None = None


class IncompleteWrite(RuntimeError):
    """A written intermediate does not read back as a whole."""


_RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local`` or ``local[n]``)."""
    return spark.conf.get("spark.master", "").split("[")[0] == "local"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Unset, a local session (tests) gets a temporary one, removed at exit; on a
    cluster that would be a machine-local folder, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="blotter-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, d, True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def new_run_folder(spark: SparkSession) -> str:
    app = spark.conf.get("spark.app.id", None) or "app"
    return "/".join([scratch_dir(spark).rstrip("/"), "materialized", app, f"run-{uuid.uuid4().hex}"])


@contextmanager
def writing_to(folder: str) -> Iterator[None]:
    """Tables materialized inside go to ``folder``, whose owner drops it."""
    token = _RUN_FOLDER.set(folder)
    try:
        yield
    finally:
        _RUN_FOLDER.reset(token)


def _write(df: DataFrame, measure: Column, rebalance: bool, verify: bool | None,
           **more: Column) -> tuple[DataFrame, Size, dict]:
    """Write ``df`` as parquet under the shared folder now, and read it back.

    Row count, ``measure`` and the aggregates ``more`` are observed by the write job
    itself (``DataFrame.observe``), so they cost no extra job.  ``rebalance`` evens out the files (a map-side join would leave one per scan
    task; rows that end in a shuffle need it not).  ``verify`` compares the re-read row count with the written one; by
    default where the folder could be machine-local, i.e. on any cluster.
    """
    spark = df.sparkSession
    folder = _RUN_FOLDER.get()
    if folder is None:
        # One folder per application, so a finished run's tables can be dropped together.
        app = spark.conf.get("spark.app.id", None) or "app"
        folder = "/".join([scratch_dir(spark).rstrip("/"), "materialized", app])
    path = f"{folder}/{uuid.uuid4().hex}"
    out = df.hint("rebalance") if rebalance else df
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("rows"),
                F.coalesce(F.sum(measure), F.lit(0)).alias("bytes"),
                *[c.alias(k) for k, c in more.items()]).write.parquet(path)
    size = Size(int(seen.get["rows"]), int(seen.get["bytes"]))
    # The schema is known: reading with it skips the footer-reading inference job.
    again = spark.read.schema(df.schema).parquet(path)
    if not is_local(spark) if verify is None else verify:
        check_rows(again, size.rows, path)
    return again, size, {k: seen.get[k] for k in more}


def check_rows(df: DataFrame, rows: int, path: str) -> None:
    found = df.count()
    if found != rows:
        raise IncompleteWrite(f"{path}: {rows} rows were written, {found} are read; is the folder shared?")


def materialize_sized(df: DataFrame, *, rebalance: bool = True,
                      verify: bool | None = None) -> tuple[DataFrame, Size]:
    """The re-read table and its size in rows and bytes."""
    return _write(df, row_bytes(df.schema), rebalance, verify)[:2]


#: So many ids at most are listed in a filter; the parquet reader and bucket pruning use lists of this length.
FEW_IDS = 10


def materialize_spanned(df: DataFrame, col: str) -> tuple[DataFrame, Size, Span | None]:
    """``materialize_sized`` and the span of the integer column ``col`` (None: no value)."""
    again, size, seen = _write(df, row_bytes(df.schema), False, None, low=F.min(col), high=F.max(col))
    if seen["low"] is None:
        return again, size, None
    ids = None
    if size.rows <= FEW_IDS:
        ids = tuple(sorted({r[0] for r in again.select(col).collect() if r[0] is not None}))
    return again, size, Span(seen["low"], seen["high"], ids)


def materialize(df: DataFrame, *, rebalance: bool = True, verify: bool | None = None) -> DataFrame:
    """The re-read table."""
    return _write(df, F.lit(0), rebalance, verify)[0]
