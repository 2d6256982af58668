"""The input catalog: 16 relations as DataFrames, read with the reports' rules.

Two rules apply at read time:

* Only declared columns are read, cast to the declared type, so Catalyst prunes
  every other column out of the scan.
* Blank strings are NULL (the source database treats ``''`` as NULL, and the
  reports' ``IS NOT NULL`` tests, joins and text lists depend on that).

Blank-to-NULL is a projection; a filter written above it cannot reach the
parquet reader any more.  ``table(name, where=...)`` therefore applies the
caller's predicate to the *raw* columns first.  For a predicate comparing a
column to a non-blank literal, or testing a timestamp, raw and normalized
forms select the same rows, so this is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from blotter.functions.joins import row_bytes
from blotter.sources.buckets import HEAVY_BYTES, evened, stored_bytes, tasks_for
from blotter.sources.schemas import LOOKUPS, SCHEMAS

# Largest lookup table we broadcast, in bytes of its rows.  The code tables are
# dimension lists (a few KB in practice); the bound is checked per table, and a
# table beyond it is joined by a normal shuffle join instead.
BROADCAST_MAX_BYTES = 16 * 1024 * 1024
# Largest one that is kept on the driver, as part of the plans that use it.
LOCAL_MAX_BYTES = 1024 * 1024


class Catalog:
    """Holds the raw inputs; hands out pruned, typed, blank-normalized views."""

    def __init__(self, tables: Mapping[str, DataFrame], *,
                 broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
                 heavy_bucket_bytes: int = HEAVY_BYTES) -> None:
        missing = [n for n in SCHEMAS if n not in tables]
        if missing:
            raise KeyError(f"catalog lacks relations: {missing}")
        for name, schema in SCHEMAS.items():
            have = set(tables[name].columns)
            lack = [f.name for f in schema.fields if f.name not in have]
            if lack:
                raise KeyError(f"relation {name} lacks columns {lack}")
        self._raw = dict(tables)
        self._broadcast_max_bytes = broadcast_max_bytes
        self._heavy_bucket_bytes = heavy_bucket_bytes
        self._small: dict[str, DataFrame] = {}
        self._even: dict[str, DataFrame] = {}
        self._tasks: dict[str, int] = {}

    # -- constructors -----------------------------------------------------
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **kw) -> "Catalog":
        """Relations stored as ``<root>/<relation>`` or ``<root>/<relation>.parquet``.

        Paths go through Spark's file system layer, so ``root`` may be any
        URI the cluster reads (HDFS, object stores, local).
        """
        return cls({name: read_parquet_any(spark, root, name) for name in SCHEMAS}, **kw)

    @classmethod
    def from_tables(cls, spark: SparkSession, names: Mapping[str, str] | None = None,
                    **kw) -> "Catalog":
        """Relations registered as tables/views, optionally renamed."""
        names = dict(names or {})
        return cls({n: spark.table(names.get(n, n)) for n in SCHEMAS}, **kw)

    # -- access -----------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self._raw[name]

    def even(self, name: str) -> DataFrame:
        """The raw relation, without its bucketing if that has a heavy bucket."""
        if name not in self._even:
            self._even[name] = evened(self._raw[name], self._heavy_bucket_bytes)
        return self._even[name]

    def tasks(self, name: str) -> int | None:
        """Tasks that the whole relation's rows need in a shuffle, by the bytes of its files.

        None if the session's own number does: adaptive execution then merges or splits them.
        """
        if name not in self._tasks:
            self._tasks[name] = tasks_for(stored_bytes(self._raw[name]))
        own = int(self._raw[name].sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self._tasks[name] if self._tasks[name] > own else None

    def table(self, name: str, where: Column | Callable[[DataFrame], Column] | None = None,
              columns: tuple[str, ...] | None = None, nonblank: tuple[str, ...] = ()) -> DataFrame:
        """Typed, blank-normalized relation; ``where`` runs on raw columns.

        ``nonblank`` columns, which ``where`` already keeps from being blank, are passed
        on as they are, so storage bucketed on them stays usable.
        """
        schema = SCHEMAS[name]
        df = self.even(name)
        fields = [f for f in schema.fields if columns is None or f.name in columns]
        typed = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        if where is not None:
            typed = typed.filter(where(typed) if callable(where) else where)
        return typed.select([_blank_to_null(f.name)
                             if isinstance(f.dataType, StringType) and f.name not in nonblank
                             else F.col(f.name) for f in fields])

    def lookup(self, name: str) -> DataFrame:
        """A code table, broadcast-hinted only when its bytes are bounded."""
        if name not in LOOKUPS:
            raise KeyError(f"{name} is not a lookup relation")
        if name not in self._small:
            self._keep_small({n: self.table(n) for n in LOOKUPS})
        return self._small[name]

    def bounded(self, key: str, df: DataFrame) -> DataFrame:
        """``broadcast(df)`` if ``df``'s rows have at most the bound of bytes, else ``df``.

        Checked once per key and catalog, see ``_keep_small``.
        """
        if key not in self._small:
            self._keep_small({key: df})
        return self._small[key]

    def _keep_small(self, tables: dict[str, DataFrame]) -> None:
        """Measures the tables (the sum of real string lengths) in one job for all of them.

        Those of at most ``LOCAL_MAX_BYTES`` are then collected, in one more job, and
        held as local relations, so no later query scans or joins their parts again.
        Beyond the bound a join stays a shuffle join, which adaptive execution may still
        turn into a broadcast from runtime statistics.
        """
        sizes = reduce(DataFrame.unionByName, [
            df.select(F.lit(k).alias("name"), row_bytes(df.schema).alias("n")) for k, df in tables.items()])
        n_bytes = {r.name: r.n for r in sizes.groupBy("name").agg(F.sum("n").alias("n")).collect()}
        most = min(LOCAL_MAX_BYTES, self._broadcast_max_bytes)
        local = {k: df for k, df in tables.items() if n_bytes.get(k, 0) <= most}
        rows: dict[str, list] = {k: [] for k in local}
        if local:
            # Under each other, each table's rows in a column of its own.
            under = [df.select(*[(F.struct(*[F.col(f"`{c}`") for c in df.columns]) if other == k else F.lit(None))
                                 .cast(other_df.schema).alias(f"t{i}") for i, (other, other_df) in enumerate(local.items())],
                               F.lit(k).alias("name")) for k, df in local.items()]
            for r in reduce(DataFrame.unionByName, under).collect():
                rows[r["name"]].append(r[list(local).index(r["name"])])
        for k, df in tables.items():
            if k in local:
                self._small[k] = F.broadcast(df.sparkSession.createDataFrame(rows[k], df.schema))
            else:
                self._small[k] = F.broadcast(df) if n_bytes[k] <= self._broadcast_max_bytes else df


def read_parquet_any(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>``, else ``<root>/<name>.parquet``; raises if neither exists."""
    base = root.rstrip("/") + "/" + name
    try:
        return spark.read.parquet(base)
    except AnalysisException:
        return spark.read.parquet(base + ".parquet")


def _blank_to_null(name: str) -> Column:
    c = F.col(name)
    return F.when(c != F.lit(""), c).alias(name)
