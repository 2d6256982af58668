"""Join helpers, and the size check behind every broadcast of cohort data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Largest cohort-derived relation (cohort incidents, keys, first hops) that is
# broadcast, in bytes of its actual row data (strings measured, not guessed).
COHORT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024

_FIXED = {ByteType: 1, BooleanType: 1, ShortType: 2, IntegerType: 4, DateType: 4,
          FloatType: 4, LongType: 8, DoubleType: 8, TimestampType: 8, TimestampNTZType: 8,
          DecimalType: 16}
_FIELD = 8  # slot of a field in a row


def row_bytes(schema: StructType) -> Column:
    """Bytes of a row of ``schema``: fixed widths plus the real length of strings and binaries.

    Fields of other types (arrays, structs) count as their text.
    """
    fixed = sum(_FIELD + _FIXED.get(type(f.dataType), 0) for f in schema.fields)
    total = F.lit(fixed).cast("long")
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType | BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif type(f.dataType) not in _FIXED:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: one job without a shuffle, nothing else leaves the executors."""
    seen = Observation()
    (df.observe(seen, F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("bytes"))
     .write.format("noop").mode("overwrite").save())
    return int(seen.get["bytes"])


def semi(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (a left semi join)."""
    return df.join(keys, on=on, how="left_semi")


def within_span(df: DataFrame, col: str, span) -> DataFrame:
    """Rows of ``df`` whose id lies in ``span`` (a ``Span`` or None: no limit).

    A necessary condition of the join or semi join that follows, in a form that
    reaches the scan: row groups whose minimum and maximum lie outside are skipped,
    and for a short list of ids, buckets too.
    """
    if span is None:
        return df
    if span.ids is not None:
        return df.filter(F.col(col).isin(*span.ids))
    return df.filter((F.col(col) >= F.lit(span.low)) & (F.col(col) <= F.lit(span.high)))


def within_bound(n_bytes: int) -> bool:
    """Whether so many bytes of rows fit the broadcast budget."""
    return n_bytes <= COHORT_BROADCAST_MAX_BYTES


def broadcast_if_bounded(df: DataFrame, proof: int | None = None) -> DataFrame:
    """``broadcast(df)`` when ``df`` fits the budget, else ``df`` unhinted.

    ``proof`` is a known byte count at least as large as ``df``'s (e.g. of the
    materialized rows a distinct key set was taken from); without it the rows
    are measured.  Beyond the budget joins against ``df`` stay shuffle joins.
    """
    return F.broadcast(df) if within_bound(measured_bytes(df) if proof is None else proof) else df
