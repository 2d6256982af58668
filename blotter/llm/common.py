"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from blotter.plans.materialize import materialize

#: Text bytes that a worker handles at once; only a memory bound, results do not depend on it.
BATCH_BYTES = 4 << 20


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Columns of ``df`` under new names, found by exact name and position.

    Positions make it immune to extra columns whose names differ only in case
    or clash with the operators' own names.
    """
    names = df.columns
    tmp = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return tmp.select(*[F.col(f"_c{names.index(src)}").alias(dst) for dst, src in cols.items()])


def with_row(df: DataFrame, carry: list[str] | None, **cols: str) -> DataFrame:
    """``pick`` plus a struct column ``row`` of the carried columns (None: all of them)."""
    names = df.columns
    carry = names if carry is None else carry
    tmp = df.toDF(*[f"_c{i}" for i in range(len(names))])
    row = F.struct(*[F.col(f"_c{names.index(c)}").alias(c) for c in carry])
    return tmp.select(row.alias("row"), *[F.col(f"_c{names.index(src)}").alias(dst) for dst, src in cols.items()])


def pieces(batch: pa.RecordBatch, col: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes in ``col`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw(column: pa.Array) -> tuple[bytes, list[int]]:
    """The bytes of a string or binary column, concatenated, and the row borders; null is empty."""
    col = column.cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    border = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return b"".join(x for x in col.to_pylist() if x), border.tolist()


def map_rows(df: DataFrame, new: StructType, text: str,
             make: Callable[[], Callable[[pa.RecordBatch], list]], keep: tuple[str, ...] = ("row",)) -> DataFrame:
    """``df``'s ``keep`` columns plus new ones that a task computes from slices of Arrow batches.

    ``make`` is called once a task and returns a function from a slice (of
    bounded bytes in column ``text``) to one list or array per field of ``new``.
    """
    out = StructType([df.schema[k] for k in keep] + new.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(new)
        compute = make()
        for batch in batches:
            for part in pieces(batch, text):
                cols = compute(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keep]
                    + [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)],
                    names=[*keep, *schema.names])

    return df.select(*dict.fromkeys([*keep, *df.columns])).mapInArrow(run, out)


def expand_rows(df: DataFrame, out: StructType, text: str,
                make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Like ``map_rows``, but a slice may give any number of rows and none of ``df``'s columns stay."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(out)
        compute = make()
        for batch in batches:
            for part in pieces(batch, text):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                        for c, f in zip(compute(part), schema)]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, out)


def field(name: str, kind) -> StructField:
    return StructField(name, kind, True)


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later stages restart from the files."""
    return materialize(df, rebalance=False)
