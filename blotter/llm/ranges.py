"""Ranges of near-equal bytes over integer keys (helper).

``cut_keys`` finds where to cut: the keys are range-sorted by Spark, every task
adds up the sizes of its rows and hands in a mark (a key, and the bytes since the
mark before) each time a small share of a range is full, and the marks, a few a
range, are put together.  So ranges follow the real bytes, whatever the keys'
distances.  Rows with equal keys stay in one range.  Nulls sort first.

``range_of`` numbers the range of a row's keys; it sees the keys only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

#: Marks a range.
MARKS = 4
#: Bytes in a range: at most, and at least.
MOST, LEAST = 128 << 20, 1 << 16

MARK = StructType().add("part", IntegerType()).add("i", LongType()).add("key", ArrayType(LongType())).add("n", LongType())


def coded(values: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Byte strings that sort as the keys do, nulls first."""
    cols = []
    for v, k in zip(values, known):
        cols.append(k.astype(np.uint8)[:, None])
        bits = np.where(k, v, 0).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        cols.append(bits.astype(">u8").view(np.uint8).reshape(-1, 8))
    flat = np.ascontiguousarray(np.concatenate(cols, axis=1))
    return flat.view(f"S{flat.shape[1]}").reshape(-1)


def _flat(rows: DataFrame, keys: list[str], size: str) -> tuple[DataFrame, list[Column]]:
    names = [f"k{i}" for i in range(len(keys))]
    flat = rows.select(*[F.col(k).cast("long").alias(n) for k, n in zip(keys, names)],
                       F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    return flat, [F.col(n).asc_nulls_first() for n in names]


def _marks(flat: DataFrame, order: list[Column], each: int) -> list[Row]:
    """In order: keys some ``each`` apart, and the sizes from each of them to the next."""
    schema = to_arrow_schema(MARK)

    def mark(batches):
        part, i, held, first, last = TaskContext.get().partitionId(), 0, 0, None, None
        for batch in batches:
            for *key, n in zip(*(c.to_pylist() for c in batch.columns)):
                if first is None:
                    first = key
                elif held >= each and key != last:
                    yield pa.RecordBatch.from_pylist([{"part": part, "i": i, "key": first, "n": held}], schema)
                    i, held, first = i + 1, 0, key
                held, last = held + n, key
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "i": i, "key": first, "n": held}], schema)

    marks = flat.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(mark, MARK).collect()
    return sorted(marks, key=lambda m: (m.part, m.i))


def cut_keys(rows: DataFrame, keys: list[str], size: str, step: int) -> list[list[int | None]]:
    """The first key of every range but the first; a range has about ``step`` of ``size``.

    Where exactly it cuts depends on how Spark deals the rows out; see ``exact_cuts``.
    """
    flat, order = _flat(rows, keys, size)
    cuts, held = [], 0
    for m in _marks(flat, order, max(1, step // MARKS)):
        if held and held + m.n > step:
            cuts.append(list(m.key))
            held = 0
        held += m.n
    return cuts


def exact_cuts(rows: DataFrame, keys: list[str], size: str, step: int) -> list[list[int | None]]:
    """Like ``cut_keys``, but a function of the rows alone.

    A range begins at the first key below which a further multiple of ``step`` lies.
    The marks tell between which two of them that is; only the rows there are
    looked at again, one stretch a group, in order.
    """
    flat, order = _flat(rows, keys, size)
    marks = _marks(flat, order, max(1, step // MARKS))
    below = np.concatenate(([0], np.cumsum([m.n for m in marks], dtype=np.int64))).tolist()
    open_at = {i: b for i, (b, e) in enumerate(zip(below, below[1:])) if b // step != e // step}
    if not open_at:
        return []
    stretch = range_of([list(m.key) for m in marks[1:]], *[c for c in flat.columns if c != "n"]).alias("stretch")
    inside = flat.select("*", stretch).where(F.col("stretch").isin(*open_at) if len(open_at) <= 200 else F.lit(True))
    schema = to_arrow_schema(MARK)

    def find(batches):
        at, last, held = None, None, 0
        for batch in batches:
            for *key, n, i in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in open_at:
                    continue
                if i != at:
                    at, last, held = i, key, open_at[i]
                elif key != last:
                    # ``held``: everything below this key; ``first``: what lay below the key before.
                    if held // step != first // step:
                        yield pa.RecordBatch.from_pylist([{"part": i, "i": held, "key": key, "n": n}], schema)
                    last = key
                else:
                    held += n
                    continue
                first, held = held, held + n

    found = (inside.repartition("stretch").sortWithinPartitions("stretch", *order).mapInArrow(find, MARK).collect())
    cuts = {(m.part, m.i): list(m.key) for m in found}
    for i in open_at:
        # A multiple that only the stretch's last key passes: the next stretch begins the range.
        last = max((b for part, b in cuts if part == i), default=below[i])
        if last // step != below[i + 1] // step and i + 1 < len(marks):
            cuts[i + 1, below[i + 1]] = list(marks[i + 1].key)
    return [cuts[k] for k in sorted(cuts)]


def range_bytes(rows: DataFrame, size: str) -> int:
    """About one range a shuffle partition, within the bounds."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return min(MOST, max(LEAST, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def range_of(cuts: list[list[int | None]], *keys: str | Column) -> Column:
    """The number of the range that holds a row's keys: how many cuts are not above them."""
    if not cuts:
        return F.lit(0)
    columns = list(zip(*cuts))
    borders = coded([np.array([x or 0 for x in c], np.int64) for c in columns],
                    [np.array([x is not None for x in c]) for c in columns])

    @pandas_udf(IntegerType())
    def find(*cols: pd.Series) -> pd.Series:
        own = coded([c.to_numpy() for c in cols[::2]], [c.to_numpy() for c in cols[1::2]])
        return pd.Series(np.searchsorted(borders, own, side="right").astype(np.int32))

    args = []
    for k in keys:
        k = F.col(k) if isinstance(k, str) else k
        args += [F.coalesce(k.cast("long"), F.lit(0).cast("long")), k.isNotNull()]
    return find(*args)
