"""Bloom filters over join keys, from built-in functions only.

A cohort beyond the broadcast budget restricts a rollup table by a shuffle join,
so the whole table would be exchanged to find the few rows that match.  A filter
of the cohort's keys is far smaller than the keys: a bitmap, kept as rows of
32,768 bits, in which every key sets the bits of ``HASHES`` hashes.  It is built
by one aggregation (map-side combined, a row a bitmap part), and each row of the
table looks its bits up in the broadcast bitmap before the exchange.

A filter only ever lets too many rows pass; the semi join that follows decides.
It has ``BITS`` bits a key, fewer where the broadcast budget would be exceeded, and
there is none below ``LEAST_BITS``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import joins

#: Bits a key, at most and at least, and hashes a key.
BITS, LEAST_BITS, HASHES = 16, 4, 2
#: Bits of one row of the bitmap (fixed by Spark's bitmap functions), and its bytes with the row around it.
PART_BITS, PART_BYTES = 32768, 4096 + 64


class KeyFilter(NamedTuple):
    """``bits``: part number and bitmap; ``size``: the number of bits in all."""

    bits: DataFrame
    size: int


def _places(cols: list[Column], size: int) -> list[Column]:
    """The bit that each hash of the key sets, from 1 (as the bitmap functions count)."""
    return [F.pmod(F.xxhash64(F.lit(k), *cols), F.lit(size)) + 1 for k in range(HASHES)]


def filter_bits(n_keys: int) -> int:
    """Bits of the filter of so many keys, whole parts within the broadcast budget; 0: too few to be of use."""
    most = joins.COHORT_BROADCAST_MAX_BYTES // PART_BYTES
    parts = min(-(-n_keys * BITS // PART_BITS), most)
    return parts * PART_BITS if parts * PART_BITS >= n_keys * LEAST_BITS else 0


def key_filter(keys: DataFrame, cols: list[str], n_keys: int) -> KeyFilter | None:
    """The filter of the keys in ``cols`` (``n_keys`` rows at most); keys that hold a NULL match nothing and set no bit."""
    size = filter_bits(n_keys)
    if not size:
        return None
    known = keys.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))
    places = known.select(F.explode(F.array(*_places([F.col(c) for c in cols], size))).alias("at"))
    bits = (places.groupBy(F.bitmap_bucket_number("at").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    return KeyFilter(bits, size)


def _is_set(bits: Column, at: Column) -> Column:
    """Whether the bitmap's bit at a position is set; a part without bits is NULL."""
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def may_match(df: DataFrame, cols: list[str], keys: KeyFilter | None) -> DataFrame:
    """The rows of ``df`` whose key in ``cols`` may be one of the filter's; all rows without a filter."""
    if keys is None:
        return df
    out, names = df, df.columns
    for k, at in enumerate(_places([F.col(c) for c in cols], keys.size)):
        part = keys.bits.select(F.col("part").alias(f"_part{k}"), F.col("bits").alias(f"_bits{k}"))
        out = out.join(F.broadcast(part), F.bitmap_bucket_number(at) == F.col(f"_part{k}"))
        out = out.where(_is_set(F.col(f"_bits{k}"), at)).select(*names)
    return out
