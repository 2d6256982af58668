"""Repeated windows: anchors, candidates and packed strings (used by operators 3 and 4).

A window is ``length`` consecutive units (bytes or words) of one document.  Its
anchor is the gram (``gram`` units) with the smallest hash in it, the leftmost of
equal ones; equal windows have equal anchors at equal places.  Consecutive
windows that share an anchor form a run, which travels as one packed string to
the bucket of its anchor's hash.

Only windows whose anchor's hash occurs again can repeat.  So the hashes are
counted first (8 bytes a run, pre-aggregated), and only runs with a repeated hash
are packed.  Hashes select candidates; equality is decided on the packed strings
themselves, but for the windows of hot buckets, which their operators compare by
128-bit digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from blotter.llm.common import cut, expand_rows, field, map_rows, pick

#: Units that are hashed at once.
SEGMENT = 1 << 18
PLACE_BITS = 20
#: A run's place: start * RUN + number of windows.
RUN = 1 << 16
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
FACTOR = 0x5851F42D4C957F2D


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every gram; ``gram`` is a power of two (built by doubling)."""
    h, size, factor = units, 1, FACTOR
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by minima from the borders of blocks of ``w``."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def runs(units: np.ndarray, border: np.ndarray, length: int, gram: int):
    """(hash, document, start, windows) of every run; ``units`` holds all documents, cut at ``border``."""
    out = []
    w = length - gram + 1
    for a in range(0, len(units) - length + 1, SEGMENT):
        part = units[a:a + SEGMENT + length - 1]
        if part.dtype == np.uint8:
            part = BYTE_HASH[part]
        h = gram_hashes(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = sliding_min((h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, w)
        anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        n = len(anchor)
        # The document of each start, and whether its window ends in it.
        first = int(np.searchsorted(border, a, side="right")) - 1
        last = int(np.searchsorted(border, a + n, side="left"))
        ends = np.minimum(border[first + 1:last + 1], a + n) - a
        doc = np.repeat(np.arange(first, last), np.diff(np.concatenate(([0], ends))))
        start = np.arange(a, a + n)
        ok = start + length <= border[doc + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        head, size = head[ok[head]], size[ok[head]]
        out.append((h[anchor[head]].view(np.int64), doc[head], start[head] - border[doc[head]], size))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


HASHES = StructType([field("h", LongType()), field("key", LongType()), field("id", LongType()), field("n", LongType())])
PLACES = ArrayType(StructType([field("place", LongType()), field("h", LongType())]))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty), id (null: after all others), digest and key (of id and text)."""
    df = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return (df.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
            .withColumn("digest", F.xxhash64("text"))
            .withColumn("key", F.xxhash64("id", "text")))


def candidates(df: DataFrame, find, repeats: Column) -> DataFrame:
    """id, digest, text and the runs whose anchor's hash repeats, for documents that have any.

    ``find`` makes a function from a slice's texts to ``runs``; ``repeats`` is the
    condition on a hash's group, over n, low and high (its smallest and largest id).
    A document counts a hash once, with its number, so a line that it repeats
    over and over is one row.
    """
    def make():
        found = find()

        def compute(batch):
            h, doc, _, _ = found(batch.column("text"))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[:len(h)])
            keys, ids = (batch.column(c).to_numpy()[doc[head]] for c in ("key", "id"))
            return [h[head], keys, ids, np.diff(np.append(head, len(h)))]

        return compute

    rows = expand_rows(df.select("key", "id", "text"), HASHES, "text", make)
    again = (rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
             .where(repeats).select("h"))
    # Written, so that the join has two plain shuffles and a hot hash can be split over tasks.
    again = cut(again)
    lists = rows.select("h", "key").join(again, "h").groupBy("key").agg(F.collect_set("h").alias("hashes"))
    texts = df.select("key", "id", "digest", "text").join(lists, "key")

    def make_places():
        found = find()

        def compute(batch):
            h, doc, start, size = found(batch.column("text"))
            own = batch.column("hashes")
            known, of = own.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            # Of document and hash one number; should two fall together, there is one candidate more.
            keep = np.isin(mixed(h.view(np.uint64) + mixed(doc.astype(np.uint64))),
                           mixed(known.view(np.uint64) + mixed(of.astype(np.uint64))))
            h, doc, place = h[keep], doc[keep], (start * RUN + size)[keep]
            border = np.searchsorted(doc, np.arange(len(own) + 1))
            rows = pa.StructArray.from_arrays([pa.array(place), pa.array(h)], names=["place", "h"])
            return [pa.ListArray.from_arrays(pa.array(border, pa.int32()), rows)]

        return compute

    return cut(map_rows(texts, StructType([field("runs", PLACES)]), "text", make_places, keep=("id", "digest", "text")))
