"""Benchmark decontamination (operator 9).

The test phrases (windows of 13 consecutive item words; a shorter item is one
window) are searched in the documents through an FM-index per shard:

1. A shard is a slice of a task's documents (bounded bytes).  Words outside
   the benchmark's vocabulary, and pairs of neighbours that no item holds, cannot
   be inside a window, so they cut the shard's text into segments; segments
   shorter than the shortest window are left out of the index.  This loses
   nothing.
2. The FM-index of the remaining word sequence is built (suffix array, BWT,
   wavelet matrix), and all phrases go through backward search together.
3. Occurrences are located by sampled suffix positions and merged to disjoint
   word spans per document.

The benchmark is the stated query set.  It is split into blocks of at most
``BLOCK_BYTES`` of text; each block is sent to the tasks and is one pass over
the documents, so nothing of unchecked size is broadcast.

Defined cases: a null or empty text has no words and no hits; a null or empty
item has no window; items that repeat an id count once; a null item_id takes
part in hits and counts as the id ``null``.  Null doc_ids and repeated rows
are ordinary rows.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from blotter.llm.common import field, map_rows, pick, raw, with_row
from blotter.llm.fm_index import FMIndex

WINDOW = 13
#: Most benchmark text that one pass holds.
BLOCK_BYTES = 8 << 20

#: Bytes of words: digits, letters and all of non-ASCII text; A-Z become a-z, the rest separate.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Phrases:
    """One block of the benchmark: vocabulary, neighbour pairs, and the windows with their items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            pairs.update(zip(seq, seq[1:]))
            for i in range(max(1, len(seq) - WINDOW + 1) if seq else 0):
                windows.setdefault(tuple(seq[i:i + WINDOW]), set()).add(item)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.table = np.zeros((len(windows), WINDOW), np.int64)
        for row, w in enumerate(windows):
            self.table[row, WINDOW - len(w):] = w
        self.items = [sorted(x) for x in windows.values()]
        self.shortest = int(self.length.min()) if windows else 0
        self.base = len(self.ids) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)

    def segments(self, seq: np.ndarray, first_of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches of ``seq`` that may hold a window."""
        n = len(seq)
        known = seq > 0
        joined = np.zeros(n, bool)  # to the word before
        if n > 1:
            both = np.flatnonzero(known[1:] & known[:-1]) + 1
            code = seq[both - 1] * self.base + seq[both]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            if len(self.pairs):
                joined[both[self.pairs[at] == code]] = True
        joined[first_of_doc[first_of_doc < n]] = False
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        keep = ends - starts >= self.shortest
        return starts[keep], ends[keep]

    def find(self, seq: np.ndarray, first_of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence of a window in ``seq``."""
        none = np.zeros(0, np.int64)
        starts, ends = self.segments(seq, first_of_doc) if self.shortest else (none, none)
        if not len(starts):
            return none, none
        size = ends - starts + 1
        shard = np.ones(int(size.sum()), np.int64)  # 1 separates the segments
        into = np.cumsum(size) - size
        inside = np.arange(len(shard)) - np.repeat(into, size)
        word = inside < np.repeat(size - 1, size)
        place = np.repeat(starts, size) + inside
        # Only the symbols that occur: the wavelet matrix is as deep as the shard needs.
        used, shard[word] = np.unique(seq[place[word]], return_inverse=True)
        shard[word] += 2
        code = np.zeros(self.base, np.int64)
        code[used] = np.arange(len(used)) + 2
        index = FMIndex(shard)
        lo, hi = index.search(code[self.table], self.length)
        found = hi - lo
        which = np.repeat(np.arange(len(found)), found)
        rows = np.repeat(lo, found) + np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found)
        return place[index.locate(rows)] if len(rows) else none, which


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


SPANS = ArrayType(ArrayType(LongType()))
FOUND = StructType([field("n_words", LongType()), field("spans", SPANS), field("items", ArrayType(StringType()))])


def _locate(df: DataFrame, phrases: Phrases) -> DataFrame:
    """One pass: adds this block's spans and items to those found before."""

    def make():
        get = phrases.ids.get

        def compute(batch):
            data, border = raw(batch.column("text"))
            data = data.translate(WORD_BYTES)
            seq: list[int] = []
            starts = [0]
            for a, b in zip(border, border[1:]):
                seq += [get(w, 0) for w in data[a:b].split()]
                starts.append(len(seq))
            first = np.array(starts, np.int64)
            at, which = phrases.find(np.array(seq, np.int64), first)
            spans = batch.column("spans").to_pylist()
            items = [set(x) for x in batch.column("items").to_pylist()]
            doc = np.searchsorted(first, at, side="right") - 1
            for d, p, w in zip(doc.tolist(), (at - first[doc]).tolist(), which.tolist()):
                spans[d].append([p, p + int(phrases.length[w])])
                items[d].update(phrases.items[w])
            return [np.diff(first), [merged(x) for x in spans], [sorted(x) for x in items]]

        return compute

    return map_rows(df, FOUND, "text", make, keep=("row", "text"))


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of at most about ``block_bytes`` of text, one at a time on the driver."""
    items = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(1.25 * size) // block_bytes
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield Phrases([(r.item, r.text.encode()) for r in part.toLocalIterator()])


def locate_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", carry: list[str] | None = None,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``row`` (the carried columns), n_words, spans (merged removal
    spans of word positions) and items (ids of items with occurring windows)."""
    df = with_row(docs, carry, text=text_col)
    df = df.select("row", "text", F.lit(0).cast("long").alias("n_words"),
                   F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for phrases in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        df = _locate(df, phrases)
    return df.drop("text")


def contamination(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least one word in twenty is hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return (found.withColumn("n_hit", n_hit)
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
            .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")))
