"""Suffix-array dedup (operator 3): 200-byte strings that start anywhere else go.

1. Start positions that cannot repeat are left out, and the others travel as
   packed strings to the bucket of their anchor (``anchors``).  Equal strings are
   merged with a count before a bucket is gathered.
2. In a bucket the strings form one text.  Its suffix array is built blockwise:
   ranks of the suffixes at the positions of a difference cover (a perfect
   difference set modulo 31) are computed first; then the suffixes are
   sorted one bucket of leading symbols at a time, by their first 35 symbols, and
   longer ties are resolved by the precomputed ranks: for any two positions the
   cover holds an equal shift of both within 31 symbols.  A block of suffixes is
   all that is in memory at once besides the text and the ranks.
3. Neighbours in the suffix array that share 200 bytes mark their starts as
   repeated; so does a count of two or more.
4. Repeated starts go back to the documents, where the bytes they cover go.

Hot buckets: one that holds more than ``MOST`` different strings (a common
passage between ever different neighbours) is not gathered.  Its windows are
counted one by one, keyed by a 128-bit digest of the window, pre-aggregated.

Defined cases: null text is empty; texts under 200 bytes keep all; rows that
repeat are copies of each other (all their windows go); null ids are ordinary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from blotter.llm.anchors import RUN, candidates, keyed, runs
from blotter.llm.common import cut, expand_rows, field, map_rows, raw

LENGTH = 200
GRAM = 64
#: Most strings of one bucket that are gathered, and most bytes of a sorted text.
MOST = 4000
TEXT_BYTES = 1 << 20
#: Suffixes sorted at once.
BLOCK = 1 << 18

# A perfect difference set.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Symbols to a word of 9 bits each, and words of the sorted prefix.
PACK, PREFIX = 7, 5


def shifts() -> np.ndarray:
    """For two residues the least shift that brings both into the cover."""
    table = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        into = [(c - d) % PERIOD for c in COVER]
        table[np.ix_(into, into)] = d
    return table


SHIFT = shifts()


class SuffixText:
    """Strings in one text (a symbol is a byte + 1; 0 ends a string), with cover ranks."""

    def __init__(self, strings: list[bytes], depth: int):
        joined = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.size + 1) - self.size - 1
        n = self.n = len(joined)
        symbols = np.zeros(n + 2 * depth + 4 * PERIOD, np.int64)
        symbols[:n] = joined.astype(np.int64) + 1
        symbols[self.first + self.size] = 0
        # words[i]: the symbols i .. i + 6 in one number.
        words = np.zeros(len(symbols) - PACK, np.int64)
        for k in range(PACK):
            words = (words << 9) | symbols[k:k + len(words)]
        self.words = words
        self.depth = depth
        self._rank_cover()

    def prefixes(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.words[at + PACK * k] for k in range(PREFIX)]

    @staticmethod
    def ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Order by ``keys`` and, in that order, whether each differs from the one before."""
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        return order, new

    def _rank_cover(self) -> None:
        at = np.arange(self.n + PERIOD)
        at = at[np.isin(at % PERIOD, COVER)]
        index = np.full(self.n + 2 * PERIOD + self.depth * 2, -1, np.int64)
        index[at] = np.arange(len(at))
        order, new = self.ordered(self.prefixes(at))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        step = PERIOD
        while step < self.depth + PERIOD and rank.max() < len(at):
            later = index[np.minimum(at + step, len(index) - 1)]
            order, new = self.ordered([rank, np.where(later < 0, 0, rank[later])])
            rank[order] = np.cumsum(new)
            step *= 2
        self.rank = np.zeros(len(index), np.int64)  # by position
        self.rank[at] = rank

    def sort_ties(self, order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Sorts the runs of equal prefixes in ``order`` by cover ranks: three-way quicksort of all runs together."""
        group = np.cumsum(new) - 1
        live = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else np.zeros(0, np.int64)
        while len(live):
            g = group[live]
            head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            size = np.diff(np.append(head, len(live)))
            pivot = np.repeat(order[live[head + size // 2]], size)
            mine = order[live]
            d = SHIFT[mine % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[mine + d] - self.rank[pivot + d])
            moved = np.argsort(np.repeat(np.arange(len(head)), size) * 3 + side + 1, kind="stable")
            order[live] = mine[moved]
            part = (np.repeat(np.arange(len(head)), size) * 3 + side + 1)[moved]
            start = np.concatenate(([True], part[1:] != part[:-1]))
            number = np.cumsum(start) - 1
            unsettled = (part % 3 != 1) & (np.bincount(number)[number] > 1)
            fresh = live[np.flatnonzero(start)][number]  # a group is named by its first place
            group[live] = fresh
            live = live[unsettled]
        return order

    def repeated(self, length: int) -> np.ndarray:
        """Whether the ``length`` symbols at each valid start also start elsewhere in the text."""
        valid = np.concatenate([np.arange(f, f + max(0, s - length + 1)) for f, s in zip(self.first, self.size)])
        out = np.zeros(self.n + 1, bool)
        lead = self.words[valid] >> 9 * (PACK - 2)  # two leading symbols name a suffix bucket
        valid = valid[np.argsort(lead, kind="stable")]
        lead = np.sort(lead)
        border = np.append(np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1]))), len(valid))
        at = 0
        while at < len(valid):
            # Whole buckets, as many as fit a block.
            end = border[max(np.searchsorted(border, at, side="right"),
                             np.searchsorted(border, at + BLOCK, side="right") - 1)]
            some = valid[at:end]
            by_prefix, new = self.ordered(self.prefixes(some))
            order = self.sort_ties(some[by_prefix], new)
            pair = np.arange(len(order) - 1)
            for k in [*range(0, length - PACK, PACK), length - PACK]:
                pair = pair[self.words[order[pair] + k] == self.words[order[pair + 1] + k]]
            out[order[pair]] = True
            out[order[pair + 1]] = True
            at = end
        return out


def ranges(flags: np.ndarray) -> list[int]:
    """Starts and ends of the stretches of true values, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


def repeated_in(strings: list[bytes], counts: list[int], length: int = LENGTH) -> list[list[int]]:
    """For each of one bucket's different strings the ranges of its repeated starts."""
    starts = [len(s) - length + 1 for s in strings]
    if len(strings) == 1:
        return [[0, starts[0]] if counts[0] > 1 else []]
    text = SuffixText(strings, length)
    found = text.repeated(length)
    return [[0, n] if c > 1 else ranges(found[f:f + n]) for f, n, c in zip(text.first.tolist(), starts, counts)]


STRINGS = StructType([field("h", LongType()), field("s", BinaryType()), field("n", LongType())])
PLACED = StructType([field("h", LongType()), field("digest16", BinaryType()), field("id", LongType()),
                     field("digest", LongType()), field("starts", ArrayType(LongType()))])
REPEATED = StructType([field("h", LongType()), field("digest16", BinaryType()), field("repeated", ArrayType(IntegerType()))])
WINDOWS = StructType([field("window", BinaryType()), field("h", LongType()), field("digest16", BinaryType()),
                      field("at", IntegerType()), field("n", LongType())])
KEPT = StructType([field("n_removed", LongType()), field("n_spans", LongType()), field("kept_sha256", StringType())])


def digest16(s: bytes) -> bytes:
    return xxhash.xxh3_128_digest(s)


def packed_strings(found: DataFrame, slices, out: StructType, row) -> DataFrame:
    """A row for each different string of a document: ``slices`` packs a run, ``row`` gives the columns."""
    def make():
        def compute(batch):
            data, border = raw(batch.column("text"))
            rows = []
            for a, b, own, i, d in zip(border, border[1:], batch.column("runs").to_pylist(),
                                       batch.column("id").to_pylist(), batch.column("digest").to_pylist()):
                cut_out = slices(data[a:b])
                strings: dict[tuple, list[int]] = {}
                for r in own:
                    start, n = divmod(r["place"], RUN)
                    strings.setdefault((r["h"], cut_out(start, n)), []).append(start)
                rows += [row(h, s, i, d, starts) for (h, s), starts in strings.items()]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in out.fields]

        return compute

    return expand_rows(found, out, "text", make)


def byte_slices(data: bytes):
    return lambda start, n: data[start:start + n - 1 + LENGTH]


def by_bucket(strings: DataFrame, out: StructType, solve, value: str) -> DataFrame:
    """Gathers the strings of each bucket ``h`` (at most MOST) and yields (h, digest16, answer) rows.

    ``solve`` gets the strings of whole buckets, with the ``value`` column, and answers each.
    """
    def run(batches):
        def flush(groups):
            h, d, answers = [], [], []
            strings = [s for _, ss, _ in groups for s in ss]
            for (g, ss, vs), got in zip(groups, solve([(ss, vs) for _, ss, vs in groups])):
                h += [g] * len(ss)
                d += [digest16(s) for s in ss]
                answers += got
            if strings:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.binary()),
                                                  pa.array(answers, answer_type)], names=out.names)

        from pyspark.sql.pandas.types import to_arrow_schema
        answer_type = to_arrow_schema(out)[2].type
        groups, held = [], 0
        for batch in batches:
            for h, s, v in zip(*(batch.column(c).to_pylist() for c in ("h", "s", value))):
                if not groups or groups[-1][0] != h:
                    if held > TEXT_BYTES:
                        yield from flush(groups)
                        groups, held = [], 0
                    groups.append((h, [], []))
                groups[-1][1].append(s)
                groups[-1][2].append(v)
                held += len(s)
        yield from flush(groups)

    return (strings.repartition("h").sortWithinPartitions("h").select("h", "s", value).mapInArrow(run, out))


def split_by_size(strings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The strings of buckets of at most MOST, and of larger ones (None if there are none)."""
    large = strings.groupBy("h").count().where(F.col("count") > MOST).select("h")
    large = cut(large)
    if large.isEmpty():
        return strings, None
    return strings.join(large, "h", "left_anti"), strings.join(large, "h", "left_semi")


def each_window(strings: DataFrame, value: str, windows) -> DataFrame:
    """A row for each window of the strings: its 128-bit digest, its place and ``value``."""
    def make():
        def compute(batch):
            rows = []
            for h, s, v in zip(*(batch.column(c).to_pylist() for c in ("h", "s", value))):
                d = digest16(s)
                rows += [(digest16(w), h, d, i, v) for i, w in enumerate(windows(s))]
            return [list(c) for c in zip(*rows)]

        return compute

    return expand_rows(strings, WINDOWS, "s", make)


def solve_bytes(groups):
    # Buckets with one string need no sorting; all others of a task's block form one text.
    many = [(ss, cs) for ss, cs in groups if len(ss) > 1]
    flat = [s for ss, _ in many for s in ss]
    answers = iter(repeated_in(flat, [c for _, cs in many for c in cs]) if flat else ())
    return [repeated_in(ss, cs) if len(ss) == 1 else [next(answers) for _ in ss] for ss, cs in groups]


def find_bytes():
    def found(column):
        data, border = raw(column)
        return runs(np.frombuffer(data, np.uint8), np.array(border), LENGTH, GRAM)

    return found


def repeated_starts(found: DataFrame) -> DataFrame:
    """id, digest, starts of runs and the ranges of repeated starts after each, for the runs that have any."""
    strings = cut(packed_strings(found, byte_slices, STRINGS, lambda h, s, i, d, starts: (h, s, len(starts)))
                  .groupBy("h", "s").agg(F.sum("n").alias("n")))
    small, large = split_by_size(strings)
    answers = by_bucket(small, REPEATED, solve_bytes, "n").where(F.size("repeated") > 0)
    if large is not None:
        w = cut(each_window(large, "n", lambda s: (s[i:i + LENGTH] for i in range(len(s) - LENGTH + 1))))
        again = cut(w.groupBy("window").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("window"))
        answers = answers.union(
            w.join(again, "window").groupBy("h", "digest16")
            .agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("repeated")))
    places = packed_strings(found, byte_slices, PLACED, lambda h, s, i, d, starts: (h, digest16(s), i, d, starts))
    return places.join(answers, ["h", "digest16"]).select("id", "digest", "starts", "repeated")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    df = keyed(docs, id_col, text_col)
    found = candidates(df, find_bytes, F.col("n") > 1)
    lists = (repeated_starts(found).groupBy("id", "digest")
             .agg(F.collect_list(F.struct("starts", "repeated")).alias("found")))
    texts = found.select("id", "digest", "text").join(lists, ["id", "digest"])

    def make():
        def compute(batch):
            data, border = raw(batch.column("text"))
            rows = []
            for a, b, own in zip(border, border[1:], batch.column("found").to_pylist()):
                gone = np.zeros(b - a + 1, np.int32)
                for r in own:
                    x = np.array(r["repeated"], np.int64).reshape(1, -1, 2) + np.array(r["starts"]).reshape(-1, 1, 1)
                    np.add.at(gone, x[..., 0], 1)
                    np.add.at(gone, x[..., 1] - 1 + LENGTH, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(data[a:b], np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), len(ranges(gone)) // 2, hashlib.sha256(kept).hexdigest()))
            return [list(c) for c in zip(*rows)]

        return compute

    changed = map_rows(texts, KEPT, "text", make, keep=("id", "digest")).dropDuplicates(["id", "digest"])
    every = df.select("doc_id", "id", "digest", F.octet_length("text").cast("long").alias("n_bytes"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return every.join(changed, ["id", "digest"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
