"""Substring dedup (operator 4): 50-word windows that also start in an earlier document go.

Super-k-mers: consecutive windows of a document that share a minimiser (the
8-word gram of smallest hash, ``anchors``) travel as one packed string to the
minimiser's bucket.  Strings whose minimiser occurs in one document only are left
out beforehand, and equal strings are merged, keeping their smallest id.  In a
bucket every word becomes a number and sorting names all windows of 2, 4, ... 32
words and then, as two overlapping halves, of 50: equal names are equal
windows.  Each window's smallest id goes back to the documents that hold the
string, where words covered by a window of an earlier document go.

Hot buckets: one that holds more than ``MOST`` different strings is not
gathered.  Its windows are looked up one by one, keyed by a 128-bit digest of
their words, pre-aggregated to the smallest id.

Defined cases: null text has no words; texts under 50 words keep all; a null id
counts as later than every other; rows that repeat an id are never earlier than
each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from blotter.llm.anchors import FACTOR, BYTE_HASH, candidates, keyed, mixed, runs
from blotter.llm.common import cut, field, map_rows, raw
from blotter.llm.suffix_dedup import (
    PLACED,
    by_bucket,
    digest16,
    each_window,
    packed_strings,
    split_by_size,
)

LENGTH = 50
GRAM = 8
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(data: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and where each document's words begin among them."""
    space = SPACES[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts_doc = border[:-1][border[:-1] < len(data)]
    begins[starts_doc] = ~space[starts_doc]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(border), np.int64)
    # Number of word bytes before each byte: a word's bytes are those of its stretch that are no space.
    letters = np.flatnonzero(~space)
    at = np.searchsorted(letters, first)
    size = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, size)
    power = np.ones(int(size.max()) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, FACTOR, np.uint64))
    h = mixed(np.add.reduceat(BYTE_HASH[data[letters]] * power[place], at))
    return h, np.searchsorted(first, border)


def find_words():
    def found(column):
        data, border = raw(column)
        h, words = word_hashes(np.frombuffer(data, np.uint8), np.array(border))
        return runs(h, words, LENGTH, GRAM)

    return found


def word_slices(data: bytes):
    words = data.split()  # bytes: the six ASCII white space characters
    return lambda start, n: b" ".join(words[start:start + n - 1 + LENGTH])


def window_names(words: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` words, equal if the windows are (by sorting pairs)."""
    name, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 1

    def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (len(words) + 1) + y, return_inverse=True)[1].astype(np.int64)

    while 2 * size <= length:
        name, size = pairs(name[:-size], name[size:]), 2 * size
    return pairs(name[:len(words) - length + 1], name[length - size:][:len(words) - length + 1])


def solve_words(groups):
    """For each string its stretches of windows with one smallest id: [from, to, id, ...]."""
    flat = [(s, v) for ss, vs in groups for s, v in zip(ss, vs)]
    numbers: dict[bytes, int] = {}
    words, size = [], []
    for s, _ in flat:
        own = s.split(b" ")
        words += [numbers.setdefault(w, len(numbers)) for w in own]
        size.append(len(own))
    if not flat:
        return [[] for _ in groups]
    size = np.array(size, np.int64)
    first = np.cumsum(size) - size
    windows = size - LENGTH + 1
    names = window_names(np.array(words, np.int64), LENGTH)
    start = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    ids = np.repeat(np.array([v for _, v in flat], np.int64), windows)
    least = np.full(int(names.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, names[start], ids)
    low = least[names[start]]
    out, at = [], 0
    for n in windows.tolist():
        own = low[at:at + n]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out.append(np.stack([edge, np.append(edge[1:], n), own[edge]], 1).reshape(-1).tolist())
        at += n
    result, k = [], 0
    for ss, _ in groups:
        result.append(out[k:k + len(ss)])
        k += len(ss)
    return result


STRINGS = StructType([field("h", LongType()), field("s", BinaryType()), field("id", LongType())])
EARLIEST = StructType([field("h", LongType()), field("digest16", BinaryType()), field("earliest", ArrayType(LongType()))])
KEPT = StructType([field("n_words", LongType()), field("n_removed", LongType()), field("kept_sha256", StringType())])


def earlier_starts(found: DataFrame) -> DataFrame:
    """id, digest, starts of runs and the stretches of windows after each with their smallest id, for the
    runs that hold a window of an earlier document."""
    strings = cut(packed_strings(found, word_slices, STRINGS, lambda h, s, i, d, starts: (h, s, i))
                  .groupBy("h", "s").agg(F.min("id").alias("n")))
    small, large = split_by_size(strings)
    answers = by_bucket(small, EARLIEST, solve_words, "n")
    if large is not None:
        def windows(s: bytes):
            words = s.split(b" ")
            return (b" ".join(words[i:i + LENGTH]) for i in range(len(words) - LENGTH + 1))

        w = cut(each_window(large, "n", windows))
        least = cut(w.groupBy("window").agg(F.min("n").alias("low")))
        at = F.col("at").cast("long")
        answers = answers.union(
            w.join(least, "window").groupBy("h", "digest16")
            .agg(F.flatten(F.collect_list(F.array(at, at + 1, F.col("low")))).alias("earliest")))
    places = packed_strings(found, word_slices, PLACED, lambda h, s, i, d, starts: (h, digest16(s), i, d, starts))
    earlier = F.expr("exists(sequence(2, size(earliest) - 1, 3), i -> earliest[i] < id)")
    return places.join(answers, ["h", "digest16"]).where(earlier).select("id", "digest", "starts", "earliest")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    df = keyed(docs, id_col, text_col)
    found = candidates(df, find_words, F.col("low") < F.col("high"))
    lists = (earlier_starts(found).groupBy("id", "digest")
             .agg(F.collect_list(F.struct("starts", "earliest")).alias("found")))
    texts = found.select("id", "digest", "text").join(lists, ["id", "digest"])

    def make():
        def compute(batch):
            data, border = raw(batch.column("text"))
            rows = []
            for a, b, i, own in zip(border, border[1:], batch.column("id").to_pylist(),
                                    batch.column("found").to_pylist()):
                words = data[a:b].split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in own:
                    x = np.array(r["earliest"], np.int64).reshape(-1, 3)
                    x = x[x[:, 2] < i, :2].reshape(1, -1, 2) + np.array(r["starts"]).reshape(-1, 1, 1)
                    np.add.at(gone, x[..., 0], 1)
                    np.add.at(gone, x[..., 1] - 1 + LENGTH, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            return [list(c) for c in zip(*rows)]

        return compute

    changed = (map_rows(texts, KEPT, "text", make, keep=("id", "digest")).dropDuplicates(["id", "digest"])
               .select("id", "digest", "n_removed", "kept_sha256"))
    whole = StructType([field("n_words", LongType()), field("whole", StringType())])

    def make_whole():
        def compute(batch):
            data, border = raw(batch.column("text"))
            words = [data[a:b].split() for a, b in zip(border, border[1:])]
            return [[len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]]

        return compute

    every = map_rows(df.select("doc_id", "id", "digest", "text"), whole, "text", make_whole, keep=("doc_id", "id", "digest"))
    return every.join(changed, ["id", "digest"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
