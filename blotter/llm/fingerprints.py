"""Document fingerprints (operator 13): locally consistent parsing.

A text is a sequence of byte names.  Every level cuts its sequence into phrases,
whose names are the symbols of the next level, until one name, the root, is left:

1. Runs of one symbol become one symbol, named by symbol and length, so that
   neighbours differ.
2. Deterministic coin tossing: a symbol's colour is the lowest bit in which it
   differs from its left neighbour, and the value of that bit.  Four rounds bring
   64-bit names down to six colours, neighbours still differing; three more
   replace the upper three by the least colour that neither neighbour has.
3. A phrase starts at every local maximum of the colours (and at the text's
   start), so phrases have two to four symbols.  A phrase's name is a 64-bit hash
   of the names in it.

Whether a phrase starts at a symbol depends on ``LEFT`` symbols before and
``RIGHT`` after it, nothing else.  So equal substrings are cut alike, wherever they
stand, but for some phrases at their borders, and texts that share passages
share names.

A fingerprint is the root, which tells different texts apart, and the ``KEPT``
smallest names (their upper 32 bits) of the levels ``LEVELS``, where phrases have
some 6 to 33 bytes; texts that end below them give their root.  The likeness of
two fingerprints is the share of common names among the smallest names of both
together, an estimate of the Jaccard similarity of their phrases (exact where
both have ``KEPT`` names or fewer).

For the comparison with edited texts, documents are dealt by ranges of
(id, digest) of near-equal bytes (``ranges``) and streamed in descending order;
the first document of each range is also sent to the range before it.  Texts are
shuffled once.  Memory: slices of texts, and about ten bytes for each byte of the
longest text.

Defined cases: null text is empty; the empty text has a fingerprint of its own,
of likeness 1 to itself and 0 to others; rows without an id come last, and rows
of one id by their XXH64, descending; a single row is its own next document;
repeated rows are documents of their own; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from blotter.llm.anchors import mixed
from blotter.llm.common import cut, field, map_rows, pick, pieces, raw, with_row
from blotter.llm.ranges import coded, cut_keys, range_bytes, range_of

#: Levels whose names enter a fingerprint, and how many of the smallest stay.
LEVELS, KEPT = (2, 4), 64
#: Symbols that are cut at once, and how far a cut depends on symbols before and after.
SEGMENT, LEFT, RIGHT = 1 << 18, 12, 6

#: Multipliers by place in a phrase (the last one for its length).
PLACE = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * PLACE[0])


# ---- parsing ----

def tossed(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Colours by the lowest bit in which a symbol differs from the one before it (equal ones: bit 0)."""
    one = x.dtype.type(1)
    differs = x ^ before
    low = np.bitwise_count((differs & (~differs + one)) - one)
    low[differs == 0] = 0
    return low << 1 | (x >> low & one).astype(np.uint8)


def toss_table(n: int) -> np.ndarray:
    """``tossed`` for all pairs of colours below ``n``, at ``before * n + x``."""
    return tossed(np.tile(np.arange(n, dtype=np.uint8), n), np.repeat(np.arange(n, dtype=np.uint8), n))


#: Rounds over 128 (names have 64 bits), 16 and 8 colours give 14, 8 and 6.
TOSSES = [(n, toss_table(n)) for n in (128, 16, 8)]


def recolour_table(colour: int) -> np.ndarray:
    """At ``before * 64 + x * 8 + after``: x, or for ``colour`` the least of 0, 1, 2 that no neighbour has."""
    out = np.tile(np.repeat(np.arange(8, dtype=np.uint8), 8), 8)
    for before in range(8):
        for after in range(8):
            out[before * 64 + colour * 8 + after] = min({0, 1, 2} - {before, after})
    return out


RECOLOURS = [recolour_table(c) for c in (5, 4, 3)]
#: The colour beyond a text's ends.
NONE = 7


def phrase_starts(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at each symbol; neighbours differ; ``first`` and ``last`` are the texts' outer symbols.

    Right for all but the outer ``LEFT`` and ``RIGHT`` symbols, if those are no texts' ends.
    """
    def behind(colour):
        out = np.empty_like(colour)
        out[1:] = colour[:-1]
        out[0] = colour[0]
        out[first] = colour[first]  # a text's first symbol is compared with itself: bit 0
        return out

    colour = tossed(x, behind(x))
    for n, table in TOSSES[0 if x.dtype == np.uint64 else 1:]:
        colour = table[behind(colour).astype(np.uint16) * n + colour]
    before, after = np.full(len(colour), NONE, np.uint16), np.full(len(colour), NONE, np.uint16)
    for table in (*RECOLOURS, None):
        before[1:], after[:-1] = colour[:-1], colour[1:]
        before[first], after[last] = NONE, NONE
        if table is not None:
            colour = table[before << 6 | colour.astype(np.uint16) << 3 | after]
    start = (colour > before) & (colour > after)
    # A phrase has two symbols at least, but for a text of one.
    start[last] = False
    second = first[first < len(start) - 1] + 1
    start[second] = False
    start[first] = True
    return start


def next_level(x: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases of texts of symbols ``x`` cut at ``border``, the phrases' first symbols, and new borders."""
    n = len(x)
    head = np.ones(n, bool)
    np.not_equal(x[1:], x[:-1], out=head[1:])
    head[border[:-1]] = True
    at = np.append(np.flatnonzero(head), n).astype(np.int32 if n < 1 << 31 else np.int64)
    m = len(at) - 1
    first = np.searchsorted(at, border[:-1])
    last = np.append(first[1:], m) - 1

    starts = []
    for a in range(0, m, SEGMENT):
        b = min(m, a + SEGMENT)
        lo, hi = max(0, a - LEFT), min(m, b + RIGHT)
        firsts, lasts = (v[np.searchsorted(v, lo):np.searchsorted(v, hi)] - lo for v in (first, last))
        flags = phrase_starts(x[at[lo:hi]], firsts, lasts)
        starts.append(np.flatnonzero(flags[a - lo:b - lo]).astype(at.dtype) + a)
    start = np.append(np.concatenate(starts), m).astype(at.dtype)
    names = np.empty(len(start) - 1, np.uint64)
    for a in range(0, len(names), SEGMENT):
        b = min(len(names), a + SEGMENT)
        own = x[at[start[a]:start[b]]]
        runs = np.diff(at[start[a]:start[b] + 1])
        own = BYTE[own] if own.dtype == np.uint8 else own
        many = np.flatnonzero(runs > 1)
        own[many] = mixed(own[many] + PLACE[-2] * runs[many].astype(np.uint64))
        at0, size = start[a:b] - start[a], np.diff(start[a:b + 1])
        name = own[at0] * PLACE[0] + PLACE[-1] * size.astype(np.uint64)
        longer = np.flatnonzero(size > 1)
        for j in range(1, int(size.max())):
            name[longer] += own[at0[longer] + j] * PLACE[j]
            longer = longer[size[longer] > j + 1]
        names[a:b] = mixed(name)
    return names, at[start[:-1]], np.append(np.searchsorted(start, first), len(names))


def parsed(data: bytes, border: list[int]):
    """The levels of texts of bytes: (level, names, first bytes, borders, numbers of the texts left), then their roots.

    Level 0 is the bytes (first bytes: None).  A text leaves when one name is left, its root; an empty text's is 0.
    """
    border = np.asarray(border)
    roots = np.zeros(len(border) - 1, np.uint64)
    of = np.flatnonzero(np.diff(border))
    x, at = np.frombuffer(data, np.uint8), None
    border = np.append(border[of], len(data))
    level = 0
    while len(of):
        yield level, x, at, border, of, roots
        size = np.diff(border)
        over = size == 1
        ends = x[border[:-1][over]]
        roots[of[over]] = BYTE[ends] if x.dtype == np.uint8 else ends
        if over.any():
            keep = np.repeat(~over, size)
            x, of = x[keep], of[~over]
            at = np.flatnonzero(keep) if at is None else at[keep]
            border = np.concatenate(([0], np.cumsum(size[~over])))
        if len(of):
            x, begin, border = next_level(x, border)
            at = begin if at is None else at[begin]
        level += 1


def smallest(values: np.ndarray, border: np.ndarray) -> list[np.ndarray]:
    """The ``KEPT`` smallest different values of each group, sorted."""
    size = np.diff(border)
    # Values are spread evenly, so those below a bound are enough for nearly all groups.
    bound = np.minimum((3 * KEPT + 40) / np.maximum(size, 1), 1.0) * (1 << 32)
    low = values < np.repeat(bound, size)
    count = np.concatenate(([0], np.cumsum(low)))
    chosen = values[low]
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
        own = np.unique(chosen[count[a]:count[b]])
        if len(own) < KEPT and count[b] - count[a] < b - a:
            own = np.unique(values[a:b])
        out.append(own[:KEPT])
    return out


def fingerprints_of(data: bytes, border: list[int]) -> list[tuple[int, np.ndarray]]:
    """(root, smallest names) of each text."""
    n = len(border) - 1
    names, owner, roots = [], [], np.zeros(n, np.uint64)
    for level, x, _, cuts, of, roots in parsed(data, border):
        size = np.diff(cuts)
        if LEVELS[0] <= level <= LEVELS[1]:
            names.append((x >> np.uint64(32)).astype(np.uint32))
            owner.append(np.repeat(of, size))
        elif level < LEVELS[0]:
            ends = x[cuts[:-1][size == 1]]
            ends = BYTE[ends] if x.dtype == np.uint8 else ends
            names.append((ends >> np.uint64(32)).astype(np.uint32))
            owner.append(of[size == 1])
    values, owner = (np.concatenate(v) if v else np.zeros(0, np.uint32) for v in (names, owner))
    order = np.argsort(owner, kind="stable")
    return list(zip(roots.tolist(), smallest(values[order], np.searchsorted(owner[order], np.arange(n + 1)))))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: common names among the ``KEPT`` smallest of both together."""
    x, y = a[1], b[1]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)[:KEPT]
    common = np.intersect1d(x, y, assume_unique=True)
    return float(np.searchsorted(common, both[-1], side="right") / len(both))


def shown(fp: tuple[int, np.ndarray]) -> str:
    """Hexadecimal: the root (16 digits), then 8 digits a name."""
    return f"{fp[0]:016x}" + fp[1].astype(">u4").tobytes().hex()


def read_back(text: str) -> tuple[int, np.ndarray]:
    return int(text[:16], 16), np.frombuffer(bytes.fromhex(text[16:]), ">u4").astype(np.uint32)


# ---- Spark ----

def fingerprint(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns) and ``fingerprint`` of every document; nothing is shuffled."""
    df = with_row(docs, carry, text=text_col)

    def make():
        return lambda batch: [[shown(f) for f in fingerprints_of(*raw(batch.column("text")))]]

    return map_rows(df, StructType([field("fingerprint", StringType())]), "text", make)


@pandas_udf(DoubleType())
def fingerprint_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns; null where either is null."""
    return pd.Series([None if x is None or y is None else likeness(read_back(x), read_back(y)) for x, y in zip(a, b)],
                     dtype="float64")


COMPARED = StructType([
    field("doc_id", LongType()), field("next_id", LongType()), field("n_chars", LongType()),
    field("edited_sha256", StringType()), field("fingerprint", StringType()), field("edited_fingerprint", StringType()),
    field("near_edited", DoubleType()), field("near_next", DoubleType())])


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) gives way to as many first code points of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def visited(heads: list[tuple]) -> Column:
    """For the rows of a range's greatest keys: the range that they visit (the next higher; of the highest, the lowest).

    ``heads`` has (range, id, h), one for each range that has rows: what is collected is three numbers a range.
    """
    heads = sorted(heads)
    ranges = np.array([h[0] for h in heads], np.int64)
    goal = np.roll(ranges, -1)
    keys = coded([np.array([h[i] or 0 for h in heads], np.int64) for i in (1, 2)],
                 [np.array([h[i] is not None for h in heads]) for i in (1, 2)])

    @pandas_udf(IntegerType())
    def goes_to(part: pd.Series, i: pd.Series, known: pd.Series, h: pd.Series) -> pd.Series:
        at = np.searchsorted(ranges, part.to_numpy())
        own = coded([i.to_numpy(), h.to_numpy()], [known.to_numpy(), np.ones(len(h), bool)])
        return pd.Series(np.where(own == keys[at], goal[at], -1).astype(np.int32))

    return goes_to(F.col("range"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull(), F.col("h"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       step: int | None = None) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are.

    The next document is the one of the next smaller id (of the smallest: the greatest).
    """
    df = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("h", F.xxhash64("text"))
    small = cut(df.select("doc_id", "h", (F.octet_length("text") + 100).cast("long").alias("n")))
    step = step or range_bytes(small, "n")
    cuts = cut_keys(small, ["doc_id", "h"], "n", step)
    at = range_of(cuts, "doc_id", "h").alias("range")
    heads = small.select("doc_id", "h", at).groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()
    dealt = df.select("doc_id", "h", "text", at)
    if heads:
        dealt = dealt.withColumn("goal", visited([(r.range, r.top.doc_id, r.top.h) for r in heads]))
    else:
        dealt = dealt.withColumn("goal", F.lit(-1))
    both = F.array(F.struct(F.col("range"), F.lit(0).alias("visits")), F.struct(F.col("goal").alias("range"), F.lit(1).alias("visits")))
    sent = (dealt.select("doc_id", "h", "text", F.explode(both).alias("to"))
            .select("to.*", "doc_id", "h", "text").where("range >= 0")
            .repartitionById(len(cuts) + 1, F.col("range"))
            .sortWithinPartitions("visits", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()))

    def run(batches):
        schema = to_arrow_schema(COMPARED)
        before = None  # the row that waits for its next document
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(),
                                fingerprints_of(*raw(part.column("text")))))
                own = part.column("visits").to_pylist().count(0)
                pairs = list(zip(([before] if before else []) + rows[:own], rows[0 if before else 1:]))
                # The first visitor is the next document of the last row, further ones are copies of it.
                before = rows[-1] if own == len(rows) else None
                if not pairs:
                    continue
                texts = [edited_text(row[1], after[1]).encode() for row, after in pairs]
                border = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).tolist()
                edits = fingerprints_of(b"".join(texts), border)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*[
                    (row[0], after[0], len(row[1]), hashlib.sha256(text).hexdigest(), shown(row[2]), shown(fp),
                     likeness(row[2], fp), likeness(row[2], after[2]))
                    for (row, after), text, fp in zip(pairs, texts, edits)]), schema)], schema=schema)

    return sent.mapInArrow(run, COMPARED)
