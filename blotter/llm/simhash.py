"""SimHash near-dedup (operator 7).

Fingerprints: XXH64 (seed 42) of every 3-word shingle, repeats included; a bit
is set if it is set in over half the hashes.

Links: equal fingerprints are one node.  The distinct fingerprints are joined
with themselves by walking a binary trie in node pairs: both nodes descend
together, differing bits add up, and a pair is dropped when they exceed the
error budget.  To spread the walk over tasks, the bits are cut into
``budget + 1`` blocks; two fingerprints within the budget agree on one block
at least, so for each block the fingerprints that share its value form one
subtree, walked on its own.  A subtree that is larger than ``MOST`` is cut
again by the blocks of its remaining bits, until it is small or the remaining
bits themselves bound it.

A walk does not emit its links but the edges of a spanning forest of them (at
most one per fingerprint), which is all that components need; groups of copies
are never expanded into pairs.  Components are joined across subtrees by
``connected_components`` on smallest ids.

Defined cases: null, empty and blank texts have fingerprint zero and link to
each other like any others; fewer words than a shingle hash as a whole; repeated
rows are ordinary rows; a null id is linked but never names a component unless
its component has no other id (then it is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from blotter.llm.common import cut, field, map_rows, pick, raw, with_row
from blotter.llm.graph import connected_components

SHINGLE = 3
DISTANCE = 3
BITS = 64
#: Most fingerprints in one subtree before it is cut again.
MOST = 50_000
#: Fingerprints whose subtrees are walked together, about.
WALKED = 50_000


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    words = data.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(size + 1) - size - 1
    k = max(1, n - shingle + 1)
    end = (start + size)[-k:].tolist()
    h64 = xxhash.xxh64_intdigest
    begin = start.tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, k, 8192):
        hashes = np.array([h64(flat[a:b], 42) for a, b in zip(begin[i:i + 8192], end[i:i + 8192])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
                 shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``row`` (the carried columns) and fp (the fingerprint as a signed long)."""
    def make():
        def compute(batch):
            data, border = raw(batch.column("text"))
            fps = np.array([fingerprint(data[a:b], shingle) for a, b in zip(border, border[1:])], np.uint64)
            return [pa.array(fps.view(np.int64))]

        return compute

    return map_rows(with_row(docs, carry, text=text_col), StructType([field("fp", LongType())]), "text", make)


def trie_links(fps: np.ndarray, budget: int, border: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``fps`` (uint64) that differ in at most ``budget`` bits.

    ``border`` cuts ``fps`` into tries (sorted and distinct each) that are walked together.
    """
    border = np.array([0, len(fps)]) if border is None else border
    # A node is a range of sorted fingerprints that share a prefix; pairs are walked level by level.
    some = np.diff(border) > 1
    a_lo, a_hi = border[:-1][some], border[1:][some]
    b_lo, b_hi = a_lo, a_hi
    cost = np.zeros(len(a_lo), np.int64)
    for bit in range(BITS - 1, -1, -1):
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        parts = []
        for p_lo, p_hi, q_lo, q_hi, extra, keep in (
                (a_lo, a_mid, b_lo, b_mid, 0, None), (a_mid, a_hi, b_mid, b_hi, 0, None),
                (a_lo, a_mid, b_mid, b_hi, 1, None), (a_mid, a_hi, b_lo, b_mid, 1, ~same)):
            ok = (p_lo < p_hi) & (q_lo < q_hi) & (cost + extra <= budget)
            # A node paired with itself needs two fingerprints.
            ok &= ~((p_lo == q_lo) & (p_hi - p_lo < 2))
            if keep is not None:
                ok &= keep
            parts.append((p_lo[ok], p_hi[ok], q_lo[ok], q_hi[ok], cost[ok] + extra))
        a_lo, a_hi, b_lo, b_hi, cost = (np.concatenate(x) for x in zip(*parts))
        if not len(a_lo):
            break
    return a_lo, b_lo


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes that links join, by union and find."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in range(n) if root[x] != x]


def blocks_of(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` cut into ``parts`` masks of about equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    border = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(border, border[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, budget: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Edges (a, b) of spanning forests of the links between the distinct ``fp`` values."""
    out = StructType([field("a", LongType()), field("b", LongType())])

    def walk(batches):
        def close(mask, value, fp):
            """Walks whole subtrees together."""
            if len(fp) < 2:
                return
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
            fp = fp[np.lexsort((fp, np.cumsum(new)))]
            x, y = trie_links(fp, budget, np.append(np.flatnonzero(new), len(fp)))
            ends = fp.view(np.int64)[np.array(forest(len(fp), x, y), np.int64).reshape(-1, 2)]
            if len(ends):
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = (batch.column("mask").to_numpy(), batch.column("value").to_numpy(),
                    batch.column("fp").to_numpy().view(np.uint64))
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows))
            if len(held[0]) < WALKED:
                continue
            # All but the last subtree, which may go on in the next batch.
            mask, value, _ = held
            last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            yield from close(*(x[:end] for x in held))
            held = tuple(x[end:] for x in held)
        if held is not None:
            yield from close(*held)

    spark = fps.sparkSession
    todo = fps.withColumn("mask", F.lit(0).cast("long")).withColumn("value", F.lit(0).cast("long"))
    masks = {0}
    edges = None
    while masks:
        # Each subtree's fingerprints, cut by the blocks of the bits that are not fixed yet.
        finer = {m: [m | b for b in blocks_of((1 << BITS) - 1 & ~m, budget + 1)] for m in masks}
        table = F.create_map(*[x for m, fs in finer.items()
                               for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in fs]))])
        todo = (todo.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
                .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
        masks = {f for fs in finer.values() for f in fs}
        groups = todo.groupBy("mask", "value").count()
        large = groups.where(F.col("count") > most).select("mask", "value")
        left = BITS - min(bin(m).count("1") for m in masks)
        again = 2 ** left > most and not large.isEmpty()
        if again:
            large = cut(large)
            small = todo.join(large, ["mask", "value"], "left_anti")
        else:
            small = todo
        got = (small.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(walk, out))
        edges = got if edges is None else edges.union(got)
        if not again:
            break
        todo = todo.join(large, ["mask", "value"], "left_semi")
        masks = {r.mask & (1 << BITS) - 1 for r in large.select("mask").distinct().collect()}
    return edges if edges is not None else spark.createDataFrame([], out)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Per row: doc_id, digest (of the text), fp and component_id."""
    keyed = pick(docs, doc_id=id_col, text=text_col).withColumn("digest", F.xxhash64("text"))
    rows = fingerprints(keyed, "text", ["doc_id", "digest"], shingle)
    rows = cut(rows.select("row.doc_id", "row.digest", "fp"))
    # One node per fingerprint, named by its smallest id.
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(fingerprint_links(nodes.select("fp"), distance, most))
    named = (nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component", "component_id")
    return rows.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    return classes(docs, **options).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last)."""
    found = classes(docs, id_col, text_col, **options)
    first = (found.groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")))
    kept = cut(first.select(F.col("k.doc_id").alias("_id"), F.col("k.digest").alias("_digest")))
    twice = (found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).count()
             .where("count > 1").select("_id", "_digest"))
    twice = cut(twice)
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = rows.withColumns({"_own_id": F.col(f"_c{names.index(id_col)}"),
                             "_own_digest": F.xxhash64(f"_c{names.index(text_col)}")})

    def same(other):
        return rows._own_id.eqNullSafe(other._id) & (rows._own_digest == other._digest)

    rows = rows.join(kept, same(kept), "left_semi")
    if not twice.isEmpty():  # repeated rows: one of each stays
        again = rows.join(twice, same(twice), "left_semi").dropDuplicates(["_own_id", "_own_digest"])
        rows = rows.join(twice, same(twice), "left_anti").unionByName(again)
    return rows.drop("_own_id", "_own_digest").toDF(*names)
