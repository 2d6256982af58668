"""Filter interaction audit (operator 11): min-plus removal ranks.

A set of filters is applied in every possible order.  What a filter removes
depends on what stands before it, but only through the *mask* of a row, the set
of filters that it fails.  So the rows are counted once per part and mask, in
Spark, and the rest is algebra on small matrices of fixed size:

* mask matrix ``M[mask, filter]``: 0 where the mask fails the filter, infinite
  elsewhere;
* position matrix ``P[filter, order]``: the step at which an order applies the
  filter, i.e. the inverse of the order as a permutation;
* their min-plus product ``R[mask, order] = min_f M[mask, f] + P[f, order]`` is
  the step at which an order removes the rows of a mask.

The counts of the masks, and their weighted counts, are scattered to the steps
that ``R`` names; what fails a filter but was removed before is its redundancy.

Work and memory: the scan of the rows, one aggregation to at most ``2^k`` masks
a part, and per part one task row of ``2^k`` counts (``k`` filters, ``MOST_FILTERS``
at most; ``k!`` orders).  No step depends on the number of rows but the counting.

Defined cases: an empty table has no parts and gives no row; a null flag counts
as not failing; a null part is the empty string's part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from blotter.llm.common import cut, field, pick

#: 8! orders times 2^8 masks are 10 million removal ranks; more filters have too many orders to list.
MOST_FILTERS = 8

#: Characters that the filter on symbols rejects (fixed value).
SYMBOLS = r"[#$%&*|]"
#: Limits of the document filters (fixed values): words, percent of distinct words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
DOCUMENT_FILTERS = "ABCDE"


# ---- the matrices ----

def mask_matrix(k: int) -> np.ndarray:
    """``M[mask, f]``: 0 where bit ``f`` of the mask is set, else beyond every step."""
    fails = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    return np.where(fails == 1, 0, k + 1).astype(np.int16)


def position_matrix(orders: np.ndarray) -> np.ndarray:
    """``P[f, order]``: the step, from 1, at which the order applies filter ``f``."""
    return (np.argsort(orders, axis=1).T + 1).astype(np.int16)


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product; ``k + 1`` or more: never removed."""
    out = masks[:, :1] + positions[:1]
    for f in range(1, len(positions)):
        np.minimum(out, masks[:, f:f + 1] + positions[f:f + 1], out=out)
    return out


def scattered(steps: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``[row, order, step]``: the weight of a row's masks that an order removes at a step."""
    return np.stack([weights @ (steps == s).astype(np.int64) for s in range(1, k + 1)], axis=2)


# ---- the operator ----

def audit(rows: DataFrame, filters: str, part: str = "part", weights: tuple[str, ...] = ("n",)) -> DataFrame:
    """What each order of ``filters`` removes at each step, per value of ``part``.

    ``rows`` has one boolean column per letter of ``filters`` (true: it fails)
    and integer columns ``weights``; the first counts the rows, each other one
    is reported as what is lost of it.  Returns ``part``, ``filter_order``,
    ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``<weight>_lost`` and ``shapley`` (what the step's filter removes, summed
    over all orders).
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    counted = (rows.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"))
               .agg(*[F.sum(w).alias(f"w{i}") for i, w in enumerate(weights)]))
    # At most 2^k masks a part.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct(
        "mask", *[f"w{i}" for i in range(len(weights))])).alias("masks"))
    out = StructType([field("part", StringType()), field("filter_order", StringType()), field("step", IntegerType()),
                      *[field(c, LongType()) for c in ("kept", "removed", "redundant", "unique_fails",
                                                       *[f"{w}_lost" for w in weights[1:]], "shapley")]])

    def run(batches):
        schema = to_arrow_schema(out)
        orders = np.array(list(permutations(range(k))))
        names = ["".join(filters[f] for f in o) for o in orders]
        steps = removal_steps(mask_matrix(k), position_matrix(orders))
        failing = mask_matrix(k) == 0
        for batch in batches:
            for row in batch.to_pylist():
                w = np.zeros((len(weights), 1 << k), np.int64)
                for m in row["masks"]:
                    w[:, m["mask"]] = [m[f"w{i}"] or 0 for i in range(len(weights))]
                removed = scattered(steps, w, k)
                own = removed[0]
                shapley = np.zeros(k, np.int64)
                np.add.at(shapley, orders, own)
                cols = [w[0].sum() - np.cumsum(own, axis=1), own, (w[0] @ failing)[orders] - own,
                        w[0][1 << np.arange(k)][orders], *removed[1:], shapley[orders]]
                n = own.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n), pa.array(np.repeat(names, k).tolist()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                    + [pa.array(c.ravel()) for c in cols], schema=schema)

    return parts.mapInArrow(run, out)


# ---- the five document filters ----

def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D as columns over a text without nulls and its words; true: the document fails."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
            "C": 100 * capitals > MOST_CAPITALS * F.length(text),
            "D": text.rlike(SYMBOLS)}


def document_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_col: str = "lang") -> DataFrame:
    """Rows (part, A..E, n, good, toxic): documents counted by what they fail.

    E fails where a smaller id holds the same text (by SHA-256 of its bytes);
    of a text's smallest id all rows pass, and rows without an id pass.  Several
    label rows of one id count once: good or toxic if any of them is.

    Texts are read once (the counts per text and part are written); only ids and
    digests are shuffled.  A text held by very
    many rows is counted before its rows meet: one row per text, part and id,
    then one per text and part, which carries the counts of its smallest id.
    """
    text, words = F.col("text"), F.col("words")
    flat = (pick(docs, id=id_col, text=text_col, part=part_col)
            .select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                    F.coalesce("text", F.lit("")).alias("text")))
    split = flat.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    flags = text_flags(text, words)
    # Rows without an id find no label; the spread keeps them out of one partition of the join.
    base = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                        *[c.alias(k) for k, c in flags.items()])
    base = base.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    marks = (pick(labels, id="doc_id", quality="quality", toxic="toxic").where("id IS NOT NULL").groupBy("id")
             .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("long")).alias("toxic"), F.lit(0).cast("long").alias("spread")))
    keys = ["digest", "part", *flags]
    each = (base.join(marks, ["id", "spread"], "left")
            .groupBy("id", *keys).agg(F.count("*").alias("n"), F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    each = each.select("id", *keys, "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    weights = ("n", "good", "toxic")
    by_part = cut(each.groupBy(*keys).agg(
        F.min("id").alias("first"),
        *[F.sum(w).alias(w) for w in weights],
        *[F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col(w))), F.lit(0)).alias(f"{w}_no_id") for w in weights],
        *[F.coalesce(F.min_by(w, "id"), F.lit(0)).alias(f"{w}_first") for w in weights]))
    least = by_part.groupBy("digest").agg(F.min("first").alias("least"))
    rows = by_part.join(least, "digest")
    spared = {w: F.col(f"{w}_no_id") + F.when(F.col("first") == F.col("least"), F.col(f"{w}_first")).otherwise(0)
              for w in weights}
    halves = F.array(
        F.struct(F.lit(False).alias("E"), *[c.alias(w) for w, c in spared.items()]),
        F.struct(F.lit(True).alias("E"), *[(F.col(w) - c).alias(w) for w, c in spared.items()]))
    return (rows.select("part", *flags, F.explode(halves).alias("half"))
            .select("part", *flags, "half.*").where("n > 0"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters, per language."""
    return audit(document_counts(docs, labels), DOCUMENT_FILTERS, weights=("n", "good", "toxic"))
