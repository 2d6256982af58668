"""Embedding near-dedup (operator 8): exact metric range join.

Cosine c or more is Euclidean distance eps = sqrt(2 - 2c) or less between unit
vectors.  Equal vectors are first merged to one with a count.

1. Pivots (``CELL`` vectors each on average, at most ``PIVOTS``, the first by
   hash) are sent to all tasks; a vector belongs to the cell of its nearest.
2. A vector y is also replicated to the cell of pivot p if its distance to p
   exceeds that to its nearest pivot by at most 2 eps.  By the triangle inequality
   no vector within eps can be in another cell: d(y,p) <= d(x,p) + eps <=
   d(x,q) + eps <= d(y,q) + 2 eps for x in p's cell and any pivot q.
3. Cells join independently.  A cell is cut into chunks of at most about ``CHUNK``
   own vectors; a task holds one chunk and streams the whole cell (own vectors and
   replicas) past it, so neither memory nor a task grows with a hot cell.
   Each vector belongs to one chunk, so its links are counted once.  Cosines are
   taken in double precision.

A block of links leaves a task as spanning edges (each vector to the smallest
id of its component in the block), not as pairs.  ``connected_components``
joins them.

The work of step 3 depends on the data: where distances differ by less than
2 eps (random directions in many dimensions), replication reaches most cells
and the join is quadratic in blocks.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing, nor does a row without id; vectors of different
lengths do not link; rows that repeat an id are one node of the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from blotter.llm.common import cut, field, pick
from blotter.llm.graph import connected_components

COSINE = 0.95
CELL = 8192
PIVOTS = 1024
PIVOT_BYTES = 16 << 20
#: Own vectors that a task holds: fewer chunks move fewer rows, at most CHUNK_BYTES of doubles.
CHUNK = 8192
CHUNK_BYTES = 32 << 20
#: Rows and columns of a block of cosines.
BLOCK = 2048


def unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of extreme components in range
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its pivots, as unit vectors."""
    out = {}
    for r in vectors.groupBy("dim").count().collect():
        most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * r.dim)))
        n = min(most, -(-r["count"] // CELL))
        rows = vectors.where(F.col("dim") == r.dim).orderBy("k1", "k2").limit(n).select("v").collect()
        out[r.dim] = unit(pa.array([x.v for x in rows]), r.dim)
    return out


def near_cells(v: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and whether it must be known in each cell."""
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ pivots.T)))
    own = d.argmin(axis=1)
    return own, d <= d[np.arange(len(v)), own][:, None] + 2 * eps + 1e-7


def spanning(left: np.ndarray, right: np.ndarray, ids_left: np.ndarray, ids_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest id of its component) for links given as index pairs; repeated minima over both sides."""
    a, b = ids_left.copy(), ids_right.copy()
    while True:
        low = np.minimum(a[left], b[right])
        a2, b2 = a.copy(), b.copy()
        np.minimum.at(a2, left, low)
        np.minimum.at(b2, right, low)
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    node, root = np.concatenate([ids_left, ids_right]), np.concatenate([a, b])
    pairs = np.unique(np.stack([node, root], 1)[node != root], axis=0)
    return pairs[:, 0], pairs[:, 1]


def vertices(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the key of their vector (null if it links with nothing), and the distinct vectors."""
    df = pick(rows, vec_id=id_col, v=vector_col)
    ok = F.expr("""vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0
        AND NOT coalesce(exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')), true)
        AND exists(v, x -> x <> 0)""")
    df = df.withColumn("k1", F.when(ok, F.xxhash64("v"))).withColumn("k2", F.when(ok, F.xxhash64(F.lit("second"), "v")))
    distinct = (df.where("k1 IS NOT NULL").groupBy("k1", "k2")
                .agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
                .withColumn("dim", F.size("v")))
    return df.select("vec_id", "k1", "k2"), distinct


LINKS = StructType([field("k1", LongType()), field("k2", LongType()), field("rep", LongType()),
                    field("n", LongType()), field("a", LongType()), field("b", LongType())])


def _assigned(vectors: DataFrame, pivots: dict[int, np.ndarray], eps: float) -> DataFrame:
    """A row for each vector and cell that must know it; ``own`` marks its own cell."""
    out = StructType([field("dim", IntegerType()), field("cell", IntegerType()), field("own", BooleanType()),
                      *[vectors.schema[c] for c in ("k1", "k2", "rep", "m", "v")]])

    def assign(batches):
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    own, known = near_cells(unit(some.column("v"), dim), pivots[dim], eps)
                    row, cell = np.nonzero(known)
                    for i in range(0, len(row), 8192):
                        r, c = row[i:i + 8192], cell[i:i + 8192]
                        rest = some.take(pa.array(r))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(r), dim, np.int32)), pa.array(c.astype(np.int32)), pa.array(own[r] == c),
                             *[rest.column(k) for k in ("k1", "k2", "rep", "m", "v")]], names=out.names)

    return vectors.mapInArrow(assign, out)


def _joined(placed: DataFrame, cosine: float, tasks: int) -> DataFrame:
    """Per chunk vector the number of rows within the bound, and spanning edges."""
    def join(batches):
        schema = to_arrow_schema(LINKS)

        def rows(**cols):
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[f.name]) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        def close():
            if held:
                k1, k2, rep = (np.concatenate([h[i] for h in held]) for i in range(3))
                yield rows(k1=k1, k2=k2, rep=rep, n=total)

        key, held, own, total = None, [], None, None
        for batch in batches:
            dims, cells, chunks, kinds = (batch.column(c).to_numpy() for c in ("dim", "cell", "chunk", "kind"))
            code = np.stack([dims, cells, chunks, kinds], 1)
            border = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            for a, b in zip([0, *border.tolist()], [*border.tolist(), len(code)]):
                if a == b:
                    continue
                now, kind = tuple(code[a, :3]), code[a, 3]
                if now != key:
                    yield from close()
                    key, held, own, total = now, [], None, None
                dim = int(now[0])
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    k1, k2, rep, m = (part.column(c).to_numpy() for c in ("k1", "k2", "rep", "m"))
                    v = unit(part.column("v"), dim)
                    if kind == 0:
                        held.append((k1, k2, rep, v))
                        continue
                    if not held:
                        continue
                    if own is None:
                        own = np.concatenate([h[3] for h in held])
                        reps = np.concatenate([h[2] for h in held])
                        keys = np.concatenate([np.stack([h[0], h[1]], 1) for h in held])
                        total = np.zeros(len(own), np.int64)
                    for o in range(0, len(own), BLOCK):
                        x, y = np.nonzero(own[o:o + BLOCK] @ v.T >= cosine)
                        x += o
                        # A vector meets itself once, whatever its cosine rounds to.
                        total += np.bincount(x, m[y], len(own)).astype(np.int64)
                        other = (keys[x, 0] != k1[y]) | (keys[x, 1] != k2[y])
                        x, y = x[other], y[other]
                        if len(x):
                            ux, xi = np.unique(x, return_inverse=True)
                            uy, yi = np.unique(y, return_inverse=True)
                            p, q = spanning(xi, yi, reps[ux], rep[uy])
                            yield rows(a=p, b=q)
        yield from close()

    return (placed.repartition(tasks, "dim", "cell", "chunk").sortWithinPartitions("dim", "cell", "chunk", "kind")
            .mapInArrow(join, LINKS))


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 chunk: int = CHUNK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    every, distinct = vertices(rows, id_col, vector_col)
    distinct = cut(distinct)
    pivots = choose_pivots(distinct)
    eps = float(np.sqrt(2 - 2 * cosine))
    placed = _assigned(distinct, pivots, eps)
    # At most PIVOTS rows for each vector length.
    sizes = placed.where("own").groupBy("dim", "cell").count().collect()
    chunks = [(r.dim, r.cell, -(-r["count"] // max(1, min(chunk, CHUNK_BYTES // (8 * r.dim))))) for r in sizes]
    table = F.broadcast(rows.sparkSession.createDataFrame(chunks, "dim int, cell int, chunks int"))
    placed = placed.join(table, ["dim", "cell"])
    columns = ["dim", "cell", "k1", "k2", "rep", "m", "v"]
    mine = placed.where("own").select(*columns, F.pmod("k2", "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"))
    all_of = placed.select(*columns, F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(1).alias("kind"))
    links = cut(_joined(mine.union(all_of), cosine, min(5000, max(1, sum(c[2] for c in chunks)))))
    nodes = links.where("n IS NOT NULL").select("k1", "k2", "rep", "n")
    parts = connected_components(links.where("a IS NOT NULL").select("a", "b"))
    nodes = (nodes.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
             .select("k1", "k2", F.coalesce("component", "rep").alias("component"), "n"))
    return (every.join(nodes, ["k1", "k2"], "left")
            .select("vec_id", F.coalesce(F.greatest(F.col("n") - 1, F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").cast("long").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
