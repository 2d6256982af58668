"""Operators 7 and 8 against brute force."""

import random

import numpy as np
import pytest
import xxhash
from data import documents, empty, rows

from blotter.llm import embedding_join, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, n in enumerate(nodes):
        if n is not None:
            least[find(i)] = min(least.get(find(i), n), n)
    return [least.get(find(i)) for i in range(len(nodes))]


@pytest.mark.parametrize("most,clashes", [(50_000, True), (3, False)])
def test_simhash(spark, most, clashes):
    got = simhash.near_duplicates(documents(spark, clashes=clashes), most=most).collect()
    table = rows()
    fps = [brute_fingerprint(t) for _, t, *_ in table]
    comp = components([i for i, *_ in table], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    want = sorted(((i, f"{f:016x}", c) for (i, *_), f, c in zip(table, fps, comp)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_simhash_keeps_one(spark):
    docs = documents(spark, clashes=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    of = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(set(of.values()))
    assert set(ids) == set(of.values())


@pytest.mark.parametrize("seed", range(4))
def test_trie_links(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(12)}
    v = np.array(sorted(x & (1 << 64) - 1 for x in fps), np.uint64)
    x, y = simhash.trie_links(v, 3)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    assert len(got) == len(x)
    assert got == {(i, j) for j in range(len(v)) for i in range(j) if int(v[i] ^ v[j]).bit_count() <= 3}


def vectors():
    rng = np.random.default_rng(3)
    out = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            out.append(centre + rng.normal(size=16) * rng.choice([0.05, 0.12]))
    out = [v.astype(np.float32).tolist() for v in out]
    out += [out[0], out[0], [2 * x for x in out[1]], [0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 15 + [None],
            [float("inf")] + [1.0] * 15, [3.0, 4.0], [6.0, 8.0], [1e30] * 16, [1e-30] * 16]
    table = [(100 - i if i % 2 else 1000 + i, v, i) for i, v in enumerate(out)]
    return table + [table[4], (None, out[2], 7)]


@pytest.mark.parametrize("cell,chunk", [(8192, 8192), (20, 7)])
def test_embeddings(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    table = vectors()
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    got = embedding_join.link_vectors(df, chunk=chunk).collect()

    def ok(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    def linked(i, j):
        (a, v, _), (b, w, _) = table[i], table[j]
        return bool(ok(a, v) and ok(b, w)) and len(v) == len(w) and cosine(v, w) >= 0.95

    # Rows that repeat an id are one node.
    comp = components([i for i, *_ in table], lambda i, j: linked(i, j) or table[i][0] == table[j][0] and i != j)
    n = len(table)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    want = sorted(((i, k, c, i == c and i is not None) for (i, *_), k, c in zip(table, links, comp)), key=str)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
    assert got == want


def test_empty_tables(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_join.link_vectors(none).count() == 0
