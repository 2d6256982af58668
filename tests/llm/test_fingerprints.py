"""Operator 13 against a symbol-by-symbol parser and a plain loop over the documents."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from data import documents, empty, rows
from pyspark.sql import functions as F

from blotter.llm import fingerprints as fp
from blotter.llm.anchors import mixed

U = 1 << 64


def mix(x):
    return int(mixed(np.array([x % U], np.uint64))[0])


def toss(x, before):
    low = 0 if before is None else ((x ^ before) & -(x ^ before)).bit_length() - 1
    return 2 * low + (x >> low & 1)


def plain_level(symbols, names):
    """(runs' first places, phrases as lists of run numbers, names of the phrases)."""
    runs = [(i, len(list(g))) for i, g in ((k[0][0], k) for k in (
        [(j, s) for j, s in g] for _, g in itertools.groupby(enumerate(symbols), key=lambda p: p[1])))]
    colour = [symbols[i] for i, _ in runs]
    for _ in range(4 if names is None else 3):
        colour = [toss(c, colour[k - 1] if k else None) for k, c in enumerate(colour)]
    for c in (5, 4, 3):
        colour = [min({0, 1, 2} - {*colour[max(k - 1, 0):k], *colour[k + 1:k + 2]}) if x == c else x
                  for k, x in enumerate(colour)]
    n = len(runs)
    start = [k == 0 or (2 <= k < n - 1 and colour[k - 1] < colour[k] > colour[k + 1]) for k in range(n)]
    place = [int(p) for p in fp.PLACE]
    name = [names[symbols[i]] if names else symbols[i] for i, _ in runs]
    name = [mix(x + place[-2] * size) if size > 1 else x for x, (_, size) in zip(name, runs)]
    phrases = []
    for k in range(n):
        if start[k]:
            phrases.append([])
        phrases[-1].append(k)
    return [runs[p[0]][0] for p in phrases], [
        mix(sum(name[k] * place[j] for j, k in enumerate(p)) + place[-1] * len(p)) for p in phrases]


def plain_levels(data):
    """Names of level 1, 2, ... with the first byte of each phrase."""
    if len(data) < 2:
        return []
    begin, symbols = plain_level(list(data), [int(x) for x in fp.BYTE])
    out = [(begin, symbols)]
    while len(symbols) > 1:
        at, symbols = plain_level(symbols, None)
        begin = [begin[k] for k in at]
        out.append((begin, symbols))
    return out


def strings():
    rng = random.Random(4)
    out = [b"", b"a", b"aa", b"ab", b"aba", b"a" * 300, b"ab" * 200, b"abc" * 99, b"a" * 40 + b"b" * 40 + b"a", bytes(range(256))]
    out += [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(400))) for _ in range(30)]
    out += [(t or "").encode() for _, t, *_ in rows()[:30]]
    return out


@pytest.mark.parametrize("segment", [1 << 18, 64, 7])
def test_parsing(monkeypatch, segment):
    monkeypatch.setattr(fp, "SEGMENT", segment)
    texts = strings()
    border = [0, *itertools.accumulate(map(len, texts))]
    got = {}
    for level, x, at, cuts, of, roots in fp.parsed(b"".join(texts), border):
        for k, d in enumerate(of.tolist()):
            if level:
                a, b = cuts[k], cuts[k + 1]
                got.setdefault(d, []).append(((at[a:b] - border[d]).tolist(), x[a:b].tolist()))
    for d, t in enumerate(texts):
        want = plain_levels(t)
        assert got.get(d, []) == want
        assert roots[d] == (want[-1][1][0] if want else int(fp.BYTE[t[0]]) if t else 0)


def phrases(data, level):
    for at_level, x, at, _, _, _ in fp.parsed(data, [0, len(data)]):
        if at_level == level:
            return list(zip(at.tolist(), at.tolist()[1:], x.tolist()))
    return []


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(2)
    word = lambda n: bytes(rng.randrange(97, 110) for _ in range(n))
    shared = word(3000)
    for _ in range(5):
        found = []
        for before, after in ((word(rng.randrange(300)), word(99)), (word(rng.randrange(300)), word(5))):
            data = before + shared + after
            found.append({(a - len(before), b - len(before), x) for a, b, x in phrases(data, 3)
                          if len(before) + 500 < a and b < len(before) + 2500})
        assert found[0] == found[1] and len(found[0]) > 20


def estimate(a, b):
    """Likeness from whole sets of names."""
    low = [sorted({n >> 32 for k, (_, x) in enumerate(plain_levels(t), 1) if 2 <= k <= 4 for n in x} or
                  ({plain_levels(t)[-1][1][0] >> 32} if len(t) > 1 else {int(fp.BYTE[t[0]]) >> 32} if t else set()))
           for t in (a, b)]
    if not low[0] or not low[1]:
        return float(low[0] == low[1])
    both = sorted({*low[0], *low[1]})[:fp.KEPT]
    return len({*both} & {*low[0]} & {*low[1]}) / len(both)


def brute(table):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    docs = sorted(table, key=order, reverse=True)
    out = []
    for (i, t, _), (j, u, _) in zip(docs, docs[1:] + docs[:1]):
        edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        out.append((i, j, len(t), hashlib.sha256(edited.encode()).hexdigest(),
                    round(estimate(t.encode(), edited.encode()), 9), round(estimate(t.encode(), u.encode()), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashes,step", [(False, None), (True, 3000), (False, 1)])
def test_compared_with_edits(spark, clashes, step):
    df = documents(spark, clashes=clashes)
    got = fp.compare_with_edits(df, step=step).collect()
    table = [(r.doc_id, r.text or "", r.h) for r in
             df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    assert sorted(((r.doc_id, r.next_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in got), key=str) == brute(table)
    by_id = {i: t for i, t, _ in table}
    prints = {}
    for r in got:
        if r.doc_id is not None:
            assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)  # different texts differ in their roots
    long = [r for r in got if r.n_chars > 300 and r.near_next < 1]
    assert np.mean([r.near_edited for r in long]) > 0.35 > 0.1 > np.mean([r.near_next for r in long])


def test_one_row_and_no_row(spark):
    one = fp.compare_with_edits(documents(spark).where("doc_id = 10").limit(1)).collect()
    assert len(one) == 1 and one[0].next_id == 10 and one[0].near_next == 1.0
    assert fp.compare_with_edits(empty(spark)).count() == 0


def test_fingerprint_columns(spark):
    df = fp.fingerprint(documents(spark, clashes=True), carry=["doc_id"]).select("row.*", "fingerprint")
    same = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = (same.alias("a").join(same.alias("b"), F.col("a.doc_id") == F.col("b.doc_id"))
           .select(fp.fingerprint_likeness("a.fingerprint", "b.fingerprint").alias("x"))).collect()
    assert {r.x for r in out} == {1.0}


def test_smallest_of_groups():
    rng = np.random.default_rng(0)
    size = [0, 1, 3, 64, 65, 900, 5000, 400]
    values = [rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for n in size]
    values[-1][:] = 1 << 31
    values[5][::2] = values[5][0]
    got = fp.smallest(np.concatenate(values), np.concatenate(([0], np.cumsum(size))))
    for v, g in zip(values, got):
        assert g.tolist() == sorted(set(v.tolist()))[:fp.KEPT]
