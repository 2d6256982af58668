"""Operator 11 against a literal run of every order over every row."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from data import documents, empty, rows

from blotter.llm import filter_audit

LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, 1), (8, 1, None), (9, 1, 0), (9, 1, 0), (12, 0, 1), (None, 1, 1),
          (30, 1, 0), (38, 1, 1), (39, 1, 0), (999, 1, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def fails(i, text, first):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return {f for f, bad in {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and first[text] < i}.items() if bad}


def brute(table):
    first = {}
    for i, t, *_ in table:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang, *_ in table:
        parts[lang or ""].append((i, fails(i, t or "", first)))
    out = []
    for part, docs in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failing = sum(f in d[1] for d in docs)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone),
                              sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone),
                              sum(d[0] in toxic for d in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


EXTRA = [(60, "A B C " * 50, "de", "s", 1), (61, "A B C " * 50, "fr", "s", 1), (62, "50% off", "", "s", 1),
         (60, "A B C " * 50, None, "s", 1), (59, "A B C " * 50, None, "s", 1), (59, "A B C " * 50, "de", "s", 1),
         (63, "x#" + " y z" * 80, "de", "s", 1), (64, "ÀÉ" * 90, None, "s", 1), (65, "ABC " * 120, "en", "s", 1)]


@pytest.mark.parametrize("clashes", [False, True])
def test_all_orders(spark, clashes):
    df = documents(spark, clashes=clashes)
    more = spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.unionByName(more, allowMissingColumns=True)
    got = filter_audit.audit_documents(df, labels(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows() + EXTRA)


def test_empty_tables(spark):
    assert filter_audit.audit_documents(empty(spark), labels(spark)).count() == 0
    assert filter_audit.audit_documents(documents(spark), labels(spark).where("false")).agg(
        {"good_lost": "sum"}).first()[0] == 0


def test_any_set_of_filters(spark):
    df = spark.createDataFrame([("p", True, None, 3), ("p", True, True, 2), ("q", False, False, 7)],
                               "part string, X boolean, Y boolean, n long")
    got = {tuple(r) for r in filter_audit.audit(df, "XY").collect()}
    assert got == {("p", "XY", 1, 0, 5, 0, 3, 7 + 1), ("p", "XY", 2, 0, 0, 2, 0, 2),
                   ("p", "YX", 1, 3, 2, 0, 0, 2), ("p", "YX", 2, 0, 3, 2, 3, 8),
                   ("q", "XY", 1, 7, 0, 0, 0, 0), ("q", "XY", 2, 7, 0, 0, 0, 0),
                   ("q", "YX", 1, 7, 0, 0, 0, 0), ("q", "YX", 2, 7, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit(df, "ABCDEFGHI")


def test_min_plus_ranks():
    orders = np.array(list(permutations(range(4))))
    steps = filter_audit.removal_steps(filter_audit.mask_matrix(4), filter_audit.position_matrix(orders))
    for mask in range(16):
        for j, order in enumerate(orders):
            want = next((s for s, f in enumerate(order, 1) if mask >> f & 1), None)
            assert steps[mask, j] == want if want else steps[mask, j] > 4
