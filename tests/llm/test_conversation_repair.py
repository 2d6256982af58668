"""Operator 12 against a plain shortest path over whole conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from blotter.llm import conversation_repair as cr

SEEN = re.compile(r"[^ \t-\r]")
COLUMNS = ["conv_id", *cr.TOTALS, "audit", "repaired_sha256"]


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)


def cheapest(rows):
    """(cost, edits, texts) of the ASCII-least cheapest way; rows are (role, text, must go, truncated)."""
    @lru_cache(None)
    def go(i, said, inserted):
        """Edits from row i on, where ``said`` is the last initial that was put out ('' for none)."""
        forced = {"": "user", "s": "user", "u": "assistant", "a": "user"}[said]
        ways = []
        if i == len(rows) and said in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            c, e, t = go(i, forced[0], inserted + 1)
            ways.append((c + 3, "I" + e, (f"{forced}:", *t)))
        if i < len(rows):
            role, text, must_go, late = rows[i]
            c, e, t = go(i + 1, said, 0)
            ways.append((c + 4, "D" + e, t))
            if not must_go:
                if role[:1] == forced[0] or (said == "" and role[:1] == "s"):
                    c, e, t = go(i + 1, role[0], 0)
                    ways.append((c + 3 * late, "K" + e, (f"{role}:{text}", *t)))
                c, e, t = go(i + 1, forced[0], 0)
                ways.append((c + 3 + 3 * late, "R" + e, (f"{forced}:{text}", *t)))
        return min(ways, default=(10 ** 9, "~", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for said in ("", "s", "u", "a"):
            go(i, said, 0)
    return go(0, "", 0)


def brute(table):
    groups = {r[0]: [] for r in table}
    for r in damaged(table):
        groups[r[0]].append(r)
    out = []
    for conv_id, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        n, seen, marks = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in rows:
            last = SEEN.findall(text)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last[0] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, texts = cheapest(marks)
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed=0):
    rng = random.Random(seed)
    says = ["Yes.", "no", " ", "Why?", "ok!\n", "", "same.", None, "é…", "x" * 3000 + ".", "\x0bend. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "uncle", "", None, "admin"]
    out = []
    for conv in range(70):
        for turn in range(rng.choice([1, 2, 4, 9, 15])):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(says) if rng.random() < 0.4 else f"Line {rng.randrange(40)}{rng.choice(['.', '', '?'])}"
            out.append((conv if conv else None, turn * rng.choice([1, 1, 3]) if rng.random() < 0.95 else None, role, text))
    out += rng.sample(out, 20)  # repeated rows
    out += [(1000, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"turn {t % 90}" + ".?"[t % 2]) for t in range(400)]
    out += [(1 << 60, -5, "user", "Far."), (1 << 60, 1 << 62, "assistant", "Farther.")]
    dropped = next(i for i in range(2000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out += [(dropped, 0, "user", "gone."), (dropped, 0, "user", "gone too.")]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("'x' AS `range`", "'y' AS piece", "'z' AS digest", "1 AS copies", "*", "'t' AS symbols")


def run(spark, rows, **more):
    got = cr.repair(cr.damage(cr.conversation_rows(frame(spark, rows))), **more)
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed,sizes", [(0, None), (1, (700, 5, 400)), (2, (300, 64, 1 << 20))])
def test_conversations(spark, monkeypatch, seed, sizes):
    """With small ranges, pieces and parts, conversations span tasks."""
    if sizes:
        monkeypatch.setattr(cr, "PIECE", sizes[1])
        monkeypatch.setattr(cr, "PART", sizes[2])
    rows = table(seed)
    assert run(spark, rows, step=sizes and sizes[0]) == brute(rows)


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 16)
    rows = [(5, 3, "user", "Again?")] * 90 + [(5, 4, "assistant", "Again.")] * 3
    rows += [(5, t, "user", "Same text.") for t in range(10, 60)]
    assert run(spark, rows, step=500) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [(1, 1, "user", "x")][:0]) == []


def test_no_damage(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A.")]
    got = cr.repair(cr.conversation_rows(frame(spark, rows))).collect()[0]
    assert (got.cost, got.audit) == (0, "KKK")
    assert got.repaired_sha256 == hashlib.sha256(b"system:S.\nuser:Q?\nassistant:A.").hexdigest()


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_block_tables(block):
    """Lookups by blocks, cut anywhere in two pieces, give the plain shortest path and its least edits."""
    tables, rng = cr.Tables(block), random.Random(block)
    shown = [("tool", "", True, False)] + [(r, "", False, late) for r in ("system", "user", "assistant", "tool")
                                           for late in (False, True)]
    for _ in range(300):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(12)))
        cost, audit, _ = cheapest([shown[s] for s in symbols])
        at = rng.randrange(len(symbols) + 1)
        left, right = symbols[:at], symbols[at:]
        (to, add, _), (to2, add2, out2) = tables.summary(right), tables.summary(left)
        v = to[0]
        assert add[0] + add2[v] + tables.vectors[to2[v]][0] == cost
        state = out2[4 * v]
        edits = "".join(tables.trace(left, v, 0) + tables.trace(right, 0, state))
        end = tables.summary(right)[2][state]
        assert edits + cr.TAIL[end] == audit
