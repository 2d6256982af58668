"""Conversation structure repair (operator 12): Four-Russians block tables.

A conversation is a string of symbols, one a row: what the repair must do with it
(delete it) or else its role's initial (system, user, assistant, other) and
whether its text is truncated.  The cheapest edits into the form ``(s?(ua)+)?``
are a shortest path whose state is one of four (nothing yet, after s, after u,
after a).  Read from the end, every row turns the vector of the four costs to go
into another one.  Less its minimum, the vector is one of some thirty, so all
transitions of ``BLOCK`` rows are tabulated once a task: vector and block of
symbols give the next vector and what is added to the minimum, and also the state
in which a cheapest way leaves the block.  Conversations are processed by lookup,
block by block from the end; then, from the front, each block is expanded
backward to the vectors of its rows, and the least edit that keeps the cost is
taken at each, which gives the ASCII-least of the cheapest edit strings.

Spark's part:

1. Rows are damaged (if asked), classified and cut down to ids, a digest and
   flags; equal rows of one turn become one row with a number.  Duplicates are
   found by an aggregation per conversation, role and digest.
2. These rows are dealt by ranges of (conversation, turn) of near-equal bytes
   (``ranges``), so that a conversation of any size is spread over tasks.  In
   each, pieces of at most ``PIECE`` symbols get a summary: for each vector at
   its right border the vector at its left one, the cost, and where each state
   leads.
3. Per conversation the summaries (270 bytes a piece) are put together: cost,
   each piece's vector on the right and state on the left.
4. Texts are shuffled once, by the same ranges, and meet their pieces, which are
   traced there.  A conversation that lies in one range is finished; of others
   each range gives the repaired text in parts of ``PART`` bytes.
5. Those parts are hashed in order.  One hash over a conversation's whole text
   has to be fed by one task, but it holds one part at a time; the audit, one
   letter an edit, is as long as the conversation by definition.

Defined cases: null role, text, and id or turn in the damage's key are one space;
rows without a conversation id are one conversation; rows that share a turn come
by role, then by SHA-256 of the text; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructType,
)

from blotter.llm.common import cut, field, pick
from blotter.llm.ranges import cut_keys, range_bytes, range_of

#: Symbols in a tabulated block.
BLOCK = 4
#: Symbols in a piece, rows in a task's output batch, bytes of a part of the repaired text.
PIECE, ROWS, PART = 1 << 16, 2000, 1 << 20

#: Costs of the edits (fixed values).
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The only role that an insertion or a new role can give.
FORCED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Symbols: 0 must be deleted; 1 + 2 * role + truncated for roles s, u, a, other.
SYMBOLS = 9
KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Edits that end a conversation in each state.
TAIL = ("", "II", "I", "")
FIRST_VECTOR = (0, 6, 3, 0)
LEGAL = ("su", "ua", "au")


# ---- tables ----

def stepped(after: tuple, symbol: int) -> tuple:
    """Costs to go before a row, from those after it."""
    cost = [DELETE + x for x in after]
    if symbol:
        role, late = divmod(symbol - 1, 2)
        for q in range(4):
            cost[q] = min(cost[q], REROLE + TRUNCATED * late + after[FORCED[q]])
            if q in KEEPS[role]:
                cost[q] = min(cost[q], TRUNCATED * late + after[KEEPS[role][q]])
    u, a = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + u), min(cost[1], INSERT + u), u, a


def least_edit(before: tuple, after: tuple, symbol: int, q: int) -> tuple[str, int]:
    """The ASCII-least edits of cheapest cost at a row in state ``q`` (D < I < K < R), and the state after them."""
    out = ""
    while True:
        if before[q] == DELETE + after[q]:
            return out + "D", q
        if before[q] == INSERT + before[FORCED[q]]:
            out, q = out + "I", FORCED[q]
            continue
        role, late = divmod(symbol - 1, 2)
        if q in KEEPS[role] and before[q] == TRUNCATED * late + after[KEEPS[role][q]]:
            return out + "K", KEEPS[role][q]
        return out + "R", FORCED[q]


class Tables:
    """Transitions of single rows and of blocks of ``block`` rows, over all normalised vectors."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        number, todo = {FIRST_VECTOR: 0}, [FIRST_VECTOR]
        for v in todo:
            for s in range(SYMBOLS):
                w = stepped(v, s)
                w = tuple(x - min(w) for x in w)
                if w not in number:
                    number[w] = len(number)
                    todo.append(w)
        self.vectors = todo
        n = len(todo)
        self.to = np.zeros((n, SYMBOLS), np.uint8)
        self.cost = np.zeros((n, SYMBOLS), np.int64)
        self.exit = np.zeros((n, SYMBOLS, 4), np.uint8)
        self.edit = {}
        for i, v in enumerate(todo):
            for s in range(SYMBOLS):
                w = stepped(v, s)
                self.cost[i, s] = min(w)
                self.to[i, s] = number[tuple(x - min(w) for x in w)]
                for q in range(4):
                    self.edit[i, s, q] = least_edit(w, v, s, q)
                    self.exit[i, s, q] = self.edit[i, s, q][1]
        self.block_to, self.block_cost, self.block_exit = self._composed(block)

    def _composed(self, block: int):
        """A block's code has its first symbol as lowest digit; it is read from its last symbol."""
        to, cost, out = self.to, self.cost, self.exit
        for _ in range(block - 1):
            n, codes = to.shape
            new = self.to[to]  # [vector, code of the rest, first symbol]
            add = self.cost[to] + cost[:, :, None]
            # Out of the first symbol into the rest.
            mid = self.exit[to]  # [vector, rest, symbol, state]
            end = np.take_along_axis(out[:, :, None, :].repeat(SYMBOLS, 2), mid.astype(np.int64), axis=3)
            to, cost, out = (x.reshape(n, codes * SYMBOLS, *x.shape[3:]) for x in (new, add, end))
        return to, cost, out

    def cut(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Symbols before the first whole block (blocks end at the right border), and the codes of the blocks."""
        x = np.frombuffer(symbols, np.uint8)
        head = len(x) % self.block
        digits = x[head:].reshape(-1, self.block).astype(np.int64)
        return x[:head], digits @ SYMBOLS ** np.arange(self.block)

    def summary(self, symbols: bytes) -> tuple[bytes, list[int], bytes]:
        """For each vector on the right: the vector on the left, the cost, and where the four states lead."""
        head, codes = self.cut(symbols)
        now = np.arange(len(self.vectors))
        cost = np.zeros(len(now), np.int64)
        right = []
        for code in codes[::-1]:
            right.append(now)
            cost += self.block_cost[now, code]
            now = self.block_to[now, code]
        single = []
        for s in head[::-1]:
            single.append(now)
            cost += self.cost[now, s]
            now = self.to[now, s]
        state = np.broadcast_to(np.arange(4), (len(now), 4)).astype(np.int64)
        for s, v in zip(head, single[::-1]):
            state = np.take_along_axis(self.exit[v, s], state, axis=1)
        for code, v in zip(codes, right[::-1]):
            state = np.take_along_axis(self.block_exit[v, code], state, axis=1)
        return now.astype(np.uint8).tobytes(), cost.tolist(), state.astype(np.uint8).tobytes()

    def trace(self, symbols: bytes, vector: int, q: int) -> list[str]:
        """The edits of each symbol, by blocks from the front, each expanded backward from its right border."""
        head, codes = self.cut(symbols)
        border = [vector]
        for code in codes[::-1].tolist():
            border.append(int(self.block_to[border[-1], code]))
        out = []
        whole = [symbols[len(head) + i * self.block:len(head) + (i + 1) * self.block] for i in range(len(codes))]
        for part in [bytes(head), *whole]:
            inner = [border.pop()]
            for s in part[:0:-1]:
                inner.append(int(self.to[inner[-1], s]))
            for s in part:
                edits, q = self.edit[inner.pop(), s, q]
                out.append(edits)
        return out


# ---- rows ----

def damage(rows: DataFrame) -> DataFrame:
    """Damages conv_id, turn, role, text by CRC-32 of ``conv_id:turn`` modulo 20; ``copies`` is 0, 1 or 2."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    way = F.crc32(key.cast("binary")) % 20
    text = F.col("text")
    return rows.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"))


def conversation_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and ``copies`` 1."""
    rows = pick(df, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
                       F.lit(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def classified(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and digest: how many, their bytes, and the first one's fault."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    seen = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    keys = ["conv_id", "turn", "role", "digest"]
    flat = _keyed(rows).select(*keys, "copies", F.octet_length("text").alias("bytes"), blank.alias("blank"),
                               (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("late"))
    one = flat.groupBy(*keys).agg(
        F.sum("copies").cast("long").alias("n"), F.sum("bytes").alias("bytes"), F.first("blank").alias("blank"),
        F.first("late").alias("late"))
    # Where several turns of a conversation say the same, all but the first of them are duplicates.
    again = (one.where("n > 0 AND NOT blank").groupBy("conv_id", "role", "digest")
             .agg(F.count("*").alias("times"), F.min("turn").alias("low"),
                  F.max(F.col("turn").isNull()).alias("null_turn"))
             .where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                                        F.col("digest").alias("d"), "low", "null_turn"))
    later = F.when(F.col("null_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    return (one.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("digest") == F.col("d")), "left")
            .select(*keys, "n", "bytes", "blank", "late", F.coalesce(later, F.lit(False)).alias("duplicate")))


PIECES = StructType([
    field("conv_id", LongType()), field("range", IntegerType()), field("piece", LongType()),
    field("turns", ArrayType(LongType())), field("roles", ArrayType(StringType())),
    field("digests", ArrayType(BinaryType())), field("sizes", ArrayType(LongType())), field("symbols", BinaryType()),
    field("to", BinaryType()), field("cost", ArrayType(LongType())), field("exit", BinaryType()),
    field("first", StringType()), field("last", StringType()), field("illegal", LongType()), field("blank", LongType()),
    field("duplicate", LongType()), field("truncated", LongType()), field("n_turns", LongType()),
    field("low", LongType()), field("high", LongType())])
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLACED = StructType([field("conv_id", LongType()), field("range", IntegerType()), field("piece", LongType()),
                     field("vector", IntegerType()), field("state", IntegerType()), field("ends", BooleanType()),
                     field("spread", BooleanType()), *[field(c, LongType()) for c in TOTALS]])
REPAIRED = StructType([field("conv_id", LongType()), *[field(c, LongType()) for c in TOTALS],
                       field("audit", StringType()), field("repaired_sha256", StringType())])
PARTS = StructType([field("range", IntegerType()), field("seq", LongType()), field("spread", BooleanType()),
                    field("part", BinaryType()), *REPAIRED.fields])


class Piece:
    """Symbols of consecutive rows of one conversation, and what is counted in them."""

    def __init__(self, conv_id, number: int, part: int):
        self.conv_id, self.number, self.part = conv_id, number, part
        self.rows: list[tuple] = []
        self.symbols = bytearray()
        self.first = self.last = None
        self.illegal = self.blank = self.duplicate = self.truncated = self.n_turns = 0
        self.low = self.high = None

    def add(self, turn, role: str, digest: bytes, n: int, symbol: int, fault: str | None) -> None:
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last = initial
        self.rows.append((turn, role, digest, n))
        self.symbols += bytes([symbol]) + bytes(n - 1)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

    def row(self, tables: Tables) -> dict:
        to, cost, out = tables.summary(bytes(self.symbols))
        turns, roles, digests, sizes = (list(x) for x in zip(*self.rows)) if self.rows else ([], [], [], [])
        return {"conv_id": self.conv_id, "range": self.part, "piece": self.number, "turns": turns, "roles": roles,
                "digests": digests, "sizes": sizes, "symbols": bytes(self.symbols), "to": to, "cost": cost, "exit": out,
                **{k: getattr(self, k) for k in ("first", "last", "illegal", "blank", "duplicate", "truncated",
                                                 "n_turns", "low", "high")}}


def make_pieces(rows: DataFrame, parts: int) -> DataFrame:
    """Pieces of the classified rows, which have a ``range``; a conversation without rows left has one empty piece."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    dealt = (rows.select("range", "conv_id", "turn", "role", "digest", "n", "blank", "late", "duplicate")
             .repartitionById(parts, F.col("range")).sortWithinPartitions("range", *order))

    def run(batches):
        schema = to_arrow_schema(PIECES)
        tables, out, piece, turn_of = Tables(), [], None, ()

        def closed():
            if piece.rows or not piece.number:
                out.append(piece.row(tables))

        for batch in batches:
            for part, conv_id, turn, role, digest, n, blank, late, duplicate in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if piece is None or (conv_id, part) != (piece.conv_id, piece.part):
                    if piece is not None:
                        closed()
                    piece, turn_of = Piece(conv_id, 0, part), ()
                if n:
                    role_at = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
                    symbol = 0 if blank or duplicate else 1 + 2 * role_at + late
                    fault = "blank" if blank else "duplicate" if duplicate else "truncated" if late else None
                    if turn is not None and (turn,) != turn_of:
                        turn_of = (turn,)
                        piece.n_turns += 1
                        piece.low, piece.high = turn if piece.low is None else piece.low, turn
                    copies = n
                    while copies:
                        # Copies after the first are duplicates, or blank.
                        now = min(copies, PIECE - len(piece.symbols))
                        piece.add(turn, role, digest, now, symbol, fault)
                        again = "blank" if blank else "duplicate"
                        setattr(piece, again, getattr(piece, again) + now - 1)
                        copies, symbol, fault = copies - now, 0, again
                        if len(piece.symbols) == PIECE:
                            closed()
                            piece = Piece(conv_id, piece.number + 1, part)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if piece is not None:
            closed()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, PIECES)


def joined(pieces: list[dict], tables: Tables) -> list[dict]:
    """Each piece of one conversation, in order, with its right vector, left state and the conversation's totals."""
    vector, cost, right = 0, 0, []
    for p in reversed(pieces):
        right.append(vector)
        cost += p["cost"][vector]
        vector = p["to"][vector]
    total = {k: sum(p[k] for p in pieces) for k in ("illegal", "blank", "duplicate", "truncated")}
    real = [p for p in pieces if p["first"] is not None]
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(real, real[1:]))
    low, high = ([p[k] for p in pieces if p[k] is not None] for k in ("low", "high"))
    total["gaps"] = max(high) - min(low) + 1 - sum(p["n_turns"] for p in pieces) if low else 0
    total["cost"] = cost + tables.vectors[vector][0] if real else 0
    state, last, out = 0, 0, []
    for p, v in zip(pieces, reversed(right)):
        out.append({"conv_id": p["conv_id"], "range": p["range"], "piece": p["piece"], "vector": v, "state": state,
                    "ends": False, "spread": pieces[0]["range"] != pieces[-1]["range"], **total})
        state = p["exit"][4 * v + state]
        last = len(out) - 1 if p["first"] is not None else last
    if real:
        out[last]["ends"] = True
    return out


def place_pieces(pieces: DataFrame) -> DataFrame:
    """``joined`` over all conversations: only summaries are shuffled."""
    cols = ["conv_id", "range", "piece", "to", "cost", "exit", "first", "last", "illegal", "blank", "duplicate",
            "truncated", "n_turns", "low", "high"]
    dealt = pieces.select(*cols).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "range", "piece")

    def run(batches):
        schema = to_arrow_schema(PLACED)
        tables, group, out = Tables(), [], []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["conv_id"] != group[0]["conv_id"]:
                    out += joined(group, tables)
                    group = []
                group.append(row)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if group:
            out += joined(group, tables)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, PLACED)


class Writer:
    """Edits of one conversation in one range: the audit, and the repaired text as a hash or as parts."""

    def __init__(self, head: dict):
        self.head = {k: head[k] for k in ("conv_id", "range", "spread", *TOTALS)}
        self.state, self.spread = head["state"], head["spread"]
        self.sha = hashlib.sha256()
        self.waiting: deque = deque()
        self.letters, self.lines, self.size, self.seq = [], [], 0, 0
        self.done: list[dict] = []

    def expect(self, piece: dict, edits: list[str]) -> None:
        """The rows of a piece, in order, wait for their texts; after the last one the conversation may end."""
        at = 0
        for turn, role, digest, n in zip(piece["turns"], piece["roles"], piece["digests"], piece["sizes"]):
            self.waiting.append(((turn, role, digest), "".join(edits[at:at + n]), False))
            at += n
        if piece["ends"]:
            key, letters, _ = self.waiting.pop()
            self.waiting.append((key, letters, True))

    def text(self, key: tuple, text: str) -> None:
        """A text comes for the entries at the front that have its key (further copies of it find none)."""
        while self.waiting and self.waiting[0][0] == key:
            _, letters, ends = self.waiting.popleft()
            for e in letters:
                if e == "K":
                    self.line(key[1], text)
                    self.state = KEEPS["sua".index(key[1][0])][self.state]
                elif e != "D":
                    self.state = FORCED[self.state]
                    self.line(ROLES[self.state], text if e == "R" else "")
            if ends:
                for _ in TAIL[self.state]:
                    self.state = FORCED[self.state]
                    self.line(ROLES[self.state], "")
                    letters += "I"
            self.letters.append(letters)

    def line(self, role: str, text: str) -> None:
        data = f"{role}:{text}\n".encode()
        self.lines.append(data)
        self.size += len(data)
        if self.size >= PART:
            self.flush()

    def flush(self) -> None:
        """Lines end in a newline here; that of the last one is held back."""
        data = b"".join(self.lines)
        if self.spread:
            self.give(data, None)
        else:
            self.sha.update(data[:-1])
        self.lines, self.size = ([] if self.spread or not data else [b"\n"]), 0

    def give(self, part: bytes | None, sha: str | None) -> None:
        self.done.append({**self.head, "seq": self.seq, "part": part, "audit": "".join(self.letters),
                          "repaired_sha256": sha})
        self.letters, self.seq = [], self.seq + 1

    def close(self) -> list[dict]:
        if self.waiting:
            raise ValueError("rows of a conversation have found no text")
        if self.spread:
            self.flush()
        else:
            self.sha.update(b"".join(self.lines)[:-1])
            self.give(None, self.sha.hexdigest())
        return self.done


def edited(rows: DataFrame, pieces: DataFrame, parts: int) -> DataFrame:
    """Texts meet the pieces of their range: a row per conversation that lies in one range, else parts in order.

    ``rows`` has range, conv_id, turn, role, digest, text; ``pieces`` what ``PIECES`` and ``PLACED`` have.
    """
    keys = ["range", "conv_id", "turn", "role", "digest"]
    inside = [c for c in pieces.columns if c not in ("range", "conv_id")]
    texts = rows.select(*keys, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), "text",
                        F.lit(None).cast(pieces.select(F.struct(*inside).alias("of")).schema["of"].dataType).alias("of"))
    heads = pieces.select("range", "conv_id", F.get("turns", F.lit(0)).alias("turn"),
                          F.coalesce(F.get("roles", F.lit(0)), F.lit("")).alias("role"),
                          F.coalesce(F.get("digests", F.lit(0)), F.lit(b"")).alias("digest"),
                          F.lit(0).alias("kind"), "piece", F.lit(None).cast("string").alias("text"),
                          F.struct(*inside).alias("of"))
    order = [F.col(c).asc_nulls_first() for c in (*keys, "kind", "piece")]
    dealt = heads.unionByName(texts).repartitionById(parts, F.col("range")).sortWithinPartitions(*order)

    def run(batches):
        schema = to_arrow_schema(PARTS)
        tables, writer, out = Tables(), None, []
        for batch in batches:
            for part, conv_id, *key, kind, _, text, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    writer.text(tuple(key), text)
                    continue
                if writer is None or (writer.head["conv_id"], writer.head["range"]) != (conv_id, part):
                    if writer:
                        out += writer.close()
                    writer = Writer({"conv_id": conv_id, "range": part, **piece})
                writer.expect(piece, tables.trace(piece["symbols"], piece["vector"], piece["state"]))
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if writer and writer.done:  # parts of a long conversation
                yield pa.RecordBatch.from_pylist(writer.done, schema)
                writer.done = []
        if writer:
            out += writer.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, PARTS)


def gathered(parts: DataFrame) -> DataFrame:
    """One row per conversation: the parts of those that span ranges are hashed in order, one at a time."""
    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "range", "seq")

    def run(batches):
        schema = to_arrow_schema(REPAIRED)
        out, row, sha, audit, held = [], None, None, [], b""

        def closed():
            sha.update(held[:-1])
            out.append({**row, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for i in range(batch.num_rows):
                part = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if row is not None and part["conv_id"] != row["conv_id"]:
                    closed()
                    row = None
                if not part["spread"]:
                    out.append(part)
                else:
                    if row is None:
                        row, sha, audit, held = part, hashlib.sha256(), [], b""
                    if part["part"]:
                        sha.update(held)
                        held = part["part"]
                    audit.append(part["audit"])
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if row is not None:
            closed()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, REPAIRED)


def repair(rows: DataFrame, step: int | None = None) -> DataFrame:
    """Audit, costs and digest of the repaired text of every conversation.

    ``rows`` has conv_id, turn, role, text and ``copies`` (0: the row is gone),
    as ``conversation_rows`` and ``damage`` give.  ``step`` is the bytes in a range,
    by default what ``ranges.range_bytes`` says.
    """
    small = cut(classified(rows))
    # A row weighs something besides its text.
    weighed = small.select("conv_id", "turn", (F.col("bytes") + 100).alias("weight"))
    cuts = cut_keys(weighed, ["conv_id", "turn"], "weight", step or range_bytes(weighed, "weight"))
    at = range_of(cuts, "conv_id", "turn").alias("range")
    pieces = cut(make_pieces(small.select("*", at), len(cuts) + 1))
    placed = place_pieces(pieces)
    own = pieces.select("conv_id", "range", "piece", "turns", "roles", "digests", "sizes", "symbols")
    both = own.join(placed.withColumnsRenamed({"conv_id": "c", "range": "p", "piece": "k"}),
                    F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("p"))
                    & (F.col("piece") == F.col("k"))).drop("c", "p", "k")
    texts = _keyed(rows.where("copies > 0")).select("*", at)
    return gathered(edited(texts, both, len(cuts) + 1))
