"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over all pieces reads the text once.  At each
character the automaton's state and its output links give every piece that
ends there; each relaxes the best score at its end from the best score at its
start (Viterbi).  Walking back from the end gives the pieces.

A model whose pieces hold the space mark only in front (or that consist of
marks) has no piece across a border from a non-mark to a mark.  The best path
therefore passes every such border, so a text is encoded word by word and the
words' best paths are kept in a bounded memory per task.  Without that property
the text is encoded in one run.

Rules: a space becomes the mark U+2581 and one is put in front of the text
(``add_dummy_prefix``).  A character that no piece covers costs the lowest piece
score less 10 and is written as its UTF-8 bytes (byte pieces) or as ``unk``.
Scores are summed as doubles; between equal scores the longer last piece wins.
Decoding joins the pieces, turns marks to spaces and drops the first.  So a
text round-trips unless it holds U+2581 itself, which comes back as a space.

Defined cases: a null text encodes to null; an empty text to no pieces (and
back); any length is encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from blotter.llm.common import field, map_rows, with_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNK_PENALTY = 10.0
#: Words that a task remembers; when full, the memory is emptied (results do not depend on it).
REMEMBERED = 400_000


def load_pieces(path: str = MODEL) -> dict:
    """The model's pieces as plain data (read on the driver; a vocabulary is small)."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    normal, byte_ids = {}, {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal[piece] = (i, float(sp.get_score(i)))
    return {"pieces": normal, "bytes": byte_ids, "unk": sp.unk_id(), "size": sp.get_piece_size()}


class Codec:
    def __init__(self, model: dict):
        self.pieces = model["pieces"]
        self.unk = model["unk"]
        self.byte_ids = [model["bytes"].get(b, self.unk) for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        if self.pieces:
            self.automaton.make_automaton()
        self.unk_score = min((s for _, s in self.pieces.values()), default=0.0) - UNK_PENALTY
        self.surface = [b""] * model["size"]
        for piece, (i, _) in self.pieces.items():
            self.surface[i] = piece.encode()
        for b, i in model["bytes"].items():
            self.surface[i] = bytes([b])
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.pieces)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memory: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path through ``text`` (marks already in place)."""
        n = len(text)
        low = float("-inf")
        # Plain lists are quicker; a very long run gets arrays of machine numbers.
        pack = array if n > 100_000 else lambda _, x: x
        best, sizes, ids = pack("d", [low]) * (n + 1), pack("i", [1]) * (n + 1), pack("i", [-1]) * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final

        def unknown(upto: int) -> None:
            # A character that no piece covers alone can always be passed as unknown.
            nonlocal done
            while done < upto:
                done += 1
                s = best[done - 1] + self.unk_score
                if s > best[done]:
                    best[done], sizes[done], ids[done] = s, 1, -1

        if self.pieces:
            for end, (size, score, i) in self.automaton.iter(text):
                unknown(end)
                s = best[end + 1 - size] + score
                if s > best[end + 1]:
                    best[end + 1], sizes[end + 1], ids[end + 1] = s, size, i
        unknown(n)
        out: list[int] = []
        while n:
            size, i = sizes[n], ids[n]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
                n -= 1
            else:
                out.append(i)
                n -= size
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as int32, in one byte string."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return np.array(self.viterbi(marked), np.int32).tobytes()
        memory = self.memory
        words = self.words.findall(marked)
        try:
            return b"".join([memory[w] for w in words])
        except KeyError:
            if len(memory) > REMEMBERED:
                memory.clear()
            local = {}
            for w in words:
                if w not in memory and w not in local:
                    got = np.array(self.viterbi(w), np.int32).tobytes()
                    (memory if len(w) <= 64 else local)[w] = got
            return b"".join([memory[w] if w in memory else local[w] for w in words])

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        data = b"".join([surface[i] for i in np.frombuffer(ids, np.int32).tolist()])
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def _coded(docs, text_col, carry, model, new, row_of):
    def make():
        codec = Codec(model)

        def compute(batch):
            rows = [row_of(codec, t) for t in batch.column("text").to_pylist()]
            return [list(c) for c in zip(*rows)]

        return compute

    return map_rows(with_row(docs, carry, text=text_col), new, "text", make)


def encode_texts(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: ``row`` (the carried columns) and ids (null for a null text)."""
    new = StructType([field("ids", ArrayType(IntegerType()))])
    return _coded(docs, text_col, carry, model, new,
                  lambda codec, t: [None if t is None else np.frombuffer(codec.encode(t), np.int32)])


def decode_ids(rows: DataFrame, model: dict, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Per row: ``row`` (the carried columns) and text (null for null ids)."""
    from pyspark.sql import functions as F
    new = StructType([field("text", StringType())])
    df = with_row(rows, carry, ids=ids_col).withColumn("size", F.col("ids").cast("string"))

    def make():
        codec = Codec(model)
        return lambda batch: [[None if x is None else codec.decode(np.array(x, np.int32).tobytes())
                               for x in batch.column("ids").to_pylist()]]

    return map_rows(df, new, "size", make)


CODED = StructType([field("n_pieces", LongType()), field("n_bytes", LongType()), field("ids_sha256", StringType()),
                    field("text_sha256", StringType()), field("round_trip", BooleanType())])


def round_trips(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: the digest of its ids (int32, little endian), of the text decoded
    from them, how many ids there are and are byte pieces, and whether the text came back."""
    byte_ids = np.zeros(model["size"], bool)
    byte_ids[list(model["bytes"].values())] = True

    def row_of(codec, text):
        if text is None:
            return [None] * 5
        ids = codec.encode(text)
        back = codec.decode(ids)
        return [len(ids) // 4, int(byte_ids[np.frombuffer(ids, np.int32)].sum()), hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text]

    return _coded(docs, text_col, carry, model, CODED, row_of)
