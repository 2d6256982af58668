"""Secret scans (operator 6): base patterns plus a recursive decoding worklist.

The base pass finds three kinds in the text as it stands.  The worklist then
unwraps layers until nothing new appears:

* URL escapes (``%41``) and Unicode escapes (``\\u0041``, ``\\x41``,
  ``\\101``, ``&#65;``, ``&#x41;``, ``&equals;``) are decoded over a whole layer,
  keeping the original span of every decoded character;
* base64 runs (both alphabets), joined over line breaks and quoted pieces, are
  decoded in all four alignments, as what stands in front may belong to the
  alphabet; bytes that are no text stand as one character each, and UTF-16 as one
  character a unit.  gzip, zlib, bzip2 or xz data that begins with any group of four
  in them, and deflated data without a header at their start, is unpacked.

Every layer is scanned with the base patterns and its spans are mapped to the
document's code points: through the characters' spans for escapes, to the
groups of four for base64, and to the whole run for compressed data.  A layer
is keyed by its text and the region it came from; one seen before is not
unwrapped again, so cycles end.  A span found in several layers counts once.

Memory: compressed data is unpacked to its end, members that follow each other
included, and sieved as a stream (``Sieve``): of what is inside only the kinds
matter, as all of it maps to the whole run.

Defined cases: null or empty text has no spans; any text length is scanned
whole; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from html.entities import html5

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from blotter.llm.common import field, map_rows, raw, with_row

#: Bytes fed to a decompressor at once; bytes scanned at once, without a place to cut at, and again.
FEED = 64 << 10
PIECE, LONGEST, OVERLAP = 8 << 20, 32 << 20, 64 << 10
MASK = "[SECRET]"

# The kinds in their order, their patterns and the least length of what must be long.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Shortest base64 run that can hold a secret: 16 bytes.
LEAST_RUN = 22
#: A line end inside base64: plain or written out, and where the lines are quoted pieces, with what joins them.
LINE_END = r"""(?:["'][ \t]*[+,.&\\]?)?[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t]*(?:[+.&]?[ \t]*["'])?"""
BREAK = re.compile(LINE_END)
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]++(?:{LINE_END}[A-Za-z0-9+/_-]++)*+={{0,2}}")
#: The least of plain characters side by side that a decoded secret, plain or wrapped again, has.
PLAIN = re.compile(rb"[\t\n\r -~]{16}")
#: The same in UTF-16, either byte order.
WIDE = (re.compile(rb"(?:[\t\n\r -~]\0){16}"), re.compile(rb"(?:\0[\t\n\r -~]){16}"))
MAGIC = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ|x[\x01\x5e\x9c\xda]")
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\[0-3][0-7]{2})+"
                    r"|&[A-Za-z][A-Za-z0-9]{1,31};|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
PACKED = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor),
          (b"\xfd7zXZ", lzma.LZMADecompressor), (b"x\x01", zlib.decompressobj),
          (b"x\x5e", zlib.decompressobj), (b"x\x9c", zlib.decompressobj), (b"x\xda", zlib.decompressobj))

#: A dot for each byte at which no pattern, escape or base64 run goes on.
GOING_ON = bytes(120 if re.match(r"[A-Za-z0-9+/_.=:\s\\%&#;{}'\"-]", chr(b)) and b < 128 else 46 for b in range(256))
HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping per kind."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in data.translate(HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def _chars(run: str) -> list[tuple[str, int, int]]:
    """Decoded characters of one run of escapes, each with its place in the run."""
    if run[0] == "&" and run[1] != "#":  # a name without a character stays
        return [(c, 0, len(run)) for c in html5[run[1:]]] if run[1:] in html5 else [
            (c, i, i + 1) for i, c in enumerate(run)]
    if run[0] == "%" or run[:2] == "\\x" or run[1] in "0123":
        width = 3 if run[0] == "%" else 4
        if run[0] == "\\" and run[1] != "x":
            data = bytes(int(run[i + 1:i + 4], 8) for i in range(0, len(run), 4))
        else:
            data = bytes.fromhex(run.replace("%" if width == 3 else "\\x", ""))
        out, at = [], 0
        for c in data.decode("utf-8", "replace"):
            size = 1 if c == "�" else len(c.encode())
            out.append((c, at * width, min((at + size) * width, len(run))))
            at = min(at + size, len(data) - 1)
        return out
    if run[:2] == "\\u" and run[2] != "{":
        units = [int(run[i + 2:i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
            out.append((chr(code) if pair or not 0xD800 <= code < 0xE000 else "�", 6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    digits = run.strip("&#;\\uU{}")
    code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits, 10 if run[0] == "&" else 16)
    ok = 0 < code < 0x110000 and not 0xD800 <= code < 0xE000
    return [(chr(code) if ok else "�", 0, len(run))]


class Layer:
    """A text unwrapped from ``parent``; ``to_parent`` maps a span of it to one of the parent's."""

    def __init__(self, text: str, parent: Layer | None = None, to_parent=None):
        self.text, self.parent, self.to_parent = text, parent, to_parent

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The document's span behind [a, b)."""
        layer = self
        while layer.parent is not None:
            a, b = layer.to_parent(a, b)
            layer = layer.parent
        return a, b

    def key(self):
        text = self.text.encode("utf-8", "surrogatepass")
        return text if len(text) <= 32 else hashlib.sha256(text).digest(), len(text), self.span(0, len(self.text))

    def unescaped(self) -> Layer | None:
        """The layer with its escapes decoded; keeps places of decoded characters and plain stretches only."""
        text: list[str] = []
        new: list[int] = []  # where a piece begins in the new text, and its place in this one
        start: list[int] = []
        end: list[int] = []
        size = at = 0

        def add(piece: str, a: int, b: int) -> None:
            nonlocal size
            if piece:
                text.append(piece)
                new.append(size)
                start.append(a)
                end.append(b)
                size += len(piece)

        for m in ESCAPE.finditer(self.text):
            add(self.text[at:m.start()], at, m.start())
            for c, a, b in _chars(m[0]):
                add(c, m.start() + a, m.start() + b)
            at = m.end()
        if not at:
            return None
        add(self.text[at:], at, len(self.text))

        def to_parent(a: int, b: int) -> tuple[int, int]:
            i, j = bisect_right(new, a) - 1, bisect_right(new, b - 1) - 1
            # A plain stretch is as long as its source; in it, places go side by side.
            return (start[i] + (a - new[i] if len(text[i]) == end[i] - start[i] else 0),
                    start[j] + b - new[j] if len(text[j]) == end[j] - start[j] else end[j])

        return Layer("".join(text), self, to_parent)

    def inner(self):
        """The layers inside, one at a time."""
        if "%" in self.text or "\\" in self.text or "&" in self.text:
            layer = self.unescaped()
            if layer is not None:
                yield layer
        yield from self.unwrapped()

    def unwrapped(self):
        """Layers inside the base64 runs."""
        for m in BASE64.finditer(self.text):
            if m.end() - m.start() < LEAST_RUN:
                continue
            body = m[0].rstrip("=")
            lines = _lines(body, m.start())
            for a, line in lines if len(lines) > 1 else []:
                if len(line) >= LEAST_RUN:
                    yield from self._decoded([(a, line)], m.end() if a + len(line) == m.start() + len(body) else a + len(line), 0)
            if sum(len(line) for _, line in lines) >= LEAST_RUN:
                for shift in range(4):
                    yield from self._decoded(lines, m.end(), shift)

    def _decoded(self, lines: list[tuple[int, str]], end: int, shift: int):
        """Layers of the lines (place, characters) decoded as one run that begins ``shift`` characters later."""
        run = "".join(line for _, line in lines)
        body = run[shift:].replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            body = body[:-1]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        new = [0]
        for _, line in lines:
            new.append(new[-1] + len(line))

        def place(k: int) -> int:
            i = bisect_right(new, k, 0, len(lines)) - 1
            return lines[i][0] + k - new[i]

        def region(a: int, b: int) -> tuple[int, int]:
            first, last = shift + a // 3 * 4, shift + -(-b // 3) * 4
            return place(first), place(last - 1) + 1 if last < len(run) else end

        for m in MAGIC.finditer(data):
            if m.start() % 3 == 0:
                yield from self._kinds(_members(data, m.start()), region(m.start(), len(data)))
        if not PLAIN.match(data):  # deflated data without a header begins with no magic
            yield from self._kinds(_deflated(data), region(0, len(data)))
        for wide, order in zip(WIDE, ("<u2", ">u2")):
            for odd in {m.start() % 2 for m in wide.finditer(data)}:
                units = np.frombuffer(data, order, (len(data) - odd) // 2, odd)
                # One character a unit, so that places can be counted.
                yield Layer("".join(map(chr, units.tolist())), self,
                            lambda a, b, odd=odd: region(odd + 2 * a, odd + 2 * b))
        if PLAIN.search(data):
            # A byte that is no text becomes one character, so that places can be counted.
            text = data.decode("utf-8", "surrogateescape")
            if text.isascii():
                yield Layer(text, self, region)
                return
            size = [len(c.encode("utf-8", "surrogateescape")) for c in text]
            before = np.concatenate(([0], np.cumsum(size)))
            yield Layer(text, self, lambda a, b: region(int(before[a]), int(before[b])))

    def _kinds(self, chunks, whole: tuple[int, int]):
        """For compressed data: a layer with a found sample of each kind in it, all of them at the whole run."""
        sieve = Sieve()
        for chunk in chunks:
            sieve.feed(chunk)
            if sieve.full():
                break
        sieve.close()
        for kind in sorted(sieve.kinds):
            yield Found(kind, self, whole)


def _members(data: bytes, at: int):
    """The bytes of the compressed data that begins there and of what follows it, in pieces."""
    view = memoryview(data)
    while at < len(data):
        opened = next((opened for magic, opened in PACKED if data.startswith(magic, at)), None)
        if opened is None:
            if data[at]:
                return
            at += 1  # padding
            continue
        unpack = opened()
        try:
            while not unpack.eof and at < len(data):
                feed = view[at:at + FEED]
                at += len(feed)
                while True:
                    out = unpack.decompress(feed, PIECE)
                    if out:
                        yield out
                    feed = getattr(unpack, "unconsumed_tail", b"")
                    if unpack.eof or not feed and len(out) < PIECE:
                        break
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        if not unpack.eof:
            return
        at -= len(unpack.unused_data)


def _deflated(data: bytes):
    """What inflates from bare deflated data, if that has an end; else nothing."""
    unpack, held = zlib.decompressobj(-15), []
    try:
        feed = data
        while feed and not unpack.eof:
            out = unpack.decompress(feed, PIECE)
            feed = unpack.unconsumed_tail
            if not out and not unpack.eof:
                return
            if held is None:
                yield out
            else:
                held.append(out)
                # Random bytes hardly ever inflate so far; what does is handed on as it comes.
                if sum(map(len, held)) >= FEED:
                    yield b"".join(held)
                    held = None
    except zlib.error:
        return
    if held and unpack.eof and sum(map(len, held)) >= LEAST["assign"]:
        yield b"".join(held)


class Found:
    """Stands for a kind that was found in compressed data, with the span of its run."""

    def __init__(self, kind: int, parent: Layer, whole: tuple[int, int]):
        self.kind, self.parent, self.whole = kind, parent, whole

    def span(self) -> tuple[int, int]:
        return self.parent.span(*self.whole)


class Sieve:
    """The kinds in a stream of bytes, base patterns and all layers.

    Places do not matter inside compressed data, so only kinds are kept.  The stream
    is scanned in pieces of about ``PIECE`` bytes.  A piece ends where no pattern,
    escape or base64 goes on.  Where there is no such place in ``LONGEST`` bytes, one
    run of base64 or of escapes goes on for so long: what is held is scanned, and the
    run is then decoded as a stream, each alignment into a sieve of its own, until it
    ends.  So nothing is cut, whatever the length, and no more than ``LONGEST`` bytes a
    level are held.
    """

    def __init__(self, kinds: set | None = None):
        self.kinds = set() if kinds is None else kinds
        self.held = bytearray()
        self.open: list = []

    def full(self) -> bool:
        return len(self.kinds) == len(KINDS)

    def feed(self, data: bytes) -> None:
        if self.full():
            return
        for run in self.open:
            run.feed(data)
        self.open = [r for r in self.open if not r.over]
        self.held += data
        while len(self.held) >= PIECE:
            end = self.held.translate(GOING_ON).rfind(b".") + 1
            if end <= 2 * OVERLAP:
                if len(self.held) < LONGEST:
                    return
                end = len(self.held)
                if not self.open:
                    for kind in (Base64Run, EscapeRun):
                        self.open += kind.begin(bytes(self.held), self.kinds)
            self.scan(self.held[:end])
            del self.held[:end - OVERLAP]

    def scan(self, data: bytes) -> None:
        for _, kind, _ in all_spans(data.decode("utf-8", "replace"))[1]:
            self.kinds.add(kind)

    def close(self) -> None:
        for run in self.open:
            run.close()
        if self.held and not self.full():
            self.scan(self.held)


class Base64Run:
    """A run of base64 that goes on: one alignment of it, decoded as it comes."""

    TAIL = re.compile(rb"[A-Za-z0-9+/_\s\\\"'.,&-]*\Z")

    @classmethod
    def begin(cls, held: bytes, kinds: set) -> list:
        """The four alignments of the run that ``held`` ends in."""
        text = held.decode("utf-8", "replace")
        last = None
        for last in BASE64.finditer(text):
            pass
        if last is None or last.end() < len(text) - 8 or last.end() - last.start() < OVERLAP:
            return []
        out = []
        for shift in range(4):
            run = cls(shift, kinds)
            run.feed(text[last.start():].encode())
            out.append(run)
        return out

    def __init__(self, shift: int, kinds: set):
        self.skip, self.kinds, self.over = shift, kinds, False
        self.rest, self.tail, self.whole = b"", b"", Sieve(kinds)
        self.packed: list = []

    def feed(self, data: bytes) -> None:
        data = self.rest + data
        end = next((m.start() for m in re.finditer(rb"[^A-Za-z0-9+/_\s\\\"'.,&-]", data)), len(data))
        self.over = end < len(data)
        # A line end may be cut at the border.
        cut = end if self.over else max(data.rfind(b"\n", 0, end - 16), end - 16, 0)
        body, self.rest = data[:cut], data[cut:end]
        body = BREAK.sub("", body.decode("latin-1")).encode("latin-1")
        body = re.sub(rb"[^A-Za-z0-9+/_-]", b"", body).replace(b"-", b"+").replace(b"_", b"/")
        drop = min(self.skip, len(body))
        self.skip -= drop
        body = self.tail + body[drop:]
        whole = len(body) // 4 * 4
        self.tail = body[whole:]
        self.give(base64.b64decode(body[:whole]))
        if self.over:
            self.close()

    def give(self, data: bytes) -> None:
        for p in self.packed:
            p.feed(data)
        self.packed = [p for p in self.packed if not p.over]
        for m in MAGIC.finditer(data):
            if m.start() % 3 == 0:
                p = PackedRun(self.kinds)
                p.feed(data[m.start():])
                if not p.over:
                    self.packed.append(p)
        self.whole.feed(data)

    def close(self) -> None:
        if self.rest:
            rest, self.rest = re.sub(rb"[^A-Za-z0-9+/_-]", b"", self.rest), b""
            self.tail += rest.replace(b"-", b"+").replace(b"_", b"/")
        body = self.tail if len(self.tail) % 4 != 1 else self.tail[:-1]
        self.tail = b""
        if body:
            self.give(base64.b64decode(body + b"=" * (-len(body) % 4)))
        for p in self.packed:
            p.close()
        self.whole.close()


class PackedRun:
    """Compressed data that comes in pieces, members that follow each other included."""

    def __init__(self, kinds: set):
        self.over, self.unpack, self.held, self.sieve = False, None, b"", Sieve(kinds)

    def feed(self, data: bytes) -> None:
        self.held += data
        while self.held and not self.over:
            if self.unpack is None:
                self.held = self.held.lstrip(b"\0")
                if len(self.held) < 6:
                    return
                opened = next((o for magic, o in PACKED if self.held.startswith(magic)), None)
                if opened is None:
                    break
                self.unpack = opened()
            try:
                out = self.unpack.decompress(self.held, PIECE)
                if out:
                    self.sieve.feed(out)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                break
            self.held = self.unpack.unused_data if self.unpack.eof else getattr(self.unpack, "unconsumed_tail", b"")
            if self.unpack.eof:
                self.unpack = None
            elif not self.held and getattr(self.unpack, "needs_input", True):
                return
        else:
            return
        self.over = True
        self.sieve.close()

    def close(self) -> None:
        if not self.over:
            self.sieve.close()


class EscapeRun:
    """Escapes that go on, decoded as they come (with the plain text between them)."""

    @classmethod
    def begin(cls, held: bytes, kinds: set) -> list:
        if not ESCAPE.search(held[-OVERLAP:].decode("utf-8", "replace")):
            return []
        run = cls(kinds)
        run.feed(held)
        return [run]

    def __init__(self, kinds: set):
        self.over, self.rest, self.sieve = False, b"", Sieve(kinds)

    def feed(self, data: bytes) -> None:
        data = self.rest + data
        # An escape may be cut at the border: 34 bytes at most, from its first character on.
        cut = next((len(data) - k for k in range(min(34, len(data)), 0, -1) if data[-k] in b"%\\&"), len(data))
        self.rest = data[cut:]
        layer = Layer(data[:cut].decode("utf-8", "replace"))
        plain = layer.unescaped()
        self.over = plain is None and len(data) > OVERLAP
        self.sieve.feed((plain or layer).text.encode("utf-8", "replace"))
        if self.over:
            self.close()

    def close(self) -> None:
        if self.rest:
            layer, self.rest = Layer(self.rest.decode("utf-8", "replace")), b""
            self.sieve.feed((layer.unescaped() or layer).text.encode("utf-8", "replace"))
        self.sieve.close()


def _lines(body: str, at: int) -> list[tuple[int, str]]:
    """The lines of a joined run, each with its place in the text."""
    out, k = [], 0
    for m in BREAK.finditer(body):
        out.append((at + k, body[k:m.start()]))
        k = m.end()
    return [*out, (at + k, body[k:])]


def all_spans(text: str, data: bytes | None = None) -> tuple[list, list]:
    """Base spans, and the base spans with those of all decoded layers."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    base = base_spans(text, data)
    found = set(base)
    seen = set()
    todo = [iter([Layer(text)])]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if isinstance(layer, Found):
            s, e = layer.span()
            found.add((s, layer.kind, e))
            continue
        if not layer.text or (key := layer.key()) in seen:
            continue
        seen.add(key)
        if layer.parent is not None:
            for a, kind, b in base_spans(layer.text):
                s, e = layer.span(a, b)
                found.add((s, kind, e))
        todo.append(layer.inner())
    return base, sorted(found)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


SPAN = StructType([field("kind", StringType()), field("start", LongType()), field("end", LongType())])


def scan_secrets(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
                 clean: bool = False) -> DataFrame:
    """Per row: ``row`` (the carried columns), base and spans (kind, start, end);
    with ``clean`` also clean_text, the text with every span masked."""
    new = [field("base", ArrayType(SPAN)), field("spans", ArrayType(SPAN))]
    if clean:
        new.append(field("clean_text", StringType()))

    def make():
        def told(spans):
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def compute(batch):
            data, border = raw(batch.column("text"))
            texts = batch.column("text").to_pylist()
            out = [[], [], []]
            for text, a, b in zip(texts, border, border[1:]):
                base, spans = all_spans(text, data[a:b]) if text else ([], [])
                out[0].append(told(base))
                out[1].append(told(spans))
                if clean:
                    out[2].append(masked(text, spans) if spans else text)
            return out[:2 + clean]

        return compute

    return map_rows(with_row(docs, carry, text=text_col), StructType(new), "text", make)


def span_list(col: str):
    """``kind:start:end`` of each span, comma-joined in span order."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts per kind, the digest of the base spans and the list of all spans."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("row.*", *[count(k) for k in KINDS],
                        F.sha2(span_list("base").cast("binary"), 256).alias("base_sha256"),
                        span_list("spans").alias("spans"))
