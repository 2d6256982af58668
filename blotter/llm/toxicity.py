"""Toxicity (operator 10): a linear-chain CRF over word tokens, scored per document.

Only documents carry labels, so token labels come from them:

1. Over all labelled training rows, document counts of every word and word
   prefix (4, 5 and 6 bytes) are taken in toxic and other rows (pre-aggregated
   per slice, then summed by Spark).  Those nearly always in toxic rows are marks.
   Of marks the ``MARKS`` and of others the ``FEATURES`` most telling ones by
   z-score are the CRF's observation features.
2. A token of a toxic training row is labelled toxic if one of its features is
   a mark.  The CRF (two states, features of the current
   word, transitions) is fitted by gradient ascent on the conditional
   likelihood of a bounded sample (``SAMPLE`` distinct texts of each class, of any
   length, those of the least digests, each counting as often as it has rows).  A text of more than ``SAMPLE_BYTES``
   stands there by windows of ``WINDOW`` words that a hash draws among those with
   and without a marked word, each weighted by the windows it stands for.
3. Every text is tagged whole: forward-backward gives each token's marginal;
   their largest value and sum go through a logistic fit (same sample, whole
   texts, weighted to the class shares of all training rows) to the document score;
   runs of tokens with a marginal of 1/2 or more are the offending spans.

Rows whose crc32 of the id as text is a multiple of 5 are held out: neither
counted nor sampled.  Labels, lang, source and id are no inputs of a score.

Forward-backward over a slice of texts is one chain whose transitions restart
at each text.  It runs in blocks: transfer matrices of all blocks at once, a
short pass over the blocks, then all blocks' inner states at once.

Defined cases: null and empty texts (no words) get the score of no evidence; a
null id counts as the empty string (held out); of repeated labels the largest
counts, null ones are left out; without labelled rows of both classes every
score is the share of toxic training rows (0 without any).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from blotter.llm.common import cut, expand_rows, field, map_rows, pick, raw, with_row
from blotter.llm.decontaminate import WORD_BYTES

#: Features on the driver: marks, whose number follows the toxic words, and others.
MARKS, FEATURES = 200_000, 20_000
SAMPLE = 800
#: Bytes of words of one sampled text that the CRF is fitted on, words of a window, bytes sent of an unknown word.
SAMPLE_BYTES, WINDOW, WORD_SENT = 8_000, 64, 64
PREFIXES = (4, 5, 6)
#: A feature marks a token as toxic if so many of its documents are toxic, and by such a margin.
SHARE, MARGIN, LEAST_DOCS = 0.9, 6.0, 5
#: Most ranks of z-scores (in sixteenths).
RANKS = 16_000
BLOCK = 64
REMEMBERED = 1_000_000
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def features_of(word: bytes) -> list[bytes]:
    return [b"w" + word, *[b"%d" % k + word[:k] for k in PREFIXES if len(word) > k]]


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


# ---- the chain ----

def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray,
              pairs: bool = False, weight: np.ndarray | None = None):
    """Probability of the toxic state at each token.

    ``emit``: log-odds of the current word's evidence; ``first``: whether a token
    starts a text; ``trans`` and ``start``: positive weights (not normalised).
    With ``pairs`` also the expected numbers of the four transitions and of the
    two first states (a token counts ``weight`` times), and the log partition function.
    """
    n = len(emit)
    size = -(-n // BLOCK) * BLOCK
    e = np.ones(size)
    e[:n] = np.exp(np.clip(emit, -30, 30))
    reset = np.ones(size, bool)
    reset[:n] = first
    e, reset = e.reshape(-1, BLOCK).T.copy(), reset.reshape(-1, BLOCK).T.copy()
    # Step matrix at a token: rows are the state before, columns the state there.
    m = [np.where(reset, start[j], trans[i, j]) * (e if j else 1.0) for i in (0, 1) for j in (0, 1)]
    c = e.shape[1]

    def product(order):
        p00, p01, p10, p11 = np.ones(c), np.zeros(c), np.zeros(c), np.ones(c)
        scale = np.zeros(c)
        for k in order:
            a, b, x, y = (v[k] for v in m)
            p00, p01, p10, p11 = p00 * a + p01 * x, p00 * b + p01 * y, p10 * a + p11 * x, p10 * b + p11 * y
            top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
            p00, p01, p10, p11, scale = p00 / top, p01 / top, p10 / top, p11 / top, scale + np.log(top)
        return p00, p01, p10, p11, scale

    p = [v.tolist() for v in product(range(BLOCK))]
    a0, a1 = 0.5, 0.5
    enter0, enter1, log_z = np.empty(c), np.empty(c), 0.0
    for k in range(c):
        enter0[k], enter1[k] = a0, a1
        a0, a1 = a0 * p[0][k] + a1 * p[2][k], a0 * p[1][k] + a1 * p[3][k]
        s = a0 + a1
        log_z += math.log(s) + p[4][k]
        a0, a1 = a0 / s, a1 / s
    b0, b1 = 1.0, 1.0
    leave0, leave1 = np.empty(c), np.empty(c)
    for k in range(c - 1, -1, -1):
        leave0[k], leave1[k] = b0, b1
        b0, b1 = p[0][k] * b0 + p[1][k] * b1, p[2][k] * b0 + p[3][k] * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    alpha0, alpha1 = np.empty((BLOCK, c)), np.empty((BLOCK, c))
    x0, x1 = enter0, enter1
    for k in range(BLOCK):
        x0, x1 = x0 * m[0][k] + x1 * m[2][k], x0 * m[1][k] + x1 * m[3][k]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        alpha0[k], alpha1[k] = x0, x1
    beta0, beta1 = np.empty((BLOCK, c)), np.empty((BLOCK, c))
    y0, y1 = leave0, leave1
    for k in range(BLOCK - 1, -1, -1):
        beta0[k], beta1[k] = y0, y1
        y0, y1 = m[0][k] * y0 + m[1][k] * y1, m[2][k] * y0 + m[3][k] * y1
        s = y0 + y1
        y0, y1 = y0 / s, y1 / s
    toxic = alpha1 * beta1
    prob = (toxic / (toxic + alpha0 * beta0)).T.reshape(-1)[:n]
    if not pairs:
        return prob
    flat = [v.T.reshape(-1)[:n] for v in (alpha0, alpha1, beta0, beta1, *m)]
    before = [np.concatenate(([0.5], v[:-1])) for v in flat[:2]]
    joint = [before[i] * flat[4 + 2 * i + j] * flat[2 + j] for i in (0, 1) for j in (0, 1)]
    total = sum(joint)
    inner = ~first
    w = np.ones(n) if weight is None else weight
    moves = np.array([[(joint[2 * i + j] / total * w)[inner].sum() for j in (0, 1)] for i in (0, 1)])
    starts = np.array([((1 - prob) * w)[first].sum(), (prob * w)[first].sum()])
    return prob, moves, starts, log_z


# ---- fitting, on the driver, from bounded inputs ----

def marks_of(stats: dict[bytes, tuple[int, int]], share: float) -> set[bytes]:
    """The features that mark a token of a toxic row as toxic."""
    marks = set()
    for f, (n_all, n_tox) in stats.items():
        z = (n_tox - n_all * share) / math.sqrt(max(n_all * share * (1 - share), 1e-9))
        if n_all >= LEAST_DOCS and n_tox >= SHARE * n_all and z >= MARGIN:
            marks.add(f)
    return marks


def windows_of(words: list[bytes], stats: dict, marks: set[bytes]) -> tuple[list[bytes], list[float]]:
    """What the CRF is fitted on of one text, and how many windows each of them stands for."""
    # Of a long word that is no feature, the prefixes are all that counts; no word holds a zero byte.
    words = [w if len(w) <= WORD_SENT or b"w" + w in stats else w[:WORD_SENT] + b"\0" for w in words]
    if sum(map(len, words)) + len(words) <= SAMPLE_BYTES:
        return ([b" ".join(words)], [1.0]) if words else ([], [])
    kinds: tuple[list, list] = ([], [])
    for k in range(0, len(words), WINDOW):
        part = words[k:k + WINDOW]
        marked = not marks.isdisjoint(f for w in part for f in features_of(w))
        window = b" ".join(part)
        kinds[marked].append((zlib.crc32(window, k & 0xFFFFFFFF), k, window))
    out, weight, left = [], [], SAMPLE_BYTES
    few, many = sorted(kinds, key=len)
    for kind, most in ((few, SAMPLE_BYTES // 2), (many, SAMPLE_BYTES)):
        taken = []
        for *_, window in sorted(kind):
            most_left = min(most, left) - len(window)
            if taken and most_left < 0:
                break
            taken.append(window)
            most, left = most - len(window), left - len(window)
        out += taken
        weight += [len(kind) / len(taken)] * len(taken) if taken else []
    return out, weight


def fit_crf(texts: list[bytes], toxic: list[int], weight: list[float], stats: dict[bytes, tuple[int, int]],
            marks: set[bytes], rounds: int = 40) -> dict:
    """Feature weights, transitions and start weights from documents' derived token labels.

    ``texts``: words joined by spaces (one at least), each counting ``weight`` times."""
    ids = {f: i for i, f in enumerate(stats)}
    chains = [t.split(b" ") for t in texts]
    words = [w for ws in chains for w in ws]
    size = np.array([len(ws) for ws in chains], np.int64)
    first = np.zeros(len(words), bool)
    first[np.cumsum(size) - size] = True
    in_toxic = np.repeat(np.array(toxic, bool), size)
    times = np.repeat(np.array(weight, float), size)
    if len(words):
        times /= times.mean()
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = [features_of(w) for w in vocabulary]
    marked = np.array([any(f in marks for f in fs) for fs in own], bool)
    pair = np.array([(i, ids[f]) for i, fs in enumerate(own) for f in fs if f in ids], np.int64).reshape(-1, 2)
    token = np.array([vocabulary[w] for w in words], np.int64)
    label = marked[token] & in_toxic
    n = len(words)
    weights, bias = np.zeros(len(ids)), np.zeros(1)
    log_trans, log_start = np.zeros((2, 2)), np.zeros(2)
    inner = np.flatnonzero(~first)
    seen_moves = np.array([[times[inner][(label[inner - 1] == i) & (label[inner] == j)].sum() for j in (0, 1)]
                           for i in (0, 1)])
    seen_starts = np.array([times[first & ~label].sum(), times[first & label].sum()])
    seen = np.bincount(token[label], times[label], len(vocabulary))
    groups = [weights, bias, log_trans, log_start]
    past = [np.full(g.shape, 1e-8) for g in groups]
    for _ in range(rounds if n and label.any() else 0):
        word_score = bias + np.bincount(pair[:, 0], weights[pair[:, 1]], len(vocabulary))
        prob, moves, starts, _ = marginals(word_score[token], first, np.exp(log_trans), np.exp(log_start), True,
                                           times)
        miss = seen - np.bincount(token, prob * times, len(vocabulary))
        steps = [np.bincount(pair[:, 1], miss[pair[:, 0]], len(ids)) - 0.5 * weights, miss.sum(keepdims=True),
                 seen_moves - moves, seen_starts - starts]
        for g, p, s in zip(groups, past, steps):  # Adagrad: a rate for each weight
            p += s * s
            g += 0.5 * s / np.sqrt(p)
    return {"weights": {f: w for f, w in zip(ids, weights.tolist()) if w}, "bias": float(bias[0]),
            "trans": np.exp(log_trans), "start": np.exp(log_start)}


class Tagger:
    def __init__(self, crf: dict):
        self.crf = crf
        self.memory: dict[bytes, float] = {}

    def emissions(self, words: list[bytes]) -> list[float]:
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        get, bias = self.crf["weights"].get, self.crf["bias"]
        for w in set(words):
            if w not in memory:
                memory[w] = bias + sum(get(f, 0.0) for f in features_of(w))
        return [memory[w] for w in words]

    def tag(self, data: bytes, border: list[int]):
        """Marginals of all tokens, and each document's borders among them."""
        data = data.translate(WORD_BYTES)
        emit: list[float] = []
        at = [0]
        for a, b in zip(border, border[1:]):
            emit += self.emissions(data[a:b].split())
            at.append(len(emit))
        at = np.array(at)
        first = np.zeros(len(emit), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        prob = marginals(np.array(emit), first, self.crf["trans"], self.crf["start"]) if emit else np.zeros(0)
        return prob, at

    def evidence(self, prob: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each document: log-odds of its surest token, log of 1 plus the expected number, 1."""
        out = np.zeros((len(at) - 1, 3))
        out[:, 0], out[:, 2] = -12.0, 1.0
        some = np.flatnonzero(np.diff(at) > 0)
        if len(some):
            top = np.clip(np.maximum.reduceat(prob, at[some]), 6e-6, 1 - 6e-6)
            out[some, 0] = np.log(top / (1 - top))
            out[some, 1] = np.log1p(np.add.reduceat(prob, at[some]))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> dict:
    """The model: CRF and logistic weights.  Reads all labelled training rows, which are
    written once; brings to the driver at most ``MARKS + FEATURES`` counts and, of at most
    ``2 * SAMPLE`` distinct texts, about ``SAMPLE_BYTES`` of words and the evidence of the whole text."""
    known = (pick(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IS NOT NULL")
             .where(~held_out(F.col("id"))).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y")))
    texts = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").where(~held_out(F.col("id")))
    # Labels grow with the documents, so they are never broadcast.
    rows = cut(texts.join(known.hint("merge"), "id").select(
        "text", "y", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.monotonically_increasing_id().alias("at")))

    def make():
        def compute(batch):
            data, border = raw(batch.column("text"))
            data = data.translate(WORD_BYTES)
            every, toxic = Counter(), Counter()
            for a, b, y in zip(border, border[1:], batch.column("y").to_pylist()):
                own = {f for w in set(data[a:b].split()) for f in features_of(w)}
                every.update(own)
                if y:
                    toxic.update(own)
            return [list(every), list(every.values()), [toxic[f] for f in every]]

        return compute

    counted = StructType([field("feature", BinaryType()), field("n_all", LongType()), field("n_tox", LongType())])
    # Equal texts of a class are one: its number of rows, and one place to read it from.
    distinct = cut(rows.groupBy("y", "key").agg(F.count("*").alias("n"), F.min("at").alias("at")))
    sizes = {r.y: r for r in distinct.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()}
    n_all, n_tox = sum(r.n for r in sizes.values()), sizes[1].n if 1 in sizes else 0
    share = n_tox / n_all if n_all else 0.0
    if not 0 < n_tox < n_all:
        return {"share": share}
    z = (F.col("n_tox") - F.col("n_all") * share) / F.sqrt(F.col("n_all") * (share * (1 - share)))
    counts = cut(expand_rows(rows, counted, "text", make).groupBy("feature")
                 .agg(F.sum("n_all").alias("n_all"), F.sum("n_tox").alias("n_tox"))
                 .where(F.col("n_all") >= LEAST_DOCS)
                 .withColumn("rank", F.least(F.floor(F.abs(z) * 16), F.lit(RANKS)).cast("int"))
                 .withColumn("mark", (F.col("n_tox") >= SHARE * F.col("n_all")) & (z >= MARGIN)))
    found = strongest(counts.where("mark"), MARKS) + strongest(counts.where("NOT mark"), FEATURES)
    stats = {bytes(r.feature): (r.n_all, r.n_tox) for r in sorted(found, key=lambda r: bytes(r.feature))}
    chosen = []
    for y, r in sorted(sizes.items()):
        own = distinct.where(F.col("y") == y)
        if r.texts > 8 * SAMPLE:  # the least keys are among the first ones, of which four times as many are to be expected
            own = own.where(F.col("key") < F.lit(((4 * SAMPLE << 64) // r.texts).to_bytes(8, "big")))
        chosen.append(own.orderBy("key").limit(SAMPLE).select("at", "n"))
    drawn = cut(rows.join(F.broadcast(chosen[0].union(chosen[1])), "at").select("y", "key", "n", "text"))
    return fit(drawn, stats, share)


def strongest(counts: DataFrame, most: int) -> list:
    """The ``most`` rows of the highest ranks; of the last rank that has any, those of the least hashes."""
    least, held = RANKS + 1, 0
    for r in counts.groupBy("rank").count().orderBy(F.col("rank").desc()).collect():  # one row a rank
        if held + r["count"] > most:
            rest = counts.where(F.col("rank") == r["rank"]).orderBy(F.xxhash64("feature"), "feature").limit(most - held)
            return counts.where(F.col("rank") >= least).collect() + (rest.collect() if most > held else [])
        held, least = held + r["count"], r["rank"]
    return counts.where(F.col("rank") >= least).collect()


def fit(drawn: DataFrame, stats: dict[bytes, tuple[int, int]], share: float) -> dict:
    """The model from the sampled texts (y, key, n rows, text), which stay in the tasks."""
    marks = marks_of(stats, share)

    def show():
        def compute(batch):
            data, border = raw(batch.column("text"))
            data = data.translate(WORD_BYTES)
            return list(zip(*[windows_of(data[a:b].split(), stats, marks) for a, b in zip(border, border[1:])]))

        return compute

    def collected(new: StructType, make):
        rows = map_rows(drawn.select(F.struct("y", "key", "n").alias("row"), "text"), new, "text", make).collect()
        return sorted(rows, key=lambda r: (r.row.y, bytes(r.row.key)))

    sample = collected(StructType([field("windows", ArrayType(BinaryType())), field("times", ArrayType(DoubleType()))]), show)
    y = np.array([r.row.y for r in sample], float)
    if not 0 < y.sum() < len(y):
        return {"share": share}
    crf = fit_crf([bytes(w) for r in sample for w in r.windows], [r.row.y for r in sample for _ in r.windows],
                  [t * r.row.n for r in sample for t in r.times], stats, marks)

    def weigh():
        tagger = Tagger(crf)

        def compute(batch):
            data, border = raw(batch.column("text"))
            # Each text on its own, so that rounding does not depend on its neighbours.
            return [[tagger.evidence(*tagger.tag(data[a:b], [0, b - a]))[0] for a, b in zip(border, border[1:])]]

        return compute

    x = np.array([r.evidence for r in collected(StructType([field("evidence", ArrayType(DoubleType()))]), weigh)])
    n = np.array([r.row.n for r in sample], float)
    weight = len(n) * n * np.where(y == 1, share / n[y == 1].sum(), (1 - share) / n[y == 0].sum())
    return {"share": share, "crf": crf, "logistic": fit_logistic(x, y, weight)}


SPANS = ArrayType(ArrayType(LongType()))


def score(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None,
          spans: bool = False) -> DataFrame:
    """Per row: ``row`` (the carried columns) and score; with ``spans`` also the offending
    spans [start, end) in code points."""
    new = [field("score", DoubleType())] + ([field("spans", SPANS)] if spans else [])

    def make():
        tagger = Tagger(model["crf"]) if "crf" in model else None

        def compute(batch):
            n = batch.num_rows
            if tagger is None:
                return [[model["share"]] * n, [[]] * n][:1 + spans]
            data, border = raw(batch.column("text"))
            prob, at = tagger.tag(data, border)
            s = 1 / (1 + np.exp(-np.clip(tagger.evidence(prob, at) @ model["logistic"], -30, 30)))
            if not spans:
                return [s]
            out = [[] for _ in range(n)]
            hot = np.flatnonzero(prob >= 0.5)
            docs_hot = np.searchsorted(at, hot, side="right") - 1
            for d in np.unique(docs_hot).tolist():
                where = [m.span() for m in WORD.finditer(batch.column("text")[d].as_py())]
                last = -2
                for k in (hot[docs_hot == d] - at[d]).tolist():
                    if k == last + 1:
                        out[d][-1][1] = where[k][1]
                    else:
                        out[d].append([*where[k]])
                    last = k
            return [s, out]

        return compute

    return map_rows(with_row(docs, carry, text=text_col), StructType(new), "text", make)
