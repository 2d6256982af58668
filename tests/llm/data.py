"""Small fixtures: random prose with copies, shared passages, and every odd case."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])
#: Names that the operators use for columns of their own.
CLASHES = ("row", "id", "h", "fp", "digest", "key", "score", "spans", "ids", "component", "items", "n", "value")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def texts(seed: int = 0) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    out: list[str | None] = [None, "", " \t\n", "one", "two words", "é" * 250, "ab" * 400, prose(rng, 4000)]
    out += base
    out += [base[3], base[3], base[3].upper(), base[4] + " tail"]  # copies and a near copy
    out += [prose(rng, 20) + " " + passage + "\n" + prose(rng, 20) for _ in range(6)]  # a shared passage
    out += [base[5] + " " + base[6], "wher. " * 120, "\x0b\x0c\x1c a \x85 b   c"]
    out += [base[7][:-9] + prose(rng, 3), passage]
    return out


def rows(seed: int = 0) -> list[tuple]:
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(seed))]
    random.Random(seed + 1).shuffle(out)
    out += [out[5], out[5]]  # repeated rows
    out += [(None, "no id " * 60, None, None, None), (None, None, None, None, None)]
    return out


def documents(spark, seed: int = 0, clashes: bool = False):
    df = spark.createDataFrame(rows(seed), DOCS)
    if clashes:
        from pyspark.sql import functions as F
        df = df.select(*[F.lit(f"x{c}").alias(c) for c in CLASHES], "*")
    return df


def empty(spark, clashes: bool = False):
    return documents(spark, clashes=clashes).where("false")
