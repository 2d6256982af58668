"""The corpus pipeline: five stages over ``documents``, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import decontaminate, secret_scan, sentencepiece_codec, simhash, toxicity
from blotter.llm.common import cut
from blotter.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is 1/2 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words in benchmark windows go; others stay as they are."""
    found = decontaminate.locate_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found).where("NOT contaminated").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; found secrets are masked, and n_chars follows the text."""
    found = secret_scan.scan_secrets(docs, clean=True)
    changed = F.size("spans") > 0

    def column(name: str):
        own = F.col("row").getField(name)
        if name == "text":
            return F.when(changed, F.col("clean_text")).otherwise(own).alias(name)
        if name == "n_chars":
            return F.when(changed, F.length("clean_text")).otherwise(own).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return found.select(*[column(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: doc_id, number of pieces, piece ids."""
    ids = sentencepiece_codec.encode_texts(docs, sentencepiece_codec.load_pieces(), carry=["doc_id"])
    return ids.select("row.*", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies),
          ("benchmark_decontamination", drop_contaminated), ("secret_scans", mask_secrets),
          ("sentencepiece", encode_pieces)]

#: No stage can be written in DuckDB SQL (CRF, decoding worklist, Viterbi); see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
