"""The pipeline's stages against brute force, and the registered queries."""

import re

import numpy as np
import pytest
from data import documents
from pyspark.sql import functions as F
from test_near_copies import brute_fingerprint, components
from test_texts import brute_hits

import corpus_pipeline
from blotter.llm import queries, secret_scan, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]


@pytest.mark.parametrize("clashes", [False, True])
def test_stages(spark, clashes):
    """Each stage on its own input; null ids, repeated rows and odd texts included."""
    extra = documents(spark, clashes=clashes).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    own = spark.read.parquet(f"{SF}/documents.parquet")
    shape = extra.schema
    docs = extra.unionByName(own.selectExpr(
        *[c if c in own.columns else f"'x' AS {c}" for c in shape.names]))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        before, after = rows_of(docs), rows_of(got)
        at = {c: docs.columns.index(c) for c in docs.columns}
        pairs = [(r[at["doc_id"]], r[at["text"]]) for r in before]
        if name != "sentencepiece":
            assert got.columns == docs.columns
        if name == "toxicity":
            score = {(r.row.doc_id, r.row.text): r.score for r in queries.toxicity.score(
                docs, queries.toxicity.train(docs, queries.table(spark, SF, "labels")), carry=["doc_id", "text"]).collect()}
            assert after == [r for r, p in zip(before, pairs) if score[p] < 0.5]
        elif name == "simhash_near_dedup":
            fps = [brute_fingerprint(t) for _, t in pairs]
            comp = components([i for i, _ in pairs], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
            assert sorted((r[at["doc_id"]] for r in after), key=str) == sorted(set(comp), key=str)
            assert set(after) <= set(before)
        elif name == "benchmark_decontamination":
            bad = {(i, n) for i, n, *_, c in brute_hits(pairs, items) if c}
            words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
            assert after == [r for r, (i, t) in zip(before, pairs)
                             if (i, len(words.findall((t or "").translate(low)))) not in bad]
            assert len(after) < len(before)
        elif name == "secret_scans":
            def clean(r):
                text = r[at["text"]]
                spans = secret_scan.all_spans(text)[1] if text else []
                r = list(r)
                if spans:
                    r[at["text"]] = secret_scan.masked(text, spans)
                    r[at["n_chars"]] = len(r[at["text"]])
                return tuple(r)
            assert after == sorted((clean(r) for r in before), key=str)
        else:
            codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())
            ids = [(i, None if t is None else np.frombuffer(codec.encode(t), np.int32).tolist()) for i, t in pairs]
            assert after == sorted(((i, None if x is None else len(x), x) for i, x in ids), key=str)
        docs = spark.createDataFrame(got.collect(), got.schema)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0
        docs = got


#: Queries of another grain than a row per input row.
OTHER_GRAIN = {"op11_filters", "op12_conversations"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - OTHER_GRAIN))
def test_queries_return_a_row_per_input_row(spark, name):
    source = {"op2_html": "pages", "op5_warc": "pages", "op8_embeddings": "embeddings"}.get(name, "documents")
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == queries.table(spark, SF, source).count()
    assert got.columns[0] == {"pages": "page_id", "embeddings": "vec_id"}.get(source, "doc_id")
    assert dict(got.dtypes)[got.columns[0]] == "bigint"


def test_grain_of_the_other_queries(spark):
    """600 rows a language (120 orders of five steps); a row per conversation."""
    got = queries.op11_filters(spark, SF)
    parts = queries.table(spark, SF, "documents").selectExpr("coalesce(lang, '') AS part").distinct()
    assert got.count() == 600 * parts.count() == got.select("part", "filter_order", "step").distinct().count()
    got = queries.op12_conversations(spark, SF)
    convs = queries.table(spark, SF, "conversations").select("conv_id").distinct()
    assert got.count() == convs.count() == got.join(convs, "conv_id").count()


def test_oracles(spark):
    from oracle_check import compare, duck_connect
    con = duck_connect(SF)
    for name, sql in queries.ORACLE.items():
        ok, message = compare(queries.QUERIES[name](spark, SF), con, sql)
        assert ok, message
