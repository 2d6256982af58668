"""The thin queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import (
    conversation_repair,
    decontaminate,
    embedding_join,
    filter_audit,
    fingerprints,
    html_extract,
    secret_scan,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    warc,
)
from blotter.plans.materialize import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns digests of both."""
    model = sentencepiece_codec.load_pieces()
    rows = sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), model, carry=["doc_id"])
    return rows.select("row.*", *sentencepiece_codec.CODED.names)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return rows.select("row.*", *html_extract.EXTRACTED.names)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.locate_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                           carry=["doc_id"])
    return decontaminate.contamination(found).select(
        "row.*", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "row.*", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.conversation_rows(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(conversation_repair.damage(rows))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents")).drop("next_id")


#: DuckDB's SQL for the queries that it can express.
ORACLE: dict[str, str] = {
    "op3_suffixes": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT doc_id, o, substr(x, 2 * o + 1, 2 * 699) AS part
              FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 500)) AS o FROM d)),
        w AS (SELECT doc_id, o + s AS s, md5(substr(part, 2 * s + 1, 400)) AS k
              FROM (SELECT *, unnest(range(0, least(500, length(part) // 2 - 199))) AS s FROM c
                    WHERE length(part) >= 400)),
        r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
        e AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before,
                     lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS after FROM w JOIN r USING (k)),
        y AS (SELECT doc_id, s AS a, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM e
              WHERE before IS NULL OR s > before + 200),
        z AS (SELECT doc_id, s + 200 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM e
              WHERE after IS NULL OR after > s + 200),
        j AS (SELECT doc_id, i, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0) AS rest
              FROM y JOIN z USING (doc_id, i)),
        o AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                     string_agg(substr(x, 2 * rest + 1, 2 * (a - rest)), '' ORDER BY i)
                     || substr(any_value(x), 2 * max(b) + 1) AS kept
              FROM j JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
            coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), t)) AS kept_sha256
        FROM d LEFT JOIN o USING (doc_id)""",
    "op4_substrings": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                              lambda x: x <> '') AS w FROM documents),
        v AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
        f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM v JOIN f USING (k) WHERE first < doc_id),
        n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
        o AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept
              FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN g USING (doc_id, p)
              GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
    "op8_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT vec_id, e, list_inner_product(e, e) AS q FROM v
               WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
              WHERE x.q > 0 AND y.q > 0 AND list_inner_product(x.e, y.e) / sqrt(x.q * y.q) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        k AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS t
              FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        h AS (SELECT doc_id, s, n, item
              FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                          FROM d, (SELECT DISTINCT n FROM k))) JOIN k USING (n, t)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_filters": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        q AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
              FROM labels GROUP BY doc_id),
        x AS (SELECT row_number() OVER () AS r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
                 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
                 regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
              FROM d LEFT JOIN q USING (doc_id)),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
              WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, CAST(step AS INT) AS step, ascii(filter_order[step]) - 64 AS f
              FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
        g AS (SELECT filter_order, r, min(step) AS gone FROM s JOIN x ON fails[f] GROUP BY filter_order, r),
        y AS (SELECT part, filter_order, step, f,
                count(*) FILTER (gone IS NULL OR gone > step) AS kept,
                count(*) FILTER (gone = step) AS removed,
                count(*) FILTER (fails[f] AND gone < step) AS redundant,
                count(*) FILTER (fails[f] AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (gone = step), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(toxic) FILTER (gone = step), 0) AS BIGINT) AS toxic_lost
              FROM s CROSS JOIN x LEFT JOIN g USING (filter_order, r) GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM y""",
    "op12_conversations": r"""
        WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(
                    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                    lambda c: CAST(ascii(c) AS BIGINT))),
                    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS way
              FROM conversations, k),
        e AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
                CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, left(role, 1) AS r FROM e),
        f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
                right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS late,
                lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        g AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND late AS truncated FROM f),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (truncated) AS truncated,
                count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
        -- Up to two insertions take a state (0: nothing yet, 1: s, 2: u, 3: a) to another one.
        c(q, p, ins) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'),
                                (2, 3, 'I'), (0, 3, 'II'), (1, 3, 'II')),
        -- What an edit of a row does in a state; a row is kept if its initial fits.
        t(p, edit, r, z, price) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0),
            (2, 'K', 'a', 3, 0), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (3, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3),
            (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4)),
        w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': ''} AS best FROM n
              UNION ALL
              SELECT g.conv_id, g.i, z, min({'cost': best.cost + 3 * length(ins) + price
                  + CASE WHEN edit <> 'D' AND truncated THEN 3 ELSE 0 END, 'audit': best.audit || ins || edit})
              FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN c USING (q) JOIN t USING (p)
              WHERE (edit <> 'K' OR t.r = g.r) AND (edit = 'D' OR NOT gone) GROUP BY g.conv_id, g.i, z),
        b AS (SELECT w.conv_id, min({'cost': best.cost + 3 * length(tail), 'audit': best.audit || tail}) AS best
              FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n
              JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS x(q, tail) USING (q)
              GROUP BY w.conv_id),
        l AS (SELECT conv_id, pos, best.audit[pos] AS edit FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS pos FROM b)),
        m AS (SELECT l.conv_id, pos, edit, g.role, g.text, g.r FROM
                (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM l) AS l
              LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i WHERE edit <> 'D'),
        s AS (SELECT *, row_number() OVER v - CAST(first_value(edit = 'K' AND r = 's') OVER v AS INT) AS j
              FROM m WINDOW v AS (PARTITION BY conv_id ORDER BY pos)),
        h AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END END
                || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired FROM s GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
            sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS a
        LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id
        LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
        LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id""",
}

QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_html, op3_suffixes, op4_substrings, op5_warc, op6_secrets, op7_simhash, op8_embeddings,
    op9_decontaminate, op10_toxicity, op11_filters, op12_conversations,
    op13_fingerprints)}
