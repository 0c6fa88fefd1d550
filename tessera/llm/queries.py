"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, language_id, ngram_join, pii, sentencepiece_codec, sharding, substring_dedup, url_filter, wavelet
from tessera.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.copies(table(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "keep_id", "n_copies", "is_kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_shards(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_wavelet": op9_wavelet,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies,
               row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_kept
        FROM documents""",
    "op7_substring_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
        seeds AS (SELECT doc_id, p AS pos, array_to_string(ws[p + 1 : p + 50], ' ') AS seed FROM w, unnest(range(len(ws) - 49)) AS t(p)),
        placed AS (SELECT doc_id, pos, seed, first_value(doc_id) OVER o AS ref, first_value(pos) OVER o - pos AS apart FROM seeds WINDOW o AS (PARTITION BY seed ORDER BY doc_id, pos)),
        blocks AS (SELECT DISTINCT doc_id, ref, apart FROM placed WHERE ref < doc_id),
        met AS (SELECT b.doc_id, x.pos, b.ref, b.apart FROM blocks b JOIN seeds x ON x.doc_id = b.doc_id JOIN seeds y ON y.doc_id = b.ref AND y.pos = x.pos + b.apart AND y.seed = x.seed),
        numbered AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, ref, apart ORDER BY pos) AS island FROM met),
        runs AS (SELECT doc_id, ref, apart, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY doc_id, ref, apart, island),
        parse AS (
            SELECT DISTINCT doc_id, {'s': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'ref': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT)} AS f FROM runs
            UNION ALL
            SELECT p.doc_id, min({'s': greatest(-p.f.b, r.a), 'b': -r.b, 'ref': r.ref, 'at': r.apart + greatest(-p.f.b, r.a)})
            FROM parse p JOIN runs r ON r.doc_id = p.doc_id AND r.b > -p.f.b GROUP BY p.doc_id)
        SELECT doc_id, CAST(f.s AS INTEGER) AS start_word, CAST(-f.b AS INTEGER) AS end_word, f.ref AS ref_doc_id, CAST(f.at AS INTEGER) AS ref_start_word
        FROM parse WHERE f.b < 0""",
}
