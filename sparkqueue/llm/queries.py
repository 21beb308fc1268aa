"""The registered queries of the corpus operators: opN_<name>, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqueue.llm import common
from sparkqueue.llm.decontamination import contaminated
from sparkqueue.llm.fingerprints import document_fingerprints
from sparkqueue.llm.language_id import fit_language_filters, held_out, identify_languages
from sparkqueue.llm.mixing import Mix, mix_sql, mixed
from sparkqueue.llm.near_duplicates import near_duplicates
from sparkqueue.llm.quality import fit_quality, score_quality
from sparkqueue.llm.repeats import without_repeats
from sparkqueue.llm.sharding import shard_documents
from sparkqueue.llm.token_counts import token_counts
from sparkqueue.llm.token_files import token_files

#: The targets of op4 and of the pipeline.
MIX = Mix(
    domains={"web": 5, "books": 3, "reference": 2},
    domain_of={f"src{i}": "web" if i < 10 else "books" if i < 15 else "reference" for i in range(20)},
    languages={"en": 5, "de": 2, "es": 2, "fr": 2},
    sources={f"src{i}": 2 if i % 5 == 0 else 1 for i in range(20)},
)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    net = fit_quality(docs, labels, ~held_out(5, 0))
    return score_quality(docs, net).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixed(common.table(spark, sf_dir, "documents"), MIX)
    return taken.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    filters = fit_language_filters(docs.where(~held_out(4, 2)))
    return identify_languages(docs, filters).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"), shards=24)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_quality, op3_decontamination, op4_mixing, op5_near_duplicates, op6_language_id, op7_repeats, op8_sharding, op9_token_counts, op10_fingerprints)}
ORACLE_SQL = {
    "op4_mixing": mix_sql(MIX),
    "op5_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM words
        ), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.m AS component_id, s.doc_id = l.m AS kept
        FROM sets s JOIN least l ON s.doc_id = l.a
    """,
}
