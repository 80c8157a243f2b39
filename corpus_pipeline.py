"""From raw documents to token ids: five stages over the operators of ``riskloom.llm``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it
kept; its result is written as Parquet and read again as the next one's ``docs``. All stages but
the last return the columns of ``docs``.

1. language_id: rows without a letter, and rows that fit no learned language, go: those of whose
   n-grams the winning language's landmarks hold less than LEAST_SHARE of its usual share.
2. ngram_jaccard: of every group of near duplicates (five-word shingles, Jaccard similarity 0.8 or
   more, groups by reachability) the row of smallest id stays; of rows equal in id and text, one.
   Rows without words are in no group and stay.
3. secret_scan: secrets in the texts are replaced by a mark; all rows stay.
4. mix_sources: rows leave or repeat as the fixed source weights ask for; rows without words have
   nothing to give and go.
5. bpe_encode: id, number of tokens and token ids of every row.

Null texts, ids and sources, repeated rows, empty tables and extra columns are treated as the
operators say. Columns whose names begin with two underscores are for the stages' own use.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import bpe, langid, mixing, ngram_join, secrets
from riskloom.llm.common import crc_mod, filter_bits, may_hold_udf, stored, table

#: Least language score (0.5: some language's output is neutral); words of a shingle and percent
#: of similarity.
LEAST_SCORE, WORDS, PERCENT = 0.25, 5, 80
#: Least part of a language's usual share of known n-grams. Scores can't tell: unlearned scripts and
#: random letters have 0.39 to 0.56, documents of sf0.1 0.35 and more. Shares can: 0.08 to 0.43 against
#: 0.60 and more, with usual shares of about 0.85.
LEAST_SHARE = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.identified(docs, model, LEAST_SCORE, least_share=LEAST_SHARE)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"),
                   F.xxhash64("text").alias("th"))
    linked = ngram_join.link(docs.select(key.alias("id"), "text"), "id", words=WORDS, percent=PERCENT)
    # what is known of rows that may go: whether one of them stays
    doubtful = stored(linked.where("n_shingles > 0").groupBy("id").agg(
        F.count("*").alias("__n"), F.first(F.col("id") == F.col("component_id")).alias("__stays"))
        .where("__n > 1 or not __stays")
        .select(F.col("id.doc_id").alias("__doc_id"), F.col("id.th").alias("__th"), "__n", "__stays"), "doubtful")
    seen = may_hold_udf(spark, filter_bits(doubtful.select(F.xxhash64("__doc_id", "__th").alias("h")), "h"))
    rows = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__hit", seen(F.xxhash64("doc_id", "__hash")))
    hit = rows.where("__hit").join(doubtful, F.col("__hash").eqNullSafe(F.col("__th"))
                                   & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left")
    order = Window.partitionBy("doc_id", "__hash").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"])
    once = (hit.where("__stays").withColumn("__turn", F.row_number().over(order)).where("__turn = 1"))
    return (rows.where("not __hit").select(*docs.columns)
            .union(hit.where("__n is null").select(*docs.columns)).union(once.select(*docs.columns)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan),
          ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]
#: Language identification and merges can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
