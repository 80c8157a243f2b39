"""The registered queries of this subpackage: each reads its whole table, applies one operator with
production parameters and returns the operator's full result (or the digest columns asked for)."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir

from . import (bpe, embedding_dedup, fertility, langid, line_dedup, mixing, ngram_join, rule_quality, secrets, spelling,
               substring_dedup, token_store, whitening)
from .common import crc_mod, stored, table

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the sentences that repeat an earlier run of sentences: cleaned
    text, sentences, sentences removed."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` joined on distinct 4-word shingles with Jaccard similarity 0.85 or more:
    set size and smallest id of the component."""
    return ngram_join.link(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_sparse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from ``labels`` of the rows whose
    crc32(doc_id) mod 3 is not 1; the rest are held out."""
    stats = stored(rule_quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = rule_quality.fit(stats.where(~held), table(spark, sf_dir, "labels"))
    return stats.select("doc_id", held.alias("held_out"), rule_quality.score(model).alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the fixed source weights: size, the source's size and target, and
    the words that the mix takes of each document, repeats counted."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` of equal label linked at cosine 0.98 or more: links, smallest id of the
    component, whether the vector is that one."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op6_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every whole text of ``documents`` and the verdict of the fertility bands."""
    return fertility.measure(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "script", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from the rows whose
    crc32(doc_id) mod 4 is not 2; the rest are held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_directly_addressable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded, an end id after each, written in directly
    addressable codes in ascending order of id, and read back from the files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=1)
    own = token_store.read(spark, path).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return token_store.with_starts(own, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def _joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``: spans of the fixed patterns, counted and
    digested, and those together with the spans that compression novelty adds."""
    spans = secrets.scan(table(spark, sf_dir, "documents"))

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    return spans.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def op10_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded by merge replay, then decoded: number of ids,
    digest of the decimal ids, digest of the decoded bytes."""
    path = public_tokenizers.path(MULTI_RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of ``documents`` of five code points and three occurrences or more, with their near words, form
    and root."""
    return spelling.group(spelling.words(table(spark, sf_dir, "documents")))


def op12_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` whitened on the four leading components of the distinct integer vectors. A deviation
    beyond a long is null."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained",
        "identity_error")


def op13_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines whose key ten documents or more hold: lines before, lines dropped,
    digest of what is kept."""
    return line_dedup.dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_sentence_spans, op2_grouped_prefix_join, op3_sparse_rules, op4_mix_to_weights, op5_pca_tiles,
    op6_tokenizer_fertility, op7_string_kernel_language, op8_directly_addressable, op9_secret_novelty,
    op10_bpe_merge_replay, op11_pivotal_grams, op12_cholesky_jacobi, op13_line_hashes)}
ORACLES: dict[str, str] = {"op4_mix_to_weights": mixing.ORACLE, "op11_pivotal_grams": spelling.ORACLE,
                           "op13_line_hashes": line_dedup.ORACLE}
