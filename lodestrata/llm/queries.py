"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import covertree, divergence, gracededup, mixing, nndescent, packing, pii, prefixtrie, simhash, toxicity, urltrees, warc, weaklabel
from lodestrata.session import ready


#: Files of the registered archive; its shards hold 32 MB of raw records, some 6 MB compressed.
WARC_ROLL_BYTES = 4 << 20
#: The key of the registered query; a deployment passes its own.
PII_KEY = "registered-query"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"), roll_bytes=WARC_ROLL_BYTES).drop("url")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.embedding_components(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gracededup.exact_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.quality(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrees.judge_urls(_read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_documents(docs, PII_KEY)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), packing.tokenizer_path(), seq_len=2048)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_takes(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest_neighbours(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_warc,
        op2_embedding_near_dedup,
        op3_exact_dedup,
        op4_quality_classifier,
        op5_simhash,
        op6_url_filter,
        op7_toxicity,
        op8_pii_pseudonyms,
        op9_best_fit_packing,
        op10_source_mixing,
        op11_prefix_trie,
        op12_source_divergence,
        op13_nn_descent,
        pipeline,
    )
    return {f.__name__: f for f in named}
