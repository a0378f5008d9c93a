"""The registered queries: each operator, with its production parameters, over its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ann import nearest
from .bpe import decode_ids, encode_texts
from .decontam import leaks
from .filters import audit
from .merkle import FIELDS, leaf_digest, manifest, verify
from .mixing import mix_sources
from .neardup import near_duplicates
from .quality import quality_scores
from .quotes import reply_ordered
from .sharding import ring_shards
from .tokens import token_counts
from .toxicity import toxicity_scores
from .warc import read_warc, write_warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(_table(spark, folder, "documents"), path)


def op3_lexicon_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    ).select("doc_id", "held_out", "score", "predicted")


def op4_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return ring_shards(_table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op7_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return reply_ordered(_table(spark, folder, "conversations"))


def op8_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(_table(spark, folder, "pages"), archives)
    return read_warc(spark, archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_minhash_bayes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op10_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return decode_ids(encode_texts(documents, ranks), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_incremental_witnesses(spark: SparkSession, folder: str) -> DataFrame:
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(third, lower).otherwise(F.col("text"))
    tampered = leaf_digest([text if name == "text" else F.col(name) for name in FIELDS])
    proved = manifest(_table(spark, folder, "documents"), along={"tampered_leaf": tampered})
    return verify(proved, "tampered_leaf").drop("tampered_leaf")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_token_counts": op2_token_counts,
    "op3_lexicon_automaton": op3_lexicon_automaton,
    "op4_template_leaks": op4_template_leaks,
    "op5_ring_shards": op5_ring_shards,
    "op6_mix_sources": op6_mix_sources,
    "op7_quote_links": op7_quote_links,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_minhash_bayes": op9_minhash_bayes,
    "op10_positive_unlabelled": op10_positive_unlabelled,
    "op11_distinct_words": op11_distinct_words,
    "op12_incremental_witnesses": op12_incremental_witnesses,
    "op13_filter_audit": op13_filter_audit,
}
