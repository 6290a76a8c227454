"""The registered queries opN_<name>: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import ring_shards

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring_shards(docs, ["doc_id", "text_crc32", "size"], shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", kept.alias("kept_sha256"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import nearest

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    out = archive(spark, _table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import pack

    out = pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=4096, end_id=2, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import unigram_encode

    return unigram_encode(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep_ids=False)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_tokenizers

    out = align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), keep_groups=False)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import contaminated_words

    out = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, gram=5)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring": op1_ring,
    "op2_suffix": op2_suffix,
    "op3_lines": op3_lines,
    "op4_jaccard": op4_jaccard,
    "op5_nearest": op5_nearest,
    "op6_warc": op6_warc,
    "op7_vectors": op7_vectors,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_alignment": op11_alignment,
    "op12_negatives": op12_negatives,
    "op13_winnowing": op13_winnowing,
}

from . import jaccard, lines, negatives, warc, winnowing  # noqa: E402

ORACLES: dict[str, str] = {"op3_lines": lines.ORACLE, "op4_jaccard": jaccard.ORACLE, "op6_warc": warc.ORACLE, "op12_negatives": negatives.ORACLE, "op13_winnowing": winnowing.ORACLE}
