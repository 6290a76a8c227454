"""A corpus from documents to training sequences: five stages, each written as Parquet and read as the next one's input.

In every stage rows with a null id, null or empty texts and repeated rows pass like any others unless its docstring says
otherwise; an empty table gives an empty one, and columns other than those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common, jaccard, lines, quality, queries, suffix, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _has_text(text: str):
    """Something other than ASCII white space."""
    return F.col(text).rlike("[^\\x20\\x09-\\x0D]")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go; texts stay as they are. A null text is scored as an empty one, rows
    without id are scored like others, and equal texts stay or go together."""
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stood before go; a document that loses all of its text goes too. A null or empty text loses
    nothing and stays. The runs of a null id stood first. Rows that are equal in id and text lose the same runs."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    return _documents(out.where((F.col("n_removed_chunks") == 0) | _has_text("text")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of Jaccard 0.8 on 5-word shingles, the one with the smallest id stays. Texts without words
    and rows without id are in no group and stay. Of rows that are equal in id and text one stays; rows with one id and
    different texts are one document and stay or go together."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.jaccard_components(docs, k=5, percent=80)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    many = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("many"))
    once = kept.join(many, kept["doc_id"] == many["many"], "left_anti")
    return once.unionByName(kept.join(many, kept["doc_id"] == many["many"], "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes with another start go, and a document with nothing else. Bytes of a cut character go too. A null
    text becomes an empty one, and stays. Rows that are equal in id and text repeat each other."""
    out = suffix.remove_repeats(docs.select(*COLUMNS), length=200, whole_characters=True)
    out = out.select("doc_id", F.col("kept").cast("string").alias("text"), "n_removed", "rest.lang", "rest.source")
    return _documents(out.where((F.col("n_removed") == 0) | _has_text("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, none across documents. A null or empty text has the end id alone; every row,
    repeated or without id, has its own pieces."""
    return tokens.pack(docs, queries.tokenizer("word_bpe_49k.json"), limit=4096, end_id=2, gapless=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", drop_passages),
    ("packing", pack),
]

#: No SQL engine has the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has staged goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark, [p for p in common.STAGED[before:] if p != docs._staged_at])
    return STAGES[-1][1](spark, docs, sf_dir)
