"""A corpus from documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the columns of
documents, in their order.

A document is an id with a text (null: empty). Rows that share both are one document and share its fate; rows that
share an id but not the text are documents of their own, as are rows whose id is null. Columns beyond doc_id and text
are carried along untouched, whatever their names (n_chars alone follows the text, where there is one), and may be
null. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from scholia.llm.common import deleted, scratch, shared_dir, tuned
from scholia.llm.queries import tokenizer_path


def _text(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    model = toxicity.train(docs, tuned(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=docs.columns).filter("predicted = 0").select("carried.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier line go; texts and their lengths change, documents stay. A text that loses
    nothing stays as it is, null ones among them."""
    out = line_dedup.line_dedup(docs, carry=docs.columns)
    lost = F.col("n_dropped") > 0
    changed = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(F.when(lost, changed[c]).otherwise(F.col("carried")[c]) if c in changed else F.col("carried")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays: the one with the least id."""
    kept = near_dedup.representatives(docs).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.md5(_text(docs)) == kept["__digest"])
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64(_text(docs)).alias("version"))
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("version",))
    gone = found.select(F.col("doc_id").alias("__id"), F.col("carried.version").alias("__version")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(_text(docs)) == gone["__version"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, sources mixed in proportion."""
    return packing.pack(docs, tokenizer_path()).drop("queue")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the signatures: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table and what its operator stored are deleted once the next has read them."""
    docs, last = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            deleted(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
