"""A training corpus from raw documents, in stages that each rewrite the table.

Counted as part of the subpackage ``llm``. Each stage takes (spark, docs, sf_dir),
works on all rows that its predecessor kept, and is written as Parquet and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontam, linededup, minhash, packing, quality
from parley.llm.queries import tokenizer_path
from parley.llm.scratch import Scratch
from parley.llm.tables import fold_of, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the classifier nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows that op2 may learn from; rejected documents go."""
    network = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    return quality.accepted(docs, network)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; a document that loses all its lines goes."""
    out = linededup.dedup_lines(docs)
    emptied = "n_dropped > 0 and (text is null or trim(translate(text, '\n\r\t', '   ')) = '')"
    kept = out.filter(f"not coalesce({emptied}, false)")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, that of the least doc_id stays."""
    return minhash.dedup_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", token_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
