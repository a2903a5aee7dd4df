"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontam, embdedup, linededup, minhash, packing, quality, secrets, sharding, toxicity, urlfilter
from parley.llm.tables import fold_of, table

#: Days over which the synthetic captures are spread.
CAPTURE_DAYS = 360
#: A dated list in the way a list keeper would write it: (kind, pattern, category, action, day).
URL_LIST = (
    ("domain", "example.net", "adult", "add", 0), ("domain", "example.net", "adult", "remove", 45), ("domain", "example.net", "adult", "add", 200), ("domain", "example.net", "adult", "remove", 260),
    ("host", "tionsh.example.net", "malware", "add", 90), ("host", "tionsh.example.net", "malware", "remove", 150), ("host", "tionsh.example.net", "phishing", "add", 120),
    ("host", "tionsh.example.net", "phishing", "remove", 180), ("prefix", "tionsh.example.net/de", "spam", "add", 30), ("prefix", "tionsh.example.net/fr", "spam", "add", 270),
    ("domain", "example.org", "spam", "add", 300), ("host", "blog.tionble.example.com", "spam", "add", 10), ("host", "blog.tionble.example.com", "spam", "remove", 20),
    ("host", "blog.tionble.example.com", "spam", "add", 20), ("host", "blog.tionble.example.com", "spam", "remove", 100), ("domain", "ththen.example.org", "adult", "add", 60), ("domain", "com", "parked", "add", 350),
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_matches")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    network = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, network).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=decontam.PROXIMITY)
    return out.drop("runs", "items").withColumn("near_items", F.array_join("near_items", ","))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("page_id") * 7 % CAPTURE_DAYS).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def url_list(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(URL_LIST), "kind string, pattern string, category string, action string, day int")
    return rows.select("kind", "pattern", "category", "action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("at"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.active_entries(captures(spark, sf_dir), url_list(spark))
    said = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["kind"], m["pattern"], m["category"])), ",")
    return out.select("page_id", urlfilter.host_of(F.col("url")).alias("host"), F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), F.size("matches").cast("long").alias("n_matches"), said.alias("matches"), (F.size("matches") > 0).alias("blocked"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_quality, op3_decontam, op4_url_filter, op5_secrets, op6_embedding_dedup, op7_minhash, op8_sharding, op9_packing, op10_line_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from parley.llm import sql

    return {"op3_decontam": sql.decontam(*decontam.PROXIMITY), "op4_url_filter": sql.url_filter(URL_LIST, CAPTURE_DAYS), "op6_embedding_dedup": sql.EMBEDDING, "op7_minhash": sql.MINHASH}
