"""Reading transcripts: pages, search, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sizes of pages, searches and previews.
PAGE, MOST_PAGE, SEARCH, MOST_SEARCH, PREVIEW = 200, 500, 50, 100, 1200


def page(segments: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """The segments from offset on in each recording, at most limit, with total and has_more."""
    offset, limit = max(0, offset), max(1, min(MOST_PAGE, limit))
    rec = Window.partitionBy("rec")
    numbered = segments.withColumns({"__at": F.row_number().over(rec.orderBy("seg_idx")) - 1, "total": F.count("*").over(rec)})
    return numbered.filter((F.col("__at") >= offset) & (F.col("__at") < offset + limit)).withColumn("has_more", F.col("total") > offset + limit).drop("__at")


def transcripts(tasks: DataFrame, segments: DataFrame, requests: DataFrame | None = None, offset: int = 0, limit: int = PAGE, include_text: bool = False) -> DataFrame:
    """A row for each of tasks (rec, text): text, text_scope, total_segments, offset, returned_segments and has_more.

    requests (rec, id) names segments instead of a page; a recording that requests
    none gets its page. text is the task's own where all segments are returned, else
    that of the returned ones, a line each; without include_text there is none.
    """
    offset, limit = max(0, offset), max(1, min(MOST_PAGE, limit))
    at = F.row_number().over(Window.partitionBy("rec").orderBy("seg_idx")) - 1
    rows = segments.withColumn("__at", at)
    if requests is None:
        rows = rows.withColumns({"__asked": F.lit(False), "__hit": F.lit(False)})
    else:
        hits = requests.select("rec", "id").distinct().withColumn("__hit", F.lit(True))
        asks = requests.select("rec").distinct().withColumn("__asked", F.lit(True))
        rows = rows.join(hits, ["rec", "id"], "left").join(asks, "rec", "left").fillna(False, ["__hit", "__asked"])
    chosen = F.when(F.col("__asked"), F.col("__hit")).otherwise((F.col("__at") >= offset) & (F.col("__at") < offset + limit))
    line = F.when(chosen & (F.coalesce("text", F.lit("")) != ""), F.struct("seg_idx", F.col("text").alias("t")))
    per = rows.groupBy("rec").agg(F.count("*").alias("total_segments"), F.count_if(chosen).alias("returned_segments"), F.bool_or("__asked").alias("__asked"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("__lines"))
    per = tasks.select("rec", F.col("text").alias("__text")).join(per, "rec", "left").fillna(0, ["total_segments", "returned_segments"]).fillna(False, ["__asked"])
    whole = F.col("returned_segments") == F.col("total_segments")
    text = F.when(whole, F.col("__text")).otherwise(F.col("__lines")) if include_text else F.lit(None).cast("string")
    scope = F.when(whole, F.lit("full")).otherwise(F.lit("selected_segments")) if include_text else F.lit("none")
    more = ~F.col("__asked") & (offset + F.col("returned_segments") < F.col("total_segments"))
    return per.select("rec", text.alias("text"), scope.alias("text_scope"), "total_segments", F.lit(offset).alias("offset"), "returned_segments", more.alias("has_more"))


def search(segments: DataFrame, text: str | None = None, person_id: str | None = None, limit: int = SEARCH) -> DataFrame:
    """The first segments of each recording that contain the text, in any case, or are the person's, with their index in it; n_matches counts these."""
    limit = max(1, min(MOST_SEARCH, limit))
    needle, person = (text or "").strip().lower(), (person_id or "").strip()
    if not needle and not person:
        raise ValueError("a search needs a text or a person")
    hit = F.lit(False)
    if needle:
        hit = hit | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(needle))
    if person:
        hit = hit | F.coalesce(F.col("person_id") == person, F.lit(False))
    rec = Window.partitionBy("rec").orderBy("seg_idx")
    numbered = segments.withColumn("index", (F.row_number().over(rec) - 1).cast("long"))
    ranked = numbered.filter(hit).withColumn("__k", F.row_number().over(rec)).filter(F.col("__k") <= limit).drop("__k")
    return ranked.withColumn("n_matches", F.count("*").over(Window.partitionBy("rec")))


def task_status(tasks: DataFrame) -> DataFrame:
    """The 13 public fields of a task's state; tasks has task_id and status, and of the others what is known.

    Missing ones are null, but for percent (100 of a completed task, else 0), stage
    (the status), preview and counts of text and segments, and warnings.
    """
    kinds = {"created_at": "timestamp", "updated_at": "timestamp", "audio": "string", "stage": "string", "percent": "int", "artifacts": "string", "partial_artifacts": "string", "partial_available": "boolean", "n_segments": "long", "text": "string", "warnings": "array<string>"}
    has = lambda c: F.col(c) if c in tasks.columns else F.lit(None).cast(kinds[c])
    text, count = F.coalesce(has("text"), F.lit("")), F.coalesce(has("n_segments"), F.lit(0)).cast("long")
    return tasks.select(
        "task_id", "status", has("created_at").alias("created_at"), has("updated_at").alias("updated_at"), has("audio").alias("audio"), F.coalesce(has("stage"), "status").alias("stage"),
        F.coalesce(has("percent"), F.when(F.col("status") == "completed", 100).otherwise(0)).alias("percent"), has("artifacts").alias("artifacts"), has("partial_artifacts").alias("partial_artifacts"),
        (F.coalesce(has("partial_available"), F.lit(False)) | (count > 0)).alias("partial_available"), F.substring(text, 1, PREVIEW).alias("preview"), F.length(text).cast("long").alias("n_chars"), count.alias("n_segments"),
        F.coalesce(has("warnings"), F.array().cast("array<string>")).alias("warnings"),
    )
