"""Ordering, joining and rendering transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalars import clean_text, format_clock, subtitle_clock

#: What stands for a missing speaker, what follows a speaker, the head of a document, and the length of a cue without times.
NO_SPEAKER, SAYS = "未知说话人", "："
TITLE, HEAD = "# 本地转写", ("- 任务：", "- 音频：", "- 片段数：")
CUE_MS = 5000


def reindexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with seg_idx and id by position in their recording."""
    at = F.row_number().over(Window.partitionBy("rec").orderBy(*order))
    return rows.withColumn("seg_idx", (at - 1).cast("long")).withColumn("id", F.format_string("seg_%04d", F.col("seg_idx") + 1))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """One recording's segments from chunk-local ones: times moved by the chunk's offset_ms, ids by position."""
    moved = chunks.withColumns({"start_ms": F.col("start_ms") + F.col("offset_ms"), "end_ms": F.col("end_ms") + F.col("offset_ms")})
    return reindexed(moved, ["offset_ms", "pos"])


def default_segments(tasks: DataFrame) -> DataFrame:
    """tasks' segments, or one from 0 to no end with the task's whole text."""
    one = F.struct(F.lit("seg_0001").alias("id"), F.lit(0).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.col("text").alias("text"))
    kind = "array<struct<id:string,start_ms:bigint,end_ms:bigint,text:string>>"
    return tasks.withColumn("segments", F.when(F.coalesce(F.size("segments"), F.lit(0)) == 0, F.array(one).cast(kind)).otherwise(F.col("segments").cast(kind)))


def _joined(by_order: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(by_order)), lambda x: x["t"]), separator)


def transcript_text(segments: DataFrame) -> DataFrame:
    """rec and its segments' clean texts in order, blank ones left out. A recording is one text."""
    return segments.withColumn("t", clean_text(F.col("text"))).filter("t <> ''").groupBy("rec").agg(_joined(F.struct("seg_idx", "t"), " ").alias("text"))


def _document(segments: DataFrame, block: Column, separator: str, name: str) -> DataFrame:
    return segments.withColumn("t", block).groupBy("rec").agg(_joined(F.struct("seg_idx", "t"), separator).alias(name), F.count("*").alias("n_segments"))


def markdown(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """rec and markdown: a head with the task, its audio and its number of segments, then a heading of clock and speaker over each text.

    tasks has rec, task_id and audio_path; a task without segments has a head only.
    """
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(NO_SPEAKER))
    block = F.concat(F.lit("### ["), format_clock(F.col("start_ms") / 1000), F.lit("] "), speaker, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    body = tasks.select("rec", "task_id", "audio_path").join(_document(segments, block, "", "body"), "rec", "left")
    head = F.concat_ws("\n", F.lit(TITLE), F.lit(""), *(F.concat(F.lit(label), value) for label, value in zip(HEAD, (F.coalesce("task_id", F.lit("")), F.coalesce("audio_path", F.lit("")), F.coalesce("n_segments", F.lit(0)).cast("string")), strict=True)))
    return body.select("rec", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def subtitles(segments: DataFrame, separator: str = ",") -> DataFrame:
    """rec and subtitles: numbered cues; a missing start is five seconds a cue, an end that is missing or not after it five seconds on."""
    start = F.coalesce("start_ms", F.col("seg_idx") * CUE_MS)
    end = F.when(F.col("end_ms") > start, F.col("end_ms")).otherwise(start + CUE_MS)
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(NO_SPEAKER))
    cue = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit("\n"), subtitle_clock(start, separator), F.lit(" --> "), subtitle_clock(end, separator), F.lit("\n"), speaker, F.lit(SAYS), F.coalesce("text", F.lit("")), F.lit("\n"))
    head = "WEBVTT\n\n" if separator == "." else ""
    return _document(segments, cue, "\n", "body").select("rec", F.concat(F.lit(head), "body").alias("subtitles"))


def write_artifacts(segments: DataFrame, tasks: DataFrame, path: str, revision: int, formats: tuple[str, ...] = ()) -> None:
    """A revision's transcript as JSON lines, text and Markdown, and subtitles if asked, in a folder of its own.

    Each format is a table of rec and value, split as Spark splits it, so many short
    recordings don't make many files. A revision that exists raises an error.
    """
    if revision < 1:
        raise ValueError("revisions start at 1")
    base = f"{path}/revisions/{revision:06d}"
    segments.write.mode("errorifexists").json(f"{base}/transcript.json")
    rendered = {"txt": transcript_text(segments).select("rec", F.col("text").alias("value")), "md": markdown(segments, tasks).select("rec", F.col("markdown").alias("value"))}
    rendered |= {f: subtitles(segments, "," if f == "srt" else ".").select("rec", F.col("subtitles").alias("value")) for f in formats if f in ("srt", "vtt")}
    for name, rows in rendered.items():
        rows.write.mode("errorifexists").json(f"{base}/transcript.{name}")
