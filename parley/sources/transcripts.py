"""Reading transcripts: recogniser text and JSON, RTTM, WAV headers, task documents."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalars import clean_text

#: Beginnings of log lines that are no transcript, and the form of timed lines.
LOG_LINE = r"^(\$\$|main:|system_info:|sense_voice_|ggml_)"
TIMED_LINE = r"^\[([0-9]+(?:\.[0-9]+)?)-([0-9]+(?:\.[0-9]+)?)\]\s*(.*)$"


def parse_asr_lines(raw: DataFrame) -> DataFrame:
    """rec, seg_idx, id, start, end, text from rec and raw, recogniser output.

    Timed lines give segments; if there are none, all other lines that are no log
    give one text without times.
    """
    line = F.regexp_replace("line", r"^(?U)\s+|(?U)\s+$", "")
    each = raw.select("rec", F.posexplode(F.split("raw", r"\r?\n")).alias("pos", "line")).select("rec", "pos", line.alias("line"))
    timed = each.filter(F.col("line").rlike(TIMED_LINE)).select("rec", "pos", *(F.regexp_extract("line", TIMED_LINE, k).alias(n) for k, n in ((1, "start"), (2, "end"), (3, "text"))))
    timed = timed.select("rec", "pos", F.col("start").try_cast("double").alias("start"), F.col("end").try_cast("double").alias("end"), clean_text(F.col("text")).alias("text")).filter("text <> ''")
    rows = timed.withColumn("seg_idx", F.row_number().over(Window.partitionBy("rec").orderBy("pos")) - 1)
    plain = each.filter(~F.col("line").rlike(TIMED_LINE)).select("rec", "pos", clean_text(F.col("line")).alias("text")).filter((F.col("text") != "") & ~F.col("text").rlike(LOG_LINE))
    untimed = plain.join(timed.select("rec").distinct(), "rec", "left_anti").groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    none = F.lit(None).cast("double")
    both = rows.select("rec", "seg_idx", "start", "end", "text").unionByName(untimed.select("rec", F.lit(0).alias("seg_idx"), none.alias("start"), none.alias("end"), "text"))
    return both.withColumn("id", F.format_string("seg_%04d", F.col("seg_idx") + 1))


def _finite(number):
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def parse_asr_json(raw: DataFrame) -> DataFrame:
    """rec, seg_idx, id, start, end, text, speaker and confidence from rec and raw: a JSON array of segments, or an object that has one.

    Texts are trimmed, tags stay; blank ones go before ids are given. A missing
    speaker is unknown; numbers that aren't finite become null.
    """
    one = "struct<start:double,end:double,text:string,speaker:string,confidence:double>"
    listed = F.ltrim("raw").startswith("[")  # an object would be read as an array of one
    parsed = F.when(listed, F.from_json("raw", f"array<{one}>")).otherwise(F.from_json("raw", f"struct<segments:array<{one}>>")["segments"])
    each = raw.select("rec", F.posexplode(parsed).alias("pos", "s")).select("rec", "pos", *(_finite(F.col(f"s.{c}")).alias(c) for c in ("start", "end", "confidence")), F.regexp_replace("s.text", r"^(?U)\s+|(?U)\s+$", "").alias("text"), F.coalesce(F.nullif("s.speaker", F.lit("")), F.lit("unknown")).alias("speaker")).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy("rec").orderBy("pos"))
    return each.withColumn("seg_idx", number - 1).withColumn("id", F.format_string("seg_%04d", F.col("seg_idx") + 1)).drop("pos")


def parse_rttm(lines: DataFrame, uri: str | None = None, strict: bool = False) -> DataFrame:
    """uri, speaker, start, end of the SPEAKER lines of column value; blank and # lines are skipped.

    A malformed line is dropped, or with strict raises an error.
    """
    text = lines.filter(~F.trim("value").rlike("^(#.*)?$")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    start, length = F.try_element_at("f", F.lit(4)).try_cast("double"), F.try_element_at("f", F.lit(5)).try_cast("double")
    good = F.coalesce((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER") & (start >= 0) & (length > 0), F.lit(False))
    if strict:
        text = text.withColumn("f", F.when(good, F.col("f")).otherwise(F.raise_error("malformed RTTM line").cast("array<string>")))
    rows = text.filter(good).select(F.col("f")[1].alias("uri"), F.col("f")[7].alias("speaker"), start.alias("start"), (start + length).alias("end"))
    return rows.filter(F.col("uri") == uri) if uri is not None else rows


def read_rttm(spark: SparkSession, path: str, uri: str | None = None) -> DataFrame:
    return parse_rttm(spark.read.text(path), uri, strict=True)


def segment_intake(rows: DataFrame) -> DataFrame:
    """Segments with default ids, clipped to their recording (duration_ms); empty ones go."""
    number = F.row_number().over(Window.partitionBy("rec").orderBy("seg_idx"))
    start = F.greatest(F.lit(0), F.coalesce("start_ms", F.lit(0)))
    end = F.least("duration_ms", F.coalesce(F.when(F.col("end_ms") > start, F.col("end_ms")), F.col("duration_ms")))
    out = rows.withColumns({"id": F.coalesce("id", F.format_string("seg_%d", number)), "__s": start, "__e": end})
    return out.withColumns({"start_ms": F.col("__s"), "end_ms": F.col("__e")}).filter("end_ms > start_ms").drop("__s", "__e")


#: Bytes of a file in which its header must lie.
HEADER_BYTES = 65_536


def _header(data: bytes) -> tuple:
    """channels, sample_rate, bits, data_bytes, seconds, usable, data_offset of a RIFF WAVE file's beginning."""
    nothing = (None, None, None, None, None, False, None)
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return nothing
    at, form = 12, None
    while at + 8 <= len(data):
        name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if form is None:
                return nothing
            kind, channels, rate, per_second, _, bits = form
            seconds = size / per_second if per_second else None
            return channels, rate, bits, size, seconds, (kind, channels, rate, bits) == (1, 1, 16000, 16), at + 8
        at += 8 + size + size % 2  # chunks begin at even offsets
    return nothing


def wav_info(files: DataFrame, strict: bool = False) -> DataFrame:
    """path and what the header of a binary file (path, content) says; usable: 16 kHz mono 16-bit PCM. Null where it is no WAV file.

    With strict, a file that isn't usable raises an error.
    """
    names = ["channels", "sample_rate", "bits", "data_bytes", "seconds", "usable", "data_offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_header(bytes(h)) for h in batch["head"]]
            if strict and not all(x[5] for x in found):
                raise ValueError("a 16 kHz mono 16-bit PCM WAV file is required")
            rows = pd.DataFrame(found, columns=names, dtype=object)
            yield pd.concat([batch[["path"]].reset_index(drop=True), rows], axis=1)

    schema = "path string, channels long, sample_rate long, bits long, data_bytes long, seconds double, usable boolean, data_offset long"
    return files.select("path", F.substring("content", 1, HEADER_BYTES).alias("head")).mapInPandas(run, schema)


def read_wav_info(spark: SparkSession, path: str) -> DataFrame:
    return wav_info(spark.read.format("binaryFile").load(path))


def read_json_documents(spark: SparkSession, path: str, schema: str, fallback: list | None = None) -> DataFrame:
    """Whole-file JSON documents; one that can't be parsed raises an error when it is read.

    With a fallback, a path that doesn't exist gives these rows instead.
    """
    if fallback is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            return spark.createDataFrame(fallback, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def file_identity(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, sha256 and size of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
