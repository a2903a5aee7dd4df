"""Samples of 16 kHz mono 16-bit WAV files, and WAV files of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.transcripts import wav_info

#: The greatest sample, samples a second, bytes a sample.
FULL_SCALE, RATE, BYTES = 32767.0, 16_000, 2


def read_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """The columns of ranges (path, begin, end) with samples in [-1, 1], from binary files (path, content).

    Places are in samples and are cut to the file's; an empty range has no samples. A
    file that isn't 16 kHz mono 16-bit PCM, or is shorter than its header says, raises
    an error.
    """
    info = wav_info(files, strict=True).select("path", "data_offset", (F.col("data_bytes") / BYTES).cast("long").alias("__count"))
    first, last = F.least(F.greatest("begin", F.lit(0)), "__count"), F.least("end", "__count")
    at = ranges.join(info, "path").withColumns({"__first": first, "__n": F.greatest(last - first, F.lit(0))})
    raw = F.substr("content", (F.col("data_offset") + F.col("__first") * BYTES + 1).cast("int"), (F.col("__n") * BYTES).cast("int"))
    cut = at.join(files.select("path", "content"), "path").select(*ranges.columns, "__n", raw.alias("__raw"))
    names = [*ranges.columns, "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if len(data) != n * BYTES:
                    raise ValueError("truncated WAV data")
                out.append((np.frombuffer(data, "<i2") / np.float32(FULL_SCALE)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.list_(pa.float32()))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)
    return cut.mapInArrow(run, f"{fields}, samples array<float>")


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A WAV file of samples, cut to [-1, 1]."""
    if not len(samples):
        raise ValueError("empty audio segment")
    data = np.rint(np.clip(np.asarray(samples, dtype=np.float32), -1, 1) * np.float32(FULL_SCALE)).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * BYTES, BYTES, 8 * BYTES, b"data", len(data))
    return head + data


def segment_files(rows: DataFrame, rate: int = RATE) -> DataFrame:
    """rows with content, a WAV file of their samples."""
    at = rows.columns.index("samples")
    names = [*rows.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wav_bytes(x.values.to_numpy(zero_copy_only=False), rate) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, content binary")


def read_segments(spark: SparkSession, path: str, segments: DataFrame) -> DataFrame:
    """segments (path, start_ms, end_ms) with samples of the files under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    place = lambda c: (F.col(c) * RATE / 1000).cast("long")
    return read_ranges(files, segments.withColumns({"begin": place("start_ms"), "end": place("end_ms")}))
