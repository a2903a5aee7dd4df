"""Pluggable processes: callables that turn recordings into segments, samples into features, and features into vectors.

A callable is made once in each Python worker and fed Arrow batches, as a model
would be. The defaults are deterministic stand-ins without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a feature frame, and items of a batch.
WIDTH, BATCH = 80, 64
SCHEMA = "rec long, seg_idx long, start_ms long, end_ms long, text string"


def stand_in() -> Callable[[int, int], list[tuple[int, int, str]]]:
    """Segments of ten seconds at most, with a text that names their place."""

    def run(rec: int, duration_ms: int) -> list[tuple[int, int, str]]:
        return [(at, min(at + 10_000, duration_ms), f"recording {rec} from {at}") for at in range(0, duration_ms, 10_000)]

    return run


def transcribe(recordings: DataFrame, make: Callable = stand_in) -> DataFrame:
    """rec, seg_idx, start_ms, end_ms, text of recordings (rec, duration_ms)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = make()
        for batch in batches:
            rows = [(rec, i, *segment) for rec, ms in zip(batch["rec"], batch["duration_ms"], strict=True) for i, segment in enumerate(process(int(rec), int(ms)))]
            yield pd.DataFrame(rows, columns=["rec", "seg_idx", "start_ms", "end_ms", "text"])

    return recordings.select("rec", "duration_ms").mapInPandas(run, SCHEMA)


def spectrum() -> Callable[[np.ndarray], np.ndarray]:
    """Feature frames of samples at 16 kHz: logarithms of the energy in WIDTH bands, 25 ms every 10 ms."""
    size, step = 400, 160
    window = np.hanning(size)

    def run(samples: np.ndarray) -> np.ndarray:
        if len(samples) < size:
            return np.zeros((0, WIDTH), np.float32)
        frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::step] * window
        energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        bands = np.add.reduceat(energy, np.linspace(0, energy.shape[1] - 1, WIDTH).astype(int), axis=1)
        return np.log(bands + 1e-6).astype(np.float32)

    return run


def mean_model() -> Callable[[np.ndarray], np.ndarray]:
    """A vector of each item of a batch (items, frames, WIDTH): its mean frame."""
    return lambda batch: batch.mean(axis=1)


def in_batches(features: list[np.ndarray], model: Callable[[np.ndarray], np.ndarray], size: int = BATCH) -> tuple[list[np.ndarray | None], int]:
    """The model's vector for each item and the number of batches; an item without frames has none.

    Items of like length share a batch, the shortest first. Shorter ones repeat their
    last frame, narrower frames end in zeros.
    """
    out: list[np.ndarray | None] = [None] * len(features)
    order = sorted((i for i, f in enumerate(features) if len(f)), key=lambda i: (len(features[i]), i))
    for at in range(0, len(order), max(1, size)):
        some = order[at : at + max(1, size)]
        batch = np.zeros((len(some), len(features[some[-1]]), WIDTH), np.float32)
        for row, i in enumerate(some):
            f = np.asarray(features[i], dtype=np.float32)[:, :WIDTH]
            batch[row, : len(f), : f.shape[1]] = f
            batch[row, len(f) :, : f.shape[1]] = f[-1]
        found = np.asarray(model(batch))
        if found.ndim != 2 or len(found) != len(some):
            raise ValueError("the model returned vectors of another shape")
        for row, i in enumerate(some):
            out[i] = found[row]
    return out, -(-len(order) // max(1, size))


def embed_segments(rows: DataFrame, model: Callable = mean_model, features: Callable = spectrum, size: int = BATCH) -> DataFrame:
    """The columns of rows but samples, with vector (null: too short) and the number of the task's batches.

    Rows are sorted by length in their partitions, so batches hold items of like length.
    """
    kept = [f for f in rows.schema if f.name != "samples"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process, made = model(), features()
        for batch in batches:
            vectors, n = in_batches([made(np.asarray(x, dtype=np.float32)) for x in batch["samples"]], process, size)
            yield batch.drop(columns="samples").assign(vector=vectors, n_batches=n)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.sortWithinPartitions(F.size("samples")).select(*(f.name for f in kept), "samples").mapInPandas(run, f"{fields}, vector array<double>, n_batches long")
