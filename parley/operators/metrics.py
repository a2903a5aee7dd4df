"""Timeline error rates: who spoke when, against a reference."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.intervals import active, elementary


def normalize_turns(rows: DataFrame, strict: bool = False) -> DataFrame:
    """rec, start, end, speaker of the rows that form a turn: speaker, else person_id, trimmed.

    With strict, a row that forms none raises an error instead of being dropped.
    """
    speaker = F.nullif(F.trim(F.coalesce(F.col("speaker"), F.col("person_id") if "person_id" in rows.columns else F.lit(None).cast("string"))), F.lit(""))
    good = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.abs(F.col("end").cast("double")) < float("inf")), F.lit(False)) & speaker.isNotNull()
    if strict:
        return rows.select("rec", "start", "end", F.when(good, speaker).otherwise(F.raise_error("invalid speaker segment")).alias("speaker"))
    return rows.filter(good).select("rec", "start", "end", speaker.alias("speaker"))


def co_activity(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """rec, ref, hyp and seconds: how long just these labels of either side, as sorted arrays, are active.

    All error rates follow from these rows, of which a recording has no more than
    sets of labels that meet; both sides' intervals are cut and expanded once.
    """
    side = lambda df, name: df.select("rec", "start", "end", F.struct(F.lit(name).alias("side"), "speaker").alias("label"))
    both = side(ref, "ref").union(side(hyp, "hyp"))
    grid = elementary(both, ["rec"])
    of = lambda name: F.array_sort(F.collect_set(F.when(F.col("label.side") == name, F.col("label.speaker")))).alias(name)
    sets = active(both, grid, ["rec"], "label").groupBy("rec", "rank").agg(of("ref"), of("hyp"))
    none = F.array().cast("array<string>")
    per = grid.filter("end is not null").join(sets, ["rec", "rank"], "left").select("rec", F.coalesce("ref", none).alias("ref"), F.coalesce("hyp", none).alias("hyp"), (F.col("end") - F.col("start")).alias("length"))
    return per.groupBy("rec", "ref", "hyp").agg(F.sum("length").alias("seconds"))


def overlap_matrix(ref: DataFrame, hyp: DataFrame, ignore_overlap: bool = False) -> DataFrame:
    """rec, hyp, ref and the seconds in which both are active; with ignore_overlap, where one reference speaker is."""
    sets = co_activity(ref, hyp)
    if ignore_overlap:
        sets = sets.filter(F.size("ref") < 2)
    each = sets.select("rec", F.explode("hyp").alias("hyp"), "ref", "seconds").select("rec", "hyp", F.explode("ref").alias("ref"), "seconds")
    return each.groupBy("rec", "hyp", "ref").agg(F.sum("seconds").alias("seconds"))


def _least_costs(cost: np.ndarray) -> tuple[list[int], np.ndarray]:
    """An assignment of least cost, as the column of each row, and the reduced costs: shortest augmenting paths, a row at a time."""
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        best, reached_from, closed = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, length, last = start, 0.0, -1
        while True:
            through = length + cost[row] - row_price[row] - col_price
            better = ~closed & (through < best)
            best[better], reached_from[better] = through[better], last
            last = int(np.argmin(np.where(closed, np.inf, best)))
            closed[last], length = True, best[last]
            if row_of[last] < 0:
                break
            row = row_of[last]
        row_price[start] += length
        for col in np.flatnonzero(closed):
            if col != last:
                row_price[row_of[col]] += length - best[col]
            col_price[col] -= length - best[col]
        while last >= 0:
            previous = int(reached_from[last])
            row_of[last] = row_of[previous] if previous >= 0 else start
            last = previous
    out = [-1] * n
    for col, row in enumerate(row_of):
        out[row] = col
    return out, cost - row_price[:, None] - col_price


def _rematched(chosen: list[int], allowed: np.ndarray, row: int) -> list[int] | None:
    """chosen with row moved to one of its allowed columns, others moved as they may; None if they can't be."""
    out, owner = list(chosen), {c: r for r, c in enumerate(chosen) if r != row}
    free, came, queue = chosen[row], {}, [row]
    for r in queue:
        for c in np.flatnonzero(allowed[r]).tolist():
            if c in came:
                continue
            came[c] = r
            if c == free:
                while True:
                    r = came[c]
                    c, out[r] = out[r], c
                    if r == row:
                        return out
            queue.append(owner[c])
    return None


def assignment(weights: np.ndarray) -> list[int]:
    """For each row a column, all different, of greatest total weight, on a square matrix padded with zeros.

    Of several such assignments that one is taken whose first row has the first
    column of positive weight that any of them gives it, or else none; then the
    second row, and so on, at every size.
    """
    n = max(weights.shape)
    square = np.zeros((n, n))
    square[: weights.shape[0], : weights.shape[1]] = weights
    chosen, reduced = _least_costs(square.max() - square)
    # Any best assignment uses edges without reduced cost only, and any of these edges make a best one.
    allowed = reduced <= 1e-9 * max(1.0, square.max())
    allowed[np.arange(n), chosen] = True
    for row in range(weights.shape[0]):
        tight = allowed[row].copy()
        for some in [[c] for c in np.flatnonzero(tight & (square[row] > 0))] + [np.flatnonzero(tight & (square[row] == 0))]:
            if not len(some):
                continue
            allowed[row] = False
            allowed[row, some] = True
            moved = chosen if allowed[row, chosen[row]] else _rematched(chosen, allowed, row)
            if moved:
                chosen = moved
                break
    return [int(c) for c in chosen]


def _mapped(table: dict[tuple[str, str], float], hyps: list[str], refs: list[str]) -> dict[str, str]:
    """The reference label of each hypothesis label that has one, from the seconds in which both are active."""
    if not hyps or not refs:
        return {}
    w = np.array([[float(table.get((h, r), 0)) for r in refs] for h in hyps])
    return {hyps[i]: refs[j] for i, j in enumerate(assignment(w)[: len(hyps)]) if j < len(refs) and w[i, j] > 0}


def speaker_mapping(matrix: DataFrame) -> DataFrame:
    """rec, hyp, ref, seconds of the assignment of greatest total overlap; labels without overlap aren't mapped.

    One group is one recording's matrix of labels, not its rows.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        table = {(h, r): s for h, r, s in zip(group["hyp"], group["ref"], group["seconds"], strict=True)}
        found = _mapped(table, sorted({h for h, _ in table}), sorted({r for _, r in table}))
        return pd.DataFrame([(group["rec"].iloc[0], h, r, table[h, r]) for h, r in found.items()], columns=["rec", "hyp", "ref", "seconds"])

    return matrix.groupBy("rec").applyInPandas(solve, matrix.select("rec", "hyp", "ref", "seconds").schema)


def _rounded(x: float) -> float:
    return math.floor(x * 1e6 + 0.5) / 1e6


def evaluation(ref: DataFrame, hyp: DataFrame, ignore_overlap: bool = False) -> DataFrame:
    """A row for each recording of either side: numbers of speakers, mapping (null: not mapped), seconds scored and of each error, der and jer.

    With ignore_overlap, time with more than one reference speaker neither counts
    nor takes part in the mapping. Without reference speech, errors are divided by
    one second. jer is the mean over reference speakers of 1 - intersection / union
    with the mapped label, 1 where there is none.
    """
    sets = co_activity(ref, hyp)
    number = sets.schema["seconds"].dataType
    seconds = ("scored_seconds", "ref_seconds", "missed", "false_alarm", "confused")
    schema = T.StructType(
        [sets.schema["rec"], *(T.StructField(x, T.LongType()) for x in ("ref_speakers", "hyp_speakers", "count_error")), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))]
        + [T.StructField(x, number) for x in seconds] + [T.StructField("der", T.DoubleType()), T.StructField("jer", T.DoubleType()), T.StructField("ignore_overlap", T.BooleanType())]
    )

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(list(r), list(h), s) for r, h, s in zip(group["ref"], group["hyp"], group["seconds"], strict=True)]
        refs, hyps = (sorted({x for row in rows for x in row[k]}) for k in (0, 1))
        scored = [row for row in rows if not ignore_overlap or len(row[0]) < 2]
        table: dict[tuple[str, str], float] = {}
        for r, h, s in scored:
            for pair in ((y, x) for x in r for y in h):
                table[pair] = table.get(pair, 0) + s
        mapping = _mapped(table, hyps, refs)
        total = dict.fromkeys(seconds, 0)
        spoken: dict[tuple[str, str], float] = {}
        for r, h, s in scored:
            right = len({mapping.get(x) for x in h} & set(r))
            for name, times in zip(seconds, (1, len(r), max(0, len(r) - len(h)), max(0, len(h) - len(r)), min(len(r), len(h)) - right), strict=True):
                total[name] += times * s
            for kind, labels in (("ref", r), ("hyp", h)):
                for x in labels:
                    spoken[kind, x] = spoken.get((kind, x), 0) + s
        errors = []
        by_ref = {r: h for h, r in mapping.items()}
        for r in refs:
            h = by_ref.get(r)
            errors.append(1.0 if h is None else 1 - table[h, r] / (spoken["ref", r] + spoken["hyp", h] - table[h, r]))
        wrong = total["missed"] + total["false_alarm"] + total["confused"]
        if not isinstance(number, T.LongType):
            total = {k: _rounded(v) for k, v in total.items()}
        der = _rounded(wrong / (total["ref_seconds"] or 1))
        row = (group["rec"].iloc[0], len(refs), len(hyps), len(hyps) - len(refs), {h: mapping.get(h) for h in hyps}, *(total[k] for k in seconds), der, _rounded(sum(errors) / len(errors) if errors else 0.0), ignore_overlap)
        return pd.DataFrame([row], columns=schema.names)

    return sets.groupBy("rec").applyInPandas(solve, schema)


def error_rates(ref: DataFrame, hyp: DataFrame, ignore_overlap: bool = False) -> DataFrame:
    """Per recording: seconds of reference speech, missed, false alarm and confused, and der."""
    return evaluation(ref, hyp, ignore_overlap).select("rec", "ref_seconds", "missed", "false_alarm", "confused", "der")


def jaccard_error(ref: DataFrame, hyp: DataFrame, ignore_overlap: bool = False) -> DataFrame:
    """Per recording: the number of reference speakers and the mean of their errors, jer."""
    return evaluation(ref, hyp, ignore_overlap).select("rec", F.col("ref_speakers").alias("n_speakers"), "jer")
