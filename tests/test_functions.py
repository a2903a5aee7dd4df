"""Scalars, vectors, intervals and parsing on hand-made rows."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import vectors as V
from parley.operators import intervals as I
from parley.operators.metrics import assignment
from parley.sources import transcripts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, S.clean_text(F.lit("<|en|>  a \n b <|x|>"))) == "a b"


def test_clock(spark):
    assert one(spark, S.format_clock(F.lit(3723.9))) == "01:02:03"
    assert one(spark, S.format_clock(F.lit(None).cast("double"))) == "--:--:--"
    assert one(spark, S.subtitle_clock(F.lit(3723045), ".")) == "01:02:03.045"


def test_person_id(spark):
    assert one(spark, S.person_id(F.lit("  Ada  Lovelace! "))) == "person_ada_lovelace"
    assert one(spark, S.person_id(F.lit("?!"))).startswith("person_") and len(one(spark, S.person_id(F.lit("?!")))) == 23


def test_identifiers(spark):
    assert one(spark, S.valid_id("person", F.lit("person_Ünal-1")))
    assert not one(spark, S.valid_id("task", F.lit("task_XYZ")))
    assert not one(spark, S.valid_id("task", F.lit(None).cast("string")))
    assert one(spark, S.valid_person_name(F.lit(" x "))) and not one(spark, S.valid_person_name(F.lit("  ")))


def test_clamp(spark):
    assert one(spark, S.clamp(F.lit("7"), 0, 5, 1)) == 5
    assert one(spark, S.clamp(F.lit("x"), 0, 5, 1)) == 1
    assert one(spark, S.clamp(F.lit("NaN"), 0, 5, 1)) == 1


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, V.unit(F.array(F.lit(0.0)))) is None
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None
    assert one(spark, V.clamped_cosine(a, F.array(F.lit(1.0)))) == -1
    assert abs(one(spark, V.cosine(a, a)) - 1) < 1e-12


def test_union_and_evidence(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0), (1, 7.0, 7.0), (2, 0.0, 1.0)], "k int, start double, end double")
    got = {r["k"]: r["n"] for r in I.union_length(rows, ["k"], name="n").collect()}
    assert got == {1: 4.0, 2: 1.0}
    kept = rows.groupBy("k").agg(I.greedy_disjoint(F.collect_list(F.struct("start", "end")), 1.0).alias("n"))
    assert {r["k"]: r["n"] for r in kept.collect()} == {1: 2, 2: 1}
    assert sorted((r["start"], r["end"]) for r in I.merged(rows, ["k"]).filter("k = 1").collect()) == [(0.0, 3.0), (5.0, 6.0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(7, 9), st.integers(0, 10_000))
def test_assignment_is_best(n, seed):
    from itertools import permutations

    w = np.random.default_rng(seed).integers(0, 20, (n, n)).astype(float) if n < 8 else np.random.default_rng(seed).integers(0, 20, (n, 7)).astype(float)
    got = assignment(w)
    square = np.zeros((max(w.shape),) * 2)
    square[: w.shape[0], : w.shape[1]] = w
    assert sorted(got) == list(range(len(square)))
    if n == 7:
        assert square[range(n), got].sum() == max(square[range(n), list(p)].sum() for p in permutations(range(n)))


def test_parsers(spark):
    raw = spark.createDataFrame([(1, "main: start\r\n[1.12-3.42] <|en|>hi  there\n[3.87-6.53] you\nplain"), (2, "hello\n world"), (3, ""), (4, None)], "rec long, raw string")
    got = {(r["rec"], r["id"]): (r["start"], r["end"], r["text"]) for r in transcripts.parse_asr_lines(raw).collect()}
    assert got == {(1, "seg_0001"): (1.12, 3.42, "hi there"), (1, "seg_0002"): (3.87, 6.53, "you"), (2, "seg_0001"): (None, None, "hello world")}
    lines = spark.createDataFrame([("# c",), ("",), ("SPEAKER m 1 0.0 1.25 <NA> <NA> alice <NA> <NA>",), ("SPEAKER other 1 0 2 <NA> <NA> carol <NA> <NA>",), ("SPEAKER m 1 1.25 0 <NA> <NA> bob <NA> <NA>",)], "value string")
    assert [tuple(r) for r in transcripts.parse_rttm(lines, "m").collect()] == [("m", "alice", 0.0, 1.25)]


def test_wav_header(spark, tmp_path):
    import struct

    data = b"\0\0" * 16000
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "a.wav").write_bytes(head + data)
    (tmp_path / "b.wav").write_bytes(b"not a wav file")
    rows = {r["path"].rpartition("/")[2]: r for r in transcripts.read_wav_info(spark, str(tmp_path)).collect()}
    assert (rows["a.wav"]["seconds"], rows["a.wav"]["usable"], rows["a.wav"]["data_offset"]) == (1.0, True, len(head))
    assert rows["b.wav"]["usable"] is False and rows["b.wav"]["seconds"] is None
