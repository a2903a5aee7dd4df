"""Audio, vectors, task logs, queues, rendering and error rates on hand-made rows."""

import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parley.functions import processes, scalars, settings
from parley.operators import clustering as C
from parley.operators import metrics as M
from parley.operators import profiles as P
from parley.operators import publication as Q
from parley.operators import reads, rendering
from parley.operators import tasks as T
from parley.operators import timeline as TL
from parley.sources import audio, transcripts
from parley.streaming import tasks as S


def turns(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b), s) for a, b, s in rows], "rec long, start double, end double, speaker string")


def test_no_reference_speech(spark):
    got = M.evaluation(turns(spark, []), turns(spark, [(0, 10, "x")])).first()
    assert (got["der"], got["jer"], got["ref_speakers"], got["hyp_speakers"], got["count_error"], got["mapping"]) == (10.0, 0.0, 0, 1, 1, {"x": None})


def test_overlap_left_out(spark):
    ref, hyp = turns(spark, [(0, 4, "a"), (2, 6, "b")]), turns(spark, [(0, 2, "x"), (2, 4, "y"), (4, 6, "y")])
    whole, single = M.evaluation(ref, hyp).first(), M.evaluation(ref, hyp, ignore_overlap=True).first()
    assert (whole["ref_seconds"], whole["missed"], whole["confused"], whole["scored_seconds"]) == (8.0, 2.0, 0.0, 6.0)
    assert (single["ref_seconds"], single["missed"], single["der"], single["jer"], single["scored_seconds"]) == (4.0, 0.0, 0.0, 0.0, 4.0)
    assert single["mapping"] == {"x": "a", "y": "b"} and single["ignore_overlap"]
    # In the overlap alone, x would have been b.
    ref, hyp = turns(spark, [(0, 9, "a"), (0, 8, "b")]), turns(spark, [(0, 8, "x"), (8, 9, "y")])
    assert M.evaluation(ref, hyp, ignore_overlap=True).first()["mapping"] == {"x": None, "y": "a"}


@pytest.mark.parametrize("n", [2, 5, 7, 9])
def test_ties_go_to_the_first_labels(n):
    from itertools import permutations

    r = np.random.default_rng(n)
    for rows, cols in ((n, n), (n, max(2, n - 2)), (max(2, n - 2), n)):
        w = r.integers(0, 3, (rows, cols)).astype(float)
        got = M.assignment(w)
        size = max(rows, cols)
        square = np.zeros((size, size))
        square[:rows, :cols] = w
        assert sorted(got) == list(range(size))
        if size <= 7:
            rank = lambda p: [p[i] if square[i, p[i]] > 0 else size for i in range(rows)]  # noqa: E731, B023
            best = min(permutations(range(size)), key=lambda p: (-square[range(size), p].sum(), rank(p)))  # noqa: B023
            assert square[range(size), got].sum() == square[range(size), best].sum() and rank(got) == rank(best)


def test_strict_turns(spark):
    with pytest.raises(PySparkException):
        M.normalize_turns(turns(spark, [(3, 1, "a")]), strict=True).collect()
    assert M.normalize_turns(turns(spark, [(3, 1, "a"), (0, 1, " b ")])).count() == 1


def test_subtitles_and_markdown(spark):
    rows = [(1, 0, 0, 1000, "Ada", "hi"), (1, 1, 5000, 5000, None, None), (1, 2, None, 4000, "", "x")]
    s = spark.createDataFrame(rows, "rec long, seg_idx long, start_ms long, end_ms long, speaker string, text string")
    srt = rendering.subtitles(s).first()["subtitles"]
    assert srt == "1\n00:00:00,000 --> 00:00:01,000\nAda：hi\n\n2\n00:00:05,000 --> 00:00:10,000\n未知说话人：\n\n3\n00:00:10,000 --> 00:00:15,000\n未知说话人：x\n"
    assert rendering.subtitles(s, ".").first()["subtitles"].startswith("WEBVTT\n\n1\n00:00:00.000")
    tasks = spark.createDataFrame([(1, "task_a", "/a.wav"), (2, "task_b", "/b.wav")], "rec long, task_id string, audio_path string")
    md = {r["rec"]: r["markdown"] for r in rendering.markdown(s, tasks).collect()}
    assert md[1].startswith("# 本地转写\n\n- 任务：task_a\n- 音频：/a.wav\n- 片段数：3\n\n### [00:00:00] Ada\nhi\n### [00:00:05] 未知说话人\n\n### [--:--:--] 未知说话人\nx\n")
    assert md[2] == "# 本地转写\n\n- 任务：task_b\n- 音频：/b.wav\n- 片段数：0\n\n"


def test_revisions_are_kept(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "seg_0001", 0, 1000, "a", "hi")], "rec long, seg_idx long, id string, start_ms long, end_ms long, speaker string, text string")
    tasks = spark.createDataFrame([(1, "t", "/a")], "rec long, task_id string, audio_path string")
    rendering.write_artifacts(s, tasks, str(tmp_path), 1, ("srt",))
    rendering.write_artifacts(s, tasks, str(tmp_path), 2)
    with pytest.raises(PySparkException):
        rendering.write_artifacts(s, tasks, str(tmp_path), 1)
    with pytest.raises(ValueError):
        rendering.write_artifacts(s, tasks, str(tmp_path), 0)
    assert spark.read.json(str(tmp_path / "revisions/000001/transcript.srt")).first()["value"].startswith("1\n00:00:00,000")
    assert sorted(x.name for x in (tmp_path / "revisions").iterdir()) == ["000001", "000002"]


def test_transcript_reads(spark):
    s = spark.createDataFrame([(1, k, f"seg_{k + 1:04d}", f"t{k}", "person_a" if k == 2 else None) for k in range(3)], "rec long, seg_idx long, id string, text string, person_id string")
    tasks = spark.createDataFrame([(1, "whole"), (2, "none")], "rec long, text string")
    page = lambda *a, **b: {r["rec"]: (r["text"], r["text_scope"], r["total_segments"], r["returned_segments"], r["has_more"]) for r in reads.transcripts(tasks, s, *a, **b).collect()}
    assert page(offset=1, limit=1, include_text=True)[1] == ("t1", "selected_segments", 3, 1, True)
    assert page(offset=3)[1] == (None, "none", 3, 0, False)
    assert page(include_text=True) == {1: ("whole", "full", 3, 3, False), 2: ("none", "full", 0, 0, False)}
    asked = spark.createDataFrame([(1, "seg_0002"), (1, "seg_0009")], "rec long, id string")
    assert page(asked, include_text=True)[1] == ("t1", "selected_segments", 3, 1, False)
    assert [(r["index"], r["n_matches"]) for r in reads.search(s, person_id="person_a").collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        reads.search(s, " ")


def test_json_intake(spark, tmp_path):
    raw = spark.createDataFrame([(1, '[{"start": 1, "end": 2, "text": " <|x|> a  b ", "speaker": "s", "confidence": 0.5}, {"text": " "}, {"text": "c"}]')], "rec long, raw string")
    got = [(r["id"], r["start"], r["text"], r["speaker"], r["confidence"]) for r in transcripts.parse_asr_json(raw).orderBy("seg_idx").collect()]
    assert got == [("seg_0001", 1.0, "<|x|> a  b", "s", 0.5), ("seg_0002", None, "c", "unknown", None)]
    timed = spark.createDataFrame([(1, "\t[0.5-1.5] hi\n")], "rec long, raw string")
    assert transcripts.parse_asr_lines(timed).first()["start"] == 0.5
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert transcripts.read_json_documents(spark, str(tmp_path / "good.json"), "a long").first()["a"] == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        transcripts.read_json_documents(spark, str(tmp_path / "bad.json"), "a long").collect()
    assert transcripts.read_json_documents(spark, str(tmp_path / "none.json"), "a long", [(7,)]).first()["a"] == 7
    found = {r["name"]: r["size"] for r in transcripts.file_identity(spark, str(tmp_path), "*.json").collect()}
    assert found == {"good.json": 8, "bad.json": 6}


def test_learning(spark):
    clusters = spark.createDataFrame([(1, "a", True, "stable", 1, [1.0, 0.0]), (1, "b", True, "transient", 9, [0.0, 1.0]), (1, "c", False, "stable", 9, [0.0, 1.0])], "rec long, cluster string, trusted boolean, stability string, n_windows long, v array<double>")
    row = lambda c, purity=None, mixed=False, speaker="x": (1, c, speaker, mixed, purity, 0, 1000)
    kind = "rec long, cluster string, speaker string, mixed boolean, purity double, start_ms long, end_ms long"
    one = spark.createDataFrame([row("a"), row("a", 0.9), row("b"), row("c"), row("a", 0.5), row("a", None, True), row("a", None, False, "unknown")], kind)
    # Two eligible segments of a second; their one cluster's window counts once.
    assert tuple(P.learning_evidence(one, clusters).first()) == (1, 2.0, 1, True, True)
    assert P.learning_vectors(one, clusters).first()["prototype"] == [1.0, 0.0]
    assert tuple(P.learning_evidence(spark.createDataFrame([row("b")], kind), clusters).first()) == (1, 0.0, 0, False, False)


def test_derived_quality_without_segments(spark):
    segments = spark.createDataFrame([], "rec long, mixed boolean, speaker string")
    clusters = spark.createDataFrame([(1, True), (1, True)], "rec long, trusted boolean")
    counts = spark.createDataFrame([(1, True)], "rec long, exceeded boolean")
    row = Q.derived_quality(segments, clusters, counts).first()
    assert (row["coverage"], row["codes"], row["state"]) == (1.0, ["speaker_count_exceeded"], "reliable")


def test_nested_redaction(spark):
    row = spark.sql("select array(map('k', named_struct('vector', 1, 'x', 2), '_p', named_struct('vector', 1, 'x', 2))) as a")
    assert Q.redacted(row).first()["a"][0]["k"].asDict() == {"x": 2} and list(Q.redacted(row).first()["a"][0]) == ["k"]


def test_audio_ranges(spark, tmp_path):
    samples = (np.sin(np.arange(16000) / 20) * 1.2).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(samples))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    path = files.first()["path"]
    ranges = spark.createDataFrame([(1, path, 0, 100), (2, path, 15990, 99999), (3, path, 50, 50), (4, path, -5, 3)], "k long, path string, begin long, end long")
    got = {r["k"]: r["samples"] for r in audio.read_ranges(files, ranges).collect()}
    clipped = np.clip(samples, -1, 1)
    assert np.allclose(got[1], clipped[:100], atol=2 / 32767) and len(got[2]) == 10 and got[3] == [] and len(got[4]) == 3
    back = audio.segment_files(audio.read_ranges(files, ranges.filter("k = 1"))).first()["content"]
    assert bytes(back) == audio.wav_bytes(np.array(got[1]))
    cut = spark.createDataFrame([(path, 0, 500)], "path string, start_ms long, end_ms long")
    assert len(audio.read_segments(spark, str(tmp_path), cut).first()["samples"]) == 8000
    with pytest.raises(ValueError):
        audio.wav_bytes(np.zeros(0))
    (tmp_path / "b.wav").write_bytes(audio.wav_bytes(samples)[:-100])
    short = spark.read.format("binaryFile").load(str(tmp_path / "b.wav")).select("path", "content")
    with pytest.raises(PySparkException):
        audio.read_ranges(short, short.select("path", F.lit(0).alias("begin"), F.lit(16000).alias("end"))).collect()
    (tmp_path / "c.wav").write_bytes(b"no")
    with pytest.raises(PySparkException):
        transcripts.wav_info(spark.read.format("binaryFile").load(str(tmp_path / "c.wav")), strict=True).collect()


def test_length_buckets():
    seen = []

    def model(batch):
        seen.append(batch.shape)
        return batch[:, -1]

    features = [np.full((n, 80), n, np.float32) for n in (5, 0, 1, 9, 2)] + [np.full((3, 10), 3, np.float32)]
    out, n = processes.in_batches(features, model, 2)
    assert n == 3 and seen == [(2, 2, 80), (2, 5, 80), (1, 9, 80)]
    assert out[1] is None and [x[0] for x in out if x is not None] == [5, 1, 9, 2, 3]  # short ones repeat their last frame
    assert out[5][9] == 3 and out[5][10] == 0
    with pytest.raises(ValueError):
        processes.in_batches(features, lambda b: b, 2)


def test_embedding_process(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, r.normal(size=n).tolist()) for k, n in enumerate((0, 399, 400, 4000))], "k long, samples array<float>")
    got = {x["k"]: x["vector"] for x in processes.embed_segments(rows).collect()}
    assert got[0] is None and got[1] is None and len(got[2]) == 80 and len(got[3]) == 80


def test_queue_by_simulation(spark):
    r = random.Random(2)
    rows = [(k % 3, k, r.randrange(60), r.randrange(1, 6)) for k in range(60)]
    got = {x["task_id"]: (x["started"], x["ended"]) for x in T.queued(spark.createDataFrame(rows, "lane long, task_id long, at long, duration long")).collect()}
    free = {}
    for lane, k, at, duration in sorted(rows, key=lambda x: (x[2], x[1])):
        start = max(at, free.get(lane, 0))
        free[lane] = start + duration
        assert got[k] == (start, start + duration)


def test_logs(spark, tmp_path):
    log = T.checkpoint_log(spark, str(tmp_path / "log"))
    add = lambda *rows: log.add(spark.createDataFrame(rows, "task_id string, seq long, asr_key string, n_chunks long"))
    add(("a", 1, "k", 1), ("b", 1, "k", 5))
    add(("a", 2, "k", 2))
    assert {r["task_id"]: r["n_chunks"] for r in log.live().collect()} == {"a": 2, "b": 5}
    log.clear(spark.createDataFrame([("b",)], "task_id string"), 3)
    assert {r["task_id"] for r in log.live().collect()} == {"a"}
    add(("b", 4, "k", 1))
    assert {r["task_id"] for r in log.live().collect()} == {"a", "b"}


def test_settings():
    o = settings.overridden(C.DEFAULT, "X_", {"X_MAX_SPEAKERS": "7", "X_MIN_COHERENCE": "oops", "X_SAMPLE_SIZE": ""})
    assert o.max_speakers == 7 and o.min_coherence == C.DEFAULT.min_coherence and o.sample_size == C.DEFAULT.sample_size
    assert settings.number("inf", 3) == 3 and settings.number("2.5", 3) == 2.5
    assert settings.first_existing([("env", None), ("app", "/no"), ("path", "/yes")], exists=lambda p: p == "/yes") == ("path", "/yes")


def test_random_ids(spark):
    ids = spark.range(50).select(scalars.random_id("task").alias("t"), scalars.random_id("learning").alias("l"))
    rows = ids.select("t", scalars.valid_id("task", F.col("t")).alias("a"), scalars.valid_id("learning", F.col("l")).alias("b")).collect()
    assert len({r["t"] for r in rows}) == 50 and all(r["a"] and r["b"] for r in rows)


def test_rolled_up(spark):
    points = spark.createDataFrame([(1, f"k{i}", i * 2000, i * 2000 + 1500, [1.0, 0.0] if i < 6 else [0.0, 1.0] if i < 8 else [0.0, 0.0]) for i in range(9)], "rec long, key string, start_ms long, end_ms long, v array<double>")
    scored, summary = C.cluster_points(points)
    windows = scored.select("rec", F.lit(0).cast("long").alias("seg_idx"), "key", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), F.lit(0.0).alias("seg_start"), F.lit(18000.0).alias("seg_end"), "label", F.when(F.col("label") == 0, "stable").when(F.col("label") > 0, "transient").otherwise("unknown").alias("stability"), "score")
    row = TL.rolled_up(scored, summary, windows, spark.createDataFrame([(1, 2)], "rec long, n_batches long")).first().asDict()
    assert len(row) == 18 and (row["windows"], row["valid_windows"], row["noise_windows"], row["clusters"], row["trusted_speakers"], row["forced_merges"], row["n_batches"]) == (9, 8, 1, 2, 1, 0, 2)


def test_streams(spark, tmp_path):
    rows = [("a", "k1", "2024-01-01 00:00:00", "view"), ("b", "k1", "2024-01-01 00:00:01", "view"), ("c", "k2", "2024-01-01 05:00:00", "error")]
    kind = "id string, request_key string, at string, event_type string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "s"))
    got = []
    S.run_available(S.deduplicated_starts(stream), lambda df, _: got.extend(r["request_key"] for r in df.collect()), str(tmp_path / "c1"), "append")
    assert sorted(got) == ["k1", "k2"]
    counts = []
    S.run_available(S.activity(stream.withColumnRenamed("at", "ts")), lambda df, _: counts.extend((r["event_type"], r["n"]) for r in df.collect()), str(tmp_path / "c2"), "append")
    assert ("view", 2) in counts


def test_matching_in_blocks(spark, monkeypatch):
    from parley.operators import matching

    r = np.random.default_rng(3)
    people = spark.createDataFrame([(f"person_{i:02d}", f"n{i}", r.normal(size=8).tolist()) for i in range(40)], "person_id string, name string, prototype array<double>")
    rows = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(200)], "k long, prototype array<double>")
    whole = sorted(map(tuple, matching.match_profiles(rows, ["k"], people).collect()))
    monkeypatch.setattr(matching, "BROADCAST_PROFILES", 7)
    assert sorted(map(tuple, matching.match_profiles(rows, ["k"], people).collect())) == whole and len(whole) > 20


def test_partial_texts(spark, tmp_path):
    kind = "task_id string, offset_s long, chunk_s long, text string, total long"
    spark.createDataFrame([("t", 300, 300, "b", 4), ("t", 0, 300, "a ", 4), ("u", 0, 300, None, 1)], kind).coalesce(1).write.parquet(str(tmp_path / "s"))
    out = str(tmp_path / "out")
    S.run_available(spark.readStream.schema(kind).parquet(str(tmp_path / "s")), S.partial_texts(out), str(tmp_path / "c"), "append")
    assert {r["task_id"]: (r["done"], r["percent"], r["covered_s"], r["text"]) for r in S.partial_view(spark, out).collect()} == {"t": (2, 52, 600, "a b"), "u": (1, 66, 300, "")}


def test_manifest_listing(spark):
    from parley.operators import manifests

    files = spark.createDataFrame([("b c.bin", "AB", 2), ("a", "CD", 1)], "name string, sha256 string, size long")
    assert [tuple(r) for r in manifests.listed(files, "https://x/y/", ("a",)).collect()] == [("a", "https://x/y/a", "cd", 1, False), ("b c.bin", "https://x/y/b+c.bin", "ab", 2, True)]
    with pytest.raises(PySparkException):
        manifests.listed(files.union(files), "https://x").collect()
