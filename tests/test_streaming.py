"""The streaming operators over files, to the end of what is there."""

import json

from parley.streaming import tasks as S


def test_requests_and_states(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(["", json.dumps({"jsonrpc": "2.0", "id": "1", "method": "health", "params": {}}), "junk"]))
    got = []
    S.run_available(S.requests(spark, str(src)), lambda df, _: got.extend(tuple(r) for r in df.select("id", "method", "error").collect()), str(tmp_path / "c1"), "append")
    assert sorted(got, key=str) == [("1", "health", None), (None, None, "invalid_request")]

    rows = [("t1", 1, "queued"), ("t1", 2, "running"), ("t2", 5, "failed"), ("t2", 4, "running")]
    spark.createDataFrame(rows, "task_id string, seq long, status string").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("task_id string, seq long, status string").parquet(str(tmp_path / "ev"))
    last = {}
    S.run_available(S.task_states(events), lambda df, _: last.update({r["task_id"]: (r["status"], r["n_events"]) for r in df.collect()}), str(tmp_path / "c2"))
    assert last == {"t1": ("running", 2), "t2": ("failed", 2)}


def test_progress(spark, tmp_path):
    spark.createDataFrame([("t", 1, 4), ("t", 2, 4)], "task_id string, chunk long, total long").write.parquet(str(tmp_path / "ch"))
    stream = spark.readStream.schema("task_id string, chunk long, total long").parquet(str(tmp_path / "ch"))
    out = {}
    S.run_available(S.chunk_counts(stream), lambda df, _: out.update({r["task_id"]: (r["done"], r["percent"]) for r in df.collect()}), str(tmp_path / "c"))
    assert out == {"t": (2, 52)}
