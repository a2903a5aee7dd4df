"""Golden cases of the timeline, clustering and metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import clustering as C
from parley.operators import metrics as M
from parley.operators import timeline as T


def turns(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b), s) for a, b, s in rows], "rec long, start double, end double, speaker string")


@pytest.mark.parametrize(
    ("ref", "hyp", "der", "parts"),
    [
        ([(0, 1, "alice"), (1, 2, "bob")], [(0, 1, "x"), (1, 2, "y")], 0.0, (0, 0, 0)),
        ([(0, 1, "alice"), (1, 2, "bob")], [(0, 2, "x")], 0.5, (0, 0, 1)),
        ([(0, 2, "alice")], [(0.5, 2, "x"), (2, 2.5, "x")], 0.5, (0.5, 0.5, 0)),
    ],
)
def test_error_rates(spark, ref, hyp, der, parts):
    row = M.error_rates(turns(spark, ref), turns(spark, hyp)).first()
    assert row["der"] == der and (row["missed"], row["false_alarm"], row["confused"]) == parts


def windows(spark, rows):
    rows = [(seg, key, *map(float, times), label, kind, score) for seg, key, *times, label, kind, score in rows]
    return spark.createDataFrame([(1, *r) for r in rows], "rec long, seg_idx long, key string, start_ms double, end_ms double, seg_start double, seg_end double, label int, stability string, score double")


def spans(spark, rows, stage="timeline"):
    return T.stages(windows(spark, rows))[stage].orderBy("start").collect()


def test_bridge_in_a_segment(spark):
    rows = [(0, "a", 0, 1000, 0, 3000, 0, "stable", 0.9), (0, "b", 1000, 2000, 0, 3000, 1, "transient", 0.8), (0, "c", 2000, 3000, 0, 3000, 0, "stable", 0.9)]
    got = spans(spark, rows)
    assert [(r["start"], r["end"], r["shown"]) for r in got] == [(0, 3000, 0)]
    c = T.counters(windows(spark, rows)).first()
    assert (c["bridged"], c["raw_mixed"], c["shown_mixed"], c["suppressed"]) == (1, 1, 0, 0)


def test_noise_is_not_suppressed(spark):
    rows = [(0, "a", 0, 1000, 0, 1000, 0, "stable", 0.9), (1, "b", 5000, 5260, 5000, 5260, 1, "transient", 0.8)]
    c = T.counters(windows(spark, rows)).first()
    assert (c["noise"], c["suppressed"]) == (1, 0)


def test_between_different_speakers(spark):
    rows = [(0, "a", 0, 1000, 0, 4000, 0, "stable", 0.9), (0, "b", 1000, 3000, 0, 4000, 2, "transient", 0.8), (0, "c", 3000, 4000, 0, 4000, 1, "stable", 0.9)]
    assert [r["shown"] for r in spans(spark, rows)] == [0, -1, 1]
    vote = T.vote(T.stages(windows(spark, rows))["inherited"]).first()
    assert vote["mixed"] and vote["cluster"] == 0


def points(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "rec long, key string, start_ms long, end_ms long, v array<double>")


def test_two_voices_whatever_the_order(spark):
    rows = [("a", 0, 1500, [1.0, 0.0, 0.0]), ("b", 1500, 3000, [0.95, 0.05, 0.0]), ("c", 3000, 4500, [0.0, 1.0, 0.0]), ("d", 4500, 6000, [0.0, 0.95, 0.05]), ("e", 6000, 7500, [0.0, 0.0, 0.0])]
    want = {"a": 0, "b": 0, "c": 1, "d": 1, "e": -1}
    for order in (rows, rows[::-1]):
        assert {r["key"]: r["label"] for r in C.cluster_points(points(spark, order))[0].collect()} == want


def test_overlapping_windows_are_not_trusted(spark):
    rows = [("a", 0, 1500, [1.0, 0.0]), ("b", 750, 2250, [1.0, 0.0])]
    assert not C.cluster_points(points(spark, rows))[1].first()["trusted"]


def test_cap_never_merges(spark):
    rows = [(f"{v}{i}", i * 2000 + n * 40_000, i * 2000 + n * 40_000 + 1500, [float(n == k) for k in range(3)]) for n, v in enumerate("abc") for i in range(6)]
    out = C.cluster_points(points(spark, rows), C.ClusterOptions(max_speakers=2))[1].collect()
    assert len(out) == 3 and sum(r["trusted"] for r in out) == 2 and all(r["exceeded"] for r in out)


def test_same_voice_after_a_gap(spark):
    rows = [("a", 0, 1500, [1.0, 0.1]), ("b", 2_400_000, 2_401_500, [1.0, 0.1])]
    assert len({r["label"] for r in C.cluster_points(points(spark, rows))[0].collect()}) == 1


def test_empty_tables(spark):
    none = points(spark, []).filter("false")
    assert C.micro_edges(none).count() == 0
    assert M.error_rates(turns(spark, []), turns(spark, [])).count() == 0
    assert T.stages(windows(spark, []))["timeline"].count() == 0
    assert C.sample_members(none.withColumn("c", F.lit(1)), ["rec", "c"]).count() == 0


def voice(k):
    """A unit vector of 16 numbers of a made-up speaker."""
    v = np.full(16, 0.03)
    for at, x in ((k % 16, 5.0), ((k * 3 + 5) % 16, 1.4), ((k * 7 + 11) % 16, 0.6)):
        v[at] += x
    return v / np.linalg.norm(v)


def drifted(v, t):
    """The voice some time later."""
    out = v + 0.06 * np.sin(t / 1800 + np.arange(16) * 0.35)
    return (out / np.linalg.norm(out)).tolist()


def test_long_meeting_shows_as_many_voices_as_spoke(spark):
    rows = [(f"spk{k}-c{c}-{i}", int(1000 * t), int(1000 * t) + 1500, drifted(voice(k), t)) for c in range(4) for k in range(10) for i in range(4) for t in [c * 220.0 + k * 20.0 + i * 1.6]]
    summary = C.cluster_points(points(spark, rows))[1].collect()
    assert 8 <= sum(r["trusted"] for r in summary) <= 14 and len(summary) >= sum(r["trusted"] for r in summary)


def test_similar_voices_stay_apart(spark):
    first, second = voice(1), voice(2) + 0.22 * voice(1)
    second = second / np.linalg.norm(second)
    rows = [(f"{n}-{i}", int(at * 1000 + i * 1600), int(at * 1000 + i * 1600) + 1500, drifted(v, i)) for n, v, at in (("a", first, 0), ("b", second, 24)) for i in range(5)]
    scored, summary = C.cluster_points(points(spark, rows))
    label = {r["key"]: r["label"] for r in scored.collect()}
    assert label["a-0"] == label["a-4"] != label["b-0"] == label["b-4"]
    assert sum(r["trusted"] for r in summary.collect()) == 2


def test_noise_stays_sparse(spark):
    r = np.random.default_rng(0)
    rows = [(f"noise-{i}", i * 2000, i * 2000 + 400, r.uniform(-1, 1, 64).tolist()) for i in range(4000)]
    noise = points(spark, rows)
    micro = C.micro_clusters(noise).cache()
    assert micro.select("cluster").distinct().count() >= 3000
    proto = C.prototypes(noise.join(micro, ["rec", "key"]), ["rec", "cluster"])
    first = noise.join(micro, ["rec", "key"]).groupBy("rec", "cluster").agg(F.min("start_ms").alias("first_ms"))
    pairs = C.candidates(proto.join(first, ["rec", "cluster"])).count()
    assert pairs <= 4000 * (48 + 64 + 32)
    assert C.cluster_points(noise)[1].filter("trusted").count() <= 2


def naive_merge(sizes, samples, spans, scores, o):
    """Clusters after merging the best permitted pair again and again, all pairs looked at each time."""
    groups = {i: {i} for i in range(len(sizes))}
    weight = {frozenset(p): s for p, s in scores.items()}
    size, sample, span = dict(enumerate(sizes)), dict(enumerate(samples)), dict(enumerate(spans))
    refused = set()
    floor = lambda v: sorted(v)[int(np.floor((len(v) - 1) * o.floor_fraction))] if len(v) else -1.0

    def drawn(a):
        rows = sorted(sample[a], key=lambda x: x[0])
        return [v for _, v in (rows if len(rows) <= o.sample_size else [rows[i * len(rows) // o.sample_size] for i in range(o.sample_size)])]

    def established(a):
        covered, reach, last, n = 0, -1, None, 0
        for s, e in sorted(span[a]):
            covered, reach = covered + max(0, e - max(s, reach)), max(reach, e)
            if e - s >= o.evidence_ms and (last is None or s >= last):
                n, last = n + 1, e
        return n >= o.established_evidence and covered >= o.established_ms

    def refuse(a, b, score):
        x, y = drawn(a), drawn(b)
        mean = np.sum(x + y, axis=0)
        if np.linalg.norm(mean) == 0 or floor([v @ mean / np.linalg.norm(mean) for v in x + y]) < o.consolidate_floor or floor([v @ w for v in x for w in y]) < o.consolidate_floor:
            return True
        if score >= o.established_threshold:
            return False
        rivals = [weight[frozenset((c, d))] for c, other in ((a, b), (b, a)) for d in groups if d not in (c, other) and frozenset((c, d)) in weight]
        return bool(rivals and max(rivals) > -1 and score - max(rivals) < o.consolidate_margin) or established(a) or established(b)

    while True:
        best = None
        for p, s in weight.items():
            a, b = sorted(p)
            if a in groups and b in groups and s >= o.consolidate_threshold and (p, size[a], size[b]) not in refused and (best is None or (-s, a, b) < best):
                best = (-s, a, b)
        if best is None:
            return groups
        s, a, b = -best[0], best[1], best[2]
        if refuse(a, b, s):
            refused.add((frozenset((a, b)), size[a], size[b]))
            continue
        for c in groups:
            x, y = weight.get(frozenset((a, c))), weight.get(frozenset((b, c)))
            if c not in (a, b) and (x is not None or y is not None):
                weight[frozenset((a, c))] = y if x is None else x if y is None else (x * size[a] + y * size[b]) / (size[a] + size[b])
        groups[a] |= groups.pop(b)
        size[a], sample[a], span[a] = size[a] + size[b], sample[a] + sample[b], span[a] + span[b]


@pytest.mark.parametrize("seed", range(4))
def test_consolidation_against_plain_merging(spark, seed):
    r = np.random.default_rng(seed)
    voices = [voice(int(k)) + r.normal(size=16) * 0.1 for k in r.integers(0, 6, 4)]
    rows = []
    for i in range(48):
        v = voices[int(r.integers(0, 4))] + r.normal(size=16) * r.choice([0.03, 0.12])
        rows.append((f"k{i:03d}", i * 4000, i * 4000 + 1500, (v / np.linalg.norm(v)).tolist()))
    o = C.DEFAULT.settled()
    table = points(spark, rows)
    micro = {x["key"]: x["cluster"] for x in C.micro_clusters(table, o).collect()}
    names = sorted(set(micro.values()), key=lambda c: (min(s for k, s, *_ in rows if micro[k] == c), c))
    at = {c: i for i, c in enumerate(names)}
    members = [[x for x in rows if micro[x[0]] == c] for c in names]
    proto = C.prototypes(table.join(C.micro_clusters(table, o), ["rec", "key"]), ["rec", "cluster"])
    first = table.join(C.micro_clusters(table, o), ["rec", "key"]).groupBy("rec", "cluster").agg(F.min("start_ms").alias("first_ms"))
    scores = {(at[x["a"]], at[x["b"]]): x["score"] for x in C.candidates(proto.join(first, ["rec", "cluster"]), o).collect()}
    groups = naive_merge([len(m) for m in members], [[(k, np.array(v)) for k, _, _, v in m] for m in members], [[(s, e) for _, s, e, _ in m] for m in members], scores, o)
    want = {frozenset(k for i in g for k, *_ in members[i]) for g in groups.values()}
    got = {}
    for x in C.consolidate(table, C.micro_clusters(table, o), o).collect():
        got.setdefault(x["cluster"], set()).add(x["key"])
    assert {frozenset(x) for x in got.values()} == want
