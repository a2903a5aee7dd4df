"""Queries of analysis windows and the smoothed timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import timeline as T
from parley.plans.registry import query
from parley.plans.views import POINTS, SEGMENTS, points, segments


def labelled(spark, sf_dir):
    """Points as labelled windows of four segments a recording."""
    seg = F.floor(F.col("idx") / 13)
    p = points(spark, sf_dir).select("rec", seg.alias("seg_idx"), "key", "start_ms", "end_ms", (seg * 9750).alias("seg_start"), F.least((seg + 1) * 9750 + 750, F.lit(49 * 750 + 1500)).alias("seg_end"), F.col("truth").alias("label"),
        F.when((F.col("rec") + F.col("truth")) % 4 == 0, F.lit("transient")).otherwise(F.lit("stable")).alias("stability"), ((50 + F.col("vec_id") % 50) / 100.0).alias("score"))
    return p


_W = f"""WITH RECURSIVE {POINTS},
w AS (SELECT rec, idx // 13 AS seg_idx, key, start_ms, end_ms, (idx // 13) * 9750 AS lo, least((idx // 13 + 1) * 9750 + 750, 49 * 750 + 1500) AS hi, truth AS cluster,
 CASE WHEN (rec + truth) % 4 = 0 THEN 'transient' ELSE 'stable' END AS stability, (50 + vec_id % 50)::DOUBLE / 100.0::DOUBLE AS confidence FROM pts),
v0 AS (SELECT *, (start_ms + end_ms)::DOUBLE / 2.0::DOUBLE AS c FROM w),
v1 AS (SELECT *, lag(c) OVER s AS b, lead(c) OVER s AS a FROM v0 WINDOW s AS (PARTITION BY rec, seg_idx ORDER BY c, key)),
vor AS (SELECT rec, seg_idx, key, (CASE WHEN b IS NULL THEN lo ELSE greatest(lo, least(hi, (b + c) / 2)) END)::DOUBLE AS t0, (CASE WHEN a IS NULL THEN hi ELSE greatest(lo, least(hi, (a + c) / 2)) END)::DOUBLE AS t1, cluster, stability, confidence FROM v1),
r0 AS (SELECT *, CASE WHEN lag(cluster) OVER s = cluster AND lag(stability) OVER s = stability AND lag(t1) OVER s = t0 THEN 0 ELSE 1 END AS n FROM vor WHERE t1 > t0 WINDOW s AS (PARTITION BY rec, seg_idx ORDER BY t0, t1, key)),
r1 AS (SELECT *, sum(n) OVER (PARTITION BY rec, seg_idx ORDER BY t0, t1, key) AS run FROM r0),
runs AS (SELECT rec, seg_idx, cluster, stability, min(key) AS key, min(t0) AS t0, max(t1) AS t1, sum(confidence * (t1 - t0)) / sum(t1 - t0) AS confidence FROM r1 GROUP BY rec, seg_idx, run, cluster, stability),
i0 AS (SELECT *, CASE WHEN stability <> 'transient' THEN 0 WHEN lag(stability) OVER s = 'transient' AND lag(cluster) OVER s = cluster AND t0 - lag(t1) OVER s <= 500 THEN 0 ELSE 1 END AS n FROM runs WINDOW s AS (PARTITION BY rec ORDER BY t0, t1, key, cluster, seg_idx)),
isl AS (SELECT * EXCLUDE (n), CASE WHEN stability = 'transient' THEN cast(sum(n) OVER (PARTITION BY rec ORDER BY t0, t1, key, cluster, seg_idx) AS BIGINT) END AS island, row_number() OVER (PARTITION BY rec ORDER BY t0, t1, key, cluster, seg_idx) AS rn FROM i0),
ie AS (SELECT rec, island, min(rn) AS f, max(rn) AS l, sum(t1 - t0) AS total FROM isl WHERE island IS NOT NULL GROUP BY ALL),
fate AS (SELECT ie.rec, ie.island, total, x.cluster AS into_c, (x.confidence + y.confidence) / 2 AS m, CASE WHEN total < 400 THEN 'noise'
 WHEN total <= 1500 AND coalesce(x.stability = 'stable' AND y.stability = 'stable' AND x.cluster = y.cluster AND f.t0 - x.t1 <= 500 AND y.t0 - l.t1 <= 500, false) THEN 'bridged' ELSE 'suppressed' END AS fate
 FROM ie JOIN isl f ON f.rec = ie.rec AND f.rn = ie.f JOIN isl l ON l.rec = ie.rec AND l.rn = ie.l LEFT JOIN isl x ON x.rec = ie.rec AND x.rn = ie.f - 1 LEFT JOIN isl y ON y.rec = ie.rec AND y.rn = ie.l + 1),
br AS (SELECT isl.rec, seg_idx, key, t0, t1, cluster, stability, rn, coalesce(fate, 'kept') AS fate, CASE WHEN fate IS NULL THEN cluster WHEN fate = 'bridged' THEN into_c ELSE -1 END AS shown,
 CASE WHEN fate IS NULL THEN confidence WHEN fate = 'bridged' THEN m ELSE 0.0::DOUBLE END AS confidence FROM isl LEFT JOIN fate ON fate.rec = isl.rec AND fate.island = isl.island),
h0 AS (SELECT b.*, coalesce(x.stability = 'stable' AND x.shown >= 0 AND b.t0 - x.t1 <= 500, false) AS lo, coalesce(y.stability = 'stable' AND y.shown >= 0 AND y.t0 - b.t1 <= 500, false) AS ro, x.shown AS lc, y.shown AS rc, x.confidence AS lf, y.confidence AS rf
 FROM br b LEFT JOIN br x ON x.rec = b.rec AND x.rn = b.rn - 1 LEFT JOIN br y ON y.rec = b.rec AND y.rn = b.rn + 1),
h1 AS (SELECT *, stability = 'transient' AND shown < 0 AND t1 - t0 < 1000 AND (lo OR ro) AND NOT (lo AND ro AND lc <> rc) AS takes FROM h0),
inh AS (SELECT rec, seg_idx, key, t0, t1, stability, CASE WHEN takes THEN CASE WHEN lo THEN lc ELSE rc END ELSE shown END AS shown, CASE WHEN takes THEN CASE WHEN lo THEN lf ELSE rf END ELSE confidence END AS confidence FROM h1),
p0 AS (SELECT *, CASE WHEN lag(shown) OVER s = shown AND lag(t1) OVER s = t0 THEN 0 ELSE 1 END AS n FROM inh WINDOW s AS (PARTITION BY rec, seg_idx ORDER BY t0, t1, key)),
p1 AS (SELECT *, sum(n) OVER (PARTITION BY rec, seg_idx ORDER BY t0, t1, key) AS run FROM p0),
tl AS (SELECT rec, seg_idx, shown, min(t0) AS t0, max(t1) AS t1, sum(confidence * (t1 - t0)) / sum(t1 - t0) AS confidence FROM p1 GROUP BY rec, seg_idx, run, shown),
vw AS (SELECT rec, seg_idx, shown, sum(t1 - t0) AS w FROM inh GROUP BY ALL),
vote AS (SELECT rec, seg_idx, coalesce((SELECT x.shown FROM vw x WHERE x.rec = vw.rec AND x.seg_idx = vw.seg_idx AND x.shown >= 0 ORDER BY w DESC, x.shown LIMIT 1), -1) AS cluster, coalesce(max(w) FILTER (WHERE shown >= 0) / sum(w), 0) AS purity, count(*) FILTER (WHERE shown >= 0) > 1 AS mixed FROM vw GROUP BY rec, seg_idx)"""


@query("analysis_windows", f"""WITH {SEGMENTS}, s AS (SELECT *, end_ms - start_ms AS d FROM seg WHERE end_ms - start_ms >= 250),
o AS (SELECT s.*, t.i * 750 AS o_at FROM s, unnest(range(0, 100)) t(i) WHERE (d <= 1500 AND i = 0) OR (d > 1500 AND i * 750 + 1500 <= d) UNION SELECT s.*, d - 1500 FROM s WHERE d > 1500)
SELECT rec, seg_idx, id || ':w' || (row_number() OVER (PARTITION BY rec, seg_idx ORDER BY o_at) - 1) AS key, start_ms + o_at AS start_ms, least(end_ms, start_ms + o_at + 1500) AS end_ms FROM o""")
def _(spark, sf_dir):
    return T.analysis_windows(segments(spark, sf_dir))


_R6 = "round({0}, 6) AS {0}"


@query("voronoi_spans", f"{_W} SELECT rec, key, t0 AS start, t1 AS stop, cluster, stability FROM vor WHERE t1 > t0")
def _(spark, sf_dir):
    return T.voronoi(labelled(spark, sf_dir)).select("rec", "key", "start", F.col("end").alias("stop"), "cluster", "stability")


@query("merge_spans", f"{_W} SELECT rec, seg_idx, key, t0 AS start, t1 AS stop, cluster, {_R6.format('confidence')} FROM runs")
def _(spark, sf_dir):
    return T.stages(labelled(spark, sf_dir))["runs"].select("rec", "seg_idx", "key", "start", F.col("end").alias("stop"), "cluster", F.round("confidence", 6).alias("confidence"))


@query("transient_islands", f"{_W} SELECT rec, key, island, total AS island_ms FROM isl JOIN fate USING (rec, island)")
def _(spark, sf_dir):
    return T.stages(labelled(spark, sf_dir))["islands"].filter("island is not null").select("rec", "key", "island", "island_ms")


@query("bridge_islands", f"{_W} SELECT rec, key, fate, shown, {_R6.format('confidence')} FROM br")
def _(spark, sf_dir):
    return T.stages(labelled(spark, sf_dir))["bridged"].select("rec", "key", "fate", "shown", F.round("confidence", 6).alias("confidence"))


@query("inherit_short", f"{_W} SELECT rec, key, shown, {_R6.format('confidence')} FROM inh")
def _(spark, sf_dir):
    return T.stages(labelled(spark, sf_dir))["inherited"].select("rec", "key", "shown", F.round("confidence", 6).alias("confidence"))


@query("speaker_timeline", f"{_W} SELECT rec, seg_idx, t0 AS start, t1 AS stop, shown, {_R6.format('confidence')} FROM tl")
def _(spark, sf_dir):
    return T.stages(labelled(spark, sf_dir))["timeline"].select("rec", "seg_idx", "start", F.col("end").alias("stop"), "shown", F.round("confidence", 6).alias("confidence"))


@query("segment_vote", f"{_W} SELECT rec, seg_idx, cluster, {_R6.format('purity')}, mixed FROM vote")
def _(spark, sf_dir):
    return T.vote(T.stages(labelled(spark, sf_dir))["inherited"]).select("rec", "seg_idx", "cluster", F.round("purity", 6).alias("purity"), "mixed")


@query("timeline_metrics", f"""{_W}, rw AS (SELECT rec, seg_idx, count(DISTINCT cluster) AS n, max(w) / sum(w) AS p FROM (SELECT rec, seg_idx, cluster, sum(t1 - t0) AS w FROM vor WHERE t1 > t0 GROUP BY ALL) GROUP BY rec, seg_idx)
SELECT rec, (SELECT count(*) FROM rw WHERE rw.rec = b.rec AND (n > 1 OR p < 0.8)) AS raw_mixed, count(*) FILTER (WHERE stability = 'transient') AS raw_transient, count(*) FILTER (WHERE fate = 'noise') AS noise, count(*) FILTER (WHERE fate = 'bridged') AS bridged, count(*) FILTER (WHERE fate = 'suppressed') AS suppressed,
 (SELECT count(*) FROM vote WHERE vote.rec = b.rec AND mixed) AS shown_mixed FROM br b GROUP BY rec""")
def _(spark, sf_dir):
    return T.counters(labelled(spark, sf_dir))


@query("segment_labels", f"{_W} SELECT rec, seg_idx, CASE WHEN mixed THEN 'mixed' WHEN cluster >= 0 THEN 'cluster_' || cluster ELSE 'unknown' END AS speaker, CASE WHEN mixed THEN 'mixed' WHEN cluster >= 0 THEN 'cluster' ELSE 'unknown' END AS kind, CASE WHEN cluster >= 0 THEN 'cluster_' || cluster END AS dominant FROM vote")
def _(spark, sf_dir):
    from parley.operators.publication import segment_labels

    return segment_labels(T.vote(T.stages(labelled(spark, sf_dir))["inherited"])).select("rec", "seg_idx", "speaker", "kind", "dominant")


@query("quality_native", f"""{_W}, q AS (SELECT rec, sum(t1 - t0) FILTER (WHERE shown >= 0) / sum(t1 - t0) AS cov, sum(t1 - t0) FILTER (WHERE shown < 0) / sum(t1 - t0) AS unk FROM inh GROUP BY rec),
m AS (SELECT rec, count(*) FILTER (WHERE mixed)::DOUBLE / count(*) AS mx FROM vote GROUP BY rec), k AS (SELECT rec, count(DISTINCT cluster) AS cand, count(DISTINCT cluster) FILTER (WHERE stability = 'stable') AS tr FROM w GROUP BY rec),
z AS (SELECT rec, coalesce(cov, 0) AS cov, coalesce(unk, 0) AS unk, mx, cand, tr FROM q JOIN m USING (rec) JOIN k USING (rec)),
c AS (SELECT *, array_to_string(list_filter([CASE WHEN tr = 0 AND cand > 0 THEN 'no_trusted_speakers' END, CASE WHEN cov < 0.2 AND cand > 0 THEN 'low_trusted_coverage' END, CASE WHEN unk > 0.55 THEN 'high_unknown_ratio' END, CASE WHEN mx > 0.4 THEN 'high_mixed_ratio' END], lambda x: x IS NOT NULL), ',') AS codes FROM z)
SELECT rec, round(cov, 6) AS coverage, round(unk, 6) AS unknown_ratio, round(mx, 6) AS mixed_ratio, codes, CASE WHEN tr = 0 THEN 'unusable' WHEN cov < 0.55 OR unk > 0.35 THEN 'degraded' ELSE 'reliable' END AS state FROM c""")
def _(spark, sf_dir):
    from parley.operators.publication import timeline_quality

    w = labelled(spark, sf_dir)
    counts = w.groupBy("rec").agg(F.countDistinct("label").alias("candidates"), F.countDistinct(F.when(F.col("stability") == "stable", F.col("label"))).alias("trusted"), F.lit(False).alias("exceeded"))
    s = T.stages(w)["inherited"]
    out = timeline_quality(s, T.vote(s), counts)
    return out.select("rec", F.round("coverage", 6).alias("coverage"), F.round("unknown_ratio", 6).alias("unknown_ratio"), F.round("mixed_ratio", 6).alias("mixed_ratio"), F.array_join("codes", ",").alias("codes"), "state")
