"""Queries of the timeline metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import metrics
from parley.operators.intervals import active, elementary, union_length
from parley.plans.registry import query
from parley.plans.views import TURNS, turns

def _grid(ignore: bool = False) -> str:
    """Elementary intervals and both sides' active labels; if asked, without the time of several reference speakers."""
    single = "AND (SELECT count(*) FROM ra0 WHERE ra0.rec = g.rec AND ra0.a = g.a) < 2" if ignore else ""
    return f"""WITH RECURSIVE {TURNS},
pts AS (SELECT DISTINCT rec, t FROM (SELECT rec, start AS t FROM ref UNION ALL SELECT rec, "end" FROM ref UNION ALL SELECT rec, start FROM hyp UNION ALL SELECT rec, "end" FROM hyp)),
every AS (SELECT rec, t AS a, lead(t) OVER (PARTITION BY rec ORDER BY t) AS b FROM pts QUALIFY lead(t) OVER (PARTITION BY rec ORDER BY t) IS NOT NULL),
ra0 AS (SELECT DISTINCT g.rec, a, b, speaker FROM every g JOIN ref r ON g.rec = r.rec AND r.start <= (a + b) / 2.0 AND r."end" > (a + b) / 2.0),
grid AS (SELECT * FROM every g WHERE true {single}),
ra AS (SELECT ra0.* FROM ra0 SEMI JOIN grid USING (rec, a)),
ha AS (SELECT DISTINCT g.rec, a, b, speaker FROM grid g JOIN hyp h ON g.rec = h.rec AND h.start <= (a + b) / 2.0 AND h."end" > (a + b) / 2.0),
ov AS (SELECT ra.rec, ha.speaker AS hyp, ra.speaker AS ref, cast(sum(ra.b - ra.a) AS BIGINT) AS seconds FROM ra JOIN ha USING (rec, a) GROUP BY ALL)"""


def _map(ignore: bool = False) -> str:
    """The best of all assignments; of several, that whose labels come first, an unmapped one last."""
    return f"""{_grid(ignore)},
hl AS (SELECT rec, hyp, row_number() OVER (PARTITION BY rec ORDER BY hyp) AS k FROM (SELECT DISTINCT rec, hyp FROM ov)),
walk AS (SELECT rec, 0 AS k, ''::VARCHAR AS used, []::VARCHAR[] AS names, []::STRUCT(h VARCHAR, r VARCHAR, s BIGINT)[] AS pairs, 0::BIGINT AS total FROM (SELECT DISTINCT rec FROM ov)
 UNION ALL SELECT w.rec, w.k + 1, w.used || coalesce('<' || o.ref || '>', ''), list_append(w.names, coalesce(o.ref, '~')), CASE WHEN o.ref IS NULL THEN w.pairs ELSE list_append(w.pairs, {{'h': o.hyp, 'r': o.ref, 's': o.seconds}}) END, w.total + coalesce(o.seconds, 0)
 FROM walk w JOIN hl ON hl.rec = w.rec AND hl.k = w.k + 1 JOIN (SELECT rec, hyp, ref, seconds FROM ov UNION ALL SELECT DISTINCT rec, hyp, NULL, NULL FROM ov) o ON o.rec = w.rec AND o.hyp = hl.hyp AND (o.ref IS NULL OR NOT contains(w.used, '<' || o.ref || '>'))),
done AS (SELECT w.* FROM walk w JOIN (SELECT rec, max(k) AS k FROM hl GROUP BY rec) USING (rec, k)),
best AS (SELECT rec, pairs FROM done QUALIFY row_number() OVER (PARTITION BY rec ORDER BY total DESC, names) = 1),
mapping AS (SELECT rec, p.h AS hyp, p.r AS ref, p.s AS seconds FROM (SELECT rec, unnest(pairs) AS p FROM best))"""


def _errors(ignore: bool = False) -> str:
    return f"""{_map(ignore)},
per AS (SELECT g.rec, g.b - g.a AS d, (SELECT count(*) FROM ra WHERE ra.rec = g.rec AND ra.a = g.a) AS r, (SELECT count(*) FROM ha WHERE ha.rec = g.rec AND ha.a = g.a) AS h,
 (SELECT count(*) FROM ha JOIN mapping m ON m.rec = ha.rec AND m.hyp = ha.speaker JOIN ra ON ra.rec = ha.rec AND ra.a = ha.a AND ra.speaker = m.ref WHERE ha.rec = g.rec AND ha.a = g.a) AS ok FROM grid g),
s AS (SELECT rec, cast(coalesce(sum(d), 0) AS BIGINT) AS scored_seconds, cast(coalesce(sum(d * r), 0) AS BIGINT) AS ref_seconds, cast(coalesce(sum(d * greatest(r - h, 0)), 0) AS BIGINT) AS missed, cast(coalesce(sum(d * greatest(h - r, 0)), 0) AS BIGINT) AS false_alarm, cast(coalesce(sum(d * (least(r, h) - ok)), 0) AS BIGINT) AS confused
 FROM (SELECT DISTINCT rec FROM pts) LEFT JOIN per USING (rec) GROUP BY rec),
der AS (SELECT *, floor((missed + false_alarm + confused)::DOUBLE / CASE WHEN ref_seconds > 0 THEN ref_seconds ELSE 1 END * 1e6 + 0.5) / 1e6 AS der FROM s),
own AS (SELECT rec, speaker, sum(b - a) AS own FROM ra GROUP BY ALL), oth AS (SELECT rec, speaker, sum(b - a) AS oth FROM ha GROUP BY ALL),
jer AS (SELECT t.rec, count(*) AS n_speakers, floor(avg(coalesce(1 - m.seconds::DOUBLE / (own.own + oth.oth - m.seconds)::DOUBLE, 1.0::DOUBLE)) * 1e6 + 0.5) / 1e6 AS jer
 FROM (SELECT DISTINCT rec, speaker FROM ref) t LEFT JOIN own USING (rec, speaker) LEFT JOIN mapping m ON m.rec = t.rec AND m.ref = t.speaker LEFT JOIN oth ON oth.rec = t.rec AND oth.speaker = m.hyp GROUP BY t.rec),
hs AS (SELECT h.rec, count(*) AS n, string_agg(h.speaker || '>' || coalesce(m.ref, ''), ',' ORDER BY h.speaker) AS mapping FROM (SELECT DISTINCT rec, speaker FROM hyp) h LEFT JOIN mapping m ON m.rec = h.rec AND m.hyp = h.speaker GROUP BY h.rec)"""


@query("normalize_turns", f"WITH {TURNS} SELECT rec, start, \"end\" AS stop, speaker FROM ref")
def _(spark, sf_dir):
    return metrics.normalize_turns(turns(spark, sf_dir)[0]).withColumnRenamed("end", "stop")


@query("timeline_intervals", f"{_grid()} SELECT rec, a AS start, b AS stop, b - a AS duration FROM grid")
def _(spark, sf_dir):
    ref, hyp = turns(spark, sf_dir)
    grid = elementary(ref.select("rec", "start", "end").union(hyp.select("rec", "start", "end")), ["rec"]).filter("end is not null")
    return grid.select("rec", "start", F.col("end").alias("stop"), (F.col("end") - F.col("start")).alias("duration"))


@query("timeline_active", f"{_grid()} SELECT rec, a AS start, speaker FROM ra")
def _(spark, sf_dir):
    ref, hyp = turns(spark, sf_dir)
    grid = elementary(ref.select("rec", "start", "end").union(hyp.select("rec", "start", "end")), ["rec"])
    return active(ref, grid, ["rec"], "speaker").join(grid, ["rec", "rank"]).select("rec", "start", "speaker")


@query("overlap_matrix", f"{_grid()} SELECT * FROM ov")
def _(spark, sf_dir):
    return metrics.overlap_matrix(*turns(spark, sf_dir))


@query("overlap_matrix_single", f"{_grid(True)} SELECT * FROM ov")
def _(spark, sf_dir):
    return metrics.overlap_matrix(*turns(spark, sf_dir), ignore_overlap=True)


@query("speaker_mapping", f"{_map()} SELECT * FROM mapping")
def _(spark, sf_dir):
    return metrics.speaker_mapping(metrics.overlap_matrix(*turns(spark, sf_dir)))


@query("der", f"{_errors()} SELECT rec, ref_seconds, missed, false_alarm, confused, der FROM der")
def _(spark, sf_dir):
    return metrics.error_rates(*turns(spark, sf_dir))


@query("jer", f"{_errors()} SELECT der.rec, coalesce(n_speakers, 0) AS n_speakers, coalesce(jer, 0.0::DOUBLE) AS jer FROM der LEFT JOIN jer USING (rec)")
def _(spark, sf_dir):
    return metrics.jaccard_error(*turns(spark, sf_dir))


def _record(ignore: bool) -> str:
    return f"""{_errors(ignore)} SELECT der.rec, coalesce(n_speakers, 0) AS ref_speakers, coalesce(hs.n, 0) AS hyp_speakers, coalesce(hs.n, 0) - coalesce(n_speakers, 0) AS count_error, coalesce(hs.mapping, '') AS mapping,
 scored_seconds, ref_seconds, missed, false_alarm, confused, der, coalesce(jer, 0.0::DOUBLE) AS jer, {str(ignore).lower()} AS ignore_overlap FROM der LEFT JOIN jer USING (rec) LEFT JOIN hs USING (rec)"""


def _recorded(spark, sf_dir, ignore: bool):
    out = metrics.evaluation(*turns(spark, sf_dir), ignore_overlap=ignore)
    pairs = F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit(">"), F.coalesce(e["value"], F.lit(""))))
    return out.withColumn("mapping", F.array_join(pairs, ","))


@query("evaluation", _record(False))
def _(spark, sf_dir):
    return _recorded(spark, sf_dir, False)


@query("evaluation_single", _record(True))
def _(spark, sf_dir):
    return _recorded(spark, sf_dir, True)


@query("speakers", f"WITH {TURNS} SELECT rec, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM ref GROUP BY rec")
def _(spark, sf_dir):
    return turns(spark, sf_dir)[0].groupBy("rec").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"))


@query("speech_seconds", f"""WITH {TURNS}, o AS (SELECT rec, speaker, start, "end", max("end") OVER (PARTITION BY rec, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ref)
SELECT rec, speaker, cast(sum(greatest("end" - greatest(start, coalesce(seen, start)), 0)) AS BIGINT) AS seconds FROM o GROUP BY ALL""")
def _(spark, sf_dir):
    return union_length(turns(spark, sf_dir)[0], ["rec", "speaker"], name="seconds")
