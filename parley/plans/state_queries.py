"""Queries of publication, profiles, tasks and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.scalars import hash_of
from parley.functions.vectors import as_text
from parley.operators import manifests as M
from parley.operators import matching
from parley.operators import profiles as P
from parley.operators import publication as Q
from parley.operators import tasks as T
from parley.plans.registry import query
from parley.plans.views import SEGMENTS, UNIT, segments, table

_S = f"WITH {SEGMENTS}"
_TEXT = "array_to_string(list_transform({v}, lambda x: printf('%.4f', round(x, 4) + 0.0)), ' ')"


# Clusters of four voices a recording, with ids and flags of several kinds, from customers.
_CL = """cl AS (SELECT c_custkey // 4 AS rec, c_custkey % 4 AS idx, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN (c_custkey % 4)::VARCHAR WHEN 2 THEN 'voice' ELSE 'cluster_' || (c_custkey % 4) END AS cluster_id,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE c_acctbal > 0 END AS trusted, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal > 1000 END AS strong, CASE WHEN c_custkey % 2 = 0 THEN 'stable' ELSE 'transient' END AS stability,
 c_custkey % 9 AS evidence, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 11)::DOUBLE END AS voiced FROM customer),
n0 AS (SELECT rec, idx, cluster_id, coalesce(trusted, stability = 'stable' AND (evidence >= 3 OR coalesce(voiced >= 3, false))) AS trusted, strong, evidence, voiced FROM cl),
n1 AS (SELECT *, coalesce(strong, trusted AND (evidence >= 6 OR coalesce(voiced >= 6, false))) AS s2, coalesce(cluster_id, CASE WHEN trusted THEN idx::VARCHAR END) AS raw FROM n0),
norm AS (SELECT rec, idx, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN 'cluster_' || raw ELSE raw END AS cluster_id, trusted, s2 AS strong, evidence FROM n1 WHERE raw IS NOT NULL OR NOT trusted),
st AS (SELECT rec, CASE rec % 3 WHEN 0 THEN 'reliable' WHEN 1 THEN 'degraded' ELSE 'unusable' END AS state FROM (SELECT DISTINCT rec FROM cl)),
ok AS (SELECT norm.*, state FROM norm JOIN st USING (rec) WHERE trusted AND cluster_id IS NOT NULL AND state <> 'unusable' AND (state <> 'degraded' OR strong))"""


def clusters(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 4).alias("rec"), (k % 4).alias("idx"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, (k % 4).cast("string")).when(k % 5 == 2, F.lit("voice")).otherwise(F.concat(F.lit("cluster_"), (k % 4).cast("string"))).alias("cluster_id"),
        F.when(k % 3 == 0, F.lit(None).cast("boolean")).when(k % 3 == 1, F.lit(True)).otherwise(F.col("c_acctbal") > 0).alias("trusted"), F.when(k % 7 == 0, F.col("c_acctbal") > 1000).alias("strong"), F.when(k % 2 == 0, F.lit("stable")).otherwise(F.lit("transient")).alias("stability"),
        (k % 9).alias("evidence"), F.when(k % 6 != 0, (k % 11).cast("double")).alias("voiced"))


def states(spark, sf_dir):
    rec = clusters(spark, sf_dir).select("rec").distinct()
    return rec.withColumn("state", F.when(F.col("rec") % 3 == 0, F.lit("reliable")).when(F.col("rec") % 3 == 1, F.lit("degraded")).otherwise(F.lit("unusable")))


def allowed(spark, sf_dir):
    return Q.allowed_clusters(Q.normalized_clusters(clusters(spark, sf_dir), lenient=True), states(spark, sf_dir))


@query("normalize_clusters", f"WITH {_CL} SELECT rec, idx, cluster_id, trusted, strong FROM norm")
def _(spark, sf_dir):
    return Q.normalized_clusters(clusters(spark, sf_dir), lenient=True).select("rec", "idx", "cluster_id", "trusted", "strong")


@query("public_clusters", f"WITH {_CL} SELECT rec, idx, cluster_id, state FROM ok")
def _(spark, sf_dir):
    return allowed(spark, sf_dir).select("rec", "idx", "cluster_id", "state")


# Segments that name clusters of the same recordings, from orders.
_SG = """sg AS (SELECT o_custkey // 4 AS rec, o_orderkey AS seg_idx, CASE o_orderkey % 5 WHEN 0 THEN 'mixed' WHEN 1 THEN 'unknown' ELSE 'cluster_' || (o_orderkey % 4) END AS speaker, CASE WHEN o_orderkey % 2 = 0 THEN 'cluster_' || (o_custkey % 4) END AS cluster,
 CASE WHEN o_orderkey % 3 = 0 THEN 'cluster_' || (o_orderkey % 3) END AS dominant, CASE WHEN o_orderkey % 10 = 7 THEN true WHEN o_orderkey % 10 = 8 THEN NULL ELSE false END AS mixed, 'cluster_' || (o_custkey % 4) AS s1, 'cluster_' || (o_orderkey % 4) AS s2 FROM orders),
oks AS (SELECT rec, list(cluster_id) AS ok FROM ok GROUP BY rec),
pr AS (SELECT sg.*, coalesce(ok, []::VARCHAR[]) AS ok, coalesce(mixed, false) OR speaker = 'mixed' AS mx FROM sg LEFT JOIN oks USING (rec)),
pj AS (SELECT rec, seg_idx, mx, CASE WHEN list_contains(ok, speaker) THEN speaker WHEN list_contains(ok, cluster) THEN cluster END AS one, CASE WHEN list_contains(ok, dominant) THEN dominant END AS kept, CASE WHEN list_contains(ok, s1) THEN s1 WHEN list_contains(ok, s2) THEN s2 END AS fst,
 CASE WHEN list_contains(ok, s1) THEN s1 ELSE 'unknown' END || ',' || CASE WHEN list_contains(ok, s2) THEN s2 ELSE 'unknown' END AS spans FROM pr),
proj AS (SELECT rec, seg_idx, CASE WHEN mx THEN 'mixed' ELSE coalesce(one, 'unknown') END AS speaker, CASE WHEN mx THEN coalesce(kept, fst) WHEN one IS NOT NULL THEN coalesce(kept, one) END AS dominant, CASE WHEN NOT mx THEN one END AS cluster, mx AS mixed, spans FROM pj)"""


def diarized(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda x: F.concat(F.lit("cluster_"), x.cast("string"))
    span = lambda x: F.struct(name(x).alias("speaker"), F.lit(0.5).alias("confidence"))
    return table(spark, sf_dir, "orders").select(
        F.floor(c / 4).alias("rec"), k.alias("seg_idx"), F.when(k % 5 == 0, F.lit("mixed")).when(k % 5 == 1, F.lit("unknown")).otherwise(name(k % 4)).alias("speaker"), F.when(k % 2 == 0, name(c % 4)).alias("cluster"),
        F.when(k % 3 == 0, name(k % 3)).alias("dominant"), F.when(k % 10 == 7, F.lit(True)).when(k % 10 == 8, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("mixed"), F.array(span(c % 4), span(k % 4)).alias("spans"))


@query("project_segments", f"WITH {_CL}, {_SG} SELECT * FROM proj")
def _(spark, sf_dir):
    out = Q.projected_segments(diarized(spark, sf_dir), allowed(spark, sf_dir))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: s["speaker"]), ","))


_QD = """q0 AS (SELECT rec, count(*) AS n, count(*) FILTER (WHERE coalesce(mixed, false) OR speaker = 'mixed') AS m, count(*) FILTER (WHERE speaker = 'unknown') AS u FROM sg GROUP BY rec),
q2 AS (SELECT rec, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(t, 0) AS t, CASE WHEN n > 0 THEN u::DOUBLE / n ELSE 0.0::DOUBLE END AS un, CASE WHEN n > 0 THEN m::DOUBLE / n ELSE 0.0::DOUBLE END AS mi FROM (SELECT rec FROM sg UNION SELECT rec FROM norm) LEFT JOIN q0 USING (rec) LEFT JOIN (SELECT rec, count(*) AS c, count(*) FILTER (WHERE trusted) AS t FROM norm GROUP BY rec) USING (rec)),
qd AS (SELECT rec, t AS trusted, round(1 - un, 6) AS coverage, round(un, 6) AS unknown_ratio, round(mi, 6) AS mixed_ratio,
 array_to_string(list_filter([CASE WHEN t = 0 AND c > 0 THEN 'no_trusted_speakers' END, CASE WHEN un > 0.55 THEN 'high_unknown_ratio' END, CASE WHEN mi > 0.4 THEN 'high_mixed_ratio' END, CASE WHEN rec % 5 = 0 AND c > 0 THEN 'speaker_count_exceeded' END], lambda x: x IS NOT NULL), ',') AS codes,
 CASE WHEN t = 0 AND c > 0 THEN 'unusable' WHEN un > 0.35 THEN 'degraded' ELSE 'reliable' END AS state FROM q2)"""


def _derived(spark, sf_dir):
    known = Q.normalized_clusters(clusters(spark, sf_dir), lenient=True)
    return Q.derived_quality(diarized(spark, sf_dir), known, known.select("rec").distinct().withColumn("exceeded", F.col("rec") % 5 == 0))


@query("quality_derived", f"WITH {_CL}, {_SG}, {_QD} SELECT * FROM qd")
def _(spark, sf_dir):
    return _derived(spark, sf_dir).withColumn("codes", F.array_join("codes", ","))


@query("quality_normalized", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'degraded' ELSE 'reliable' END AS state, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 ELSE 7 END AS trusted_count, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS coverage FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("degraded")).otherwise(F.col("c_mktsegment")).alias("state"), F.when(k % 2 == 0, k % 5).alias("trusted_count"), F.lit(7).cast("long").alias("trusted"),
        F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("coverage"), F.lit(None).cast("double").alias("unknown_ratio"), F.lit(0.5).alias("mixed_ratio"))
    return Q.normalized_quality(rows).select("c_custkey", "state", "trusted_count", "coverage")


_QR = "qr AS (SELECT qd.rec, state = 'reliable' AND coalesce(s, 0) > 0 AND coalesce(p, 0) = 0 AS wrong, qd.state, qd.codes, qd.coverage FROM qd LEFT JOIN (SELECT rec, count(*) AS s FROM norm GROUP BY rec) USING (rec) LEFT JOIN (SELECT rec, count(*) AS p FROM ok GROUP BY rec) USING (rec))"
_QRS = "SELECT rec, CASE WHEN wrong THEN 'unusable' ELSE state END AS state, CASE WHEN wrong THEN CASE WHEN codes = '' THEN '' ELSE codes || ',' END || 'no_trusted_speakers,inconsistent_quality_summary' ELSE codes END AS codes, CASE WHEN wrong THEN 0 ELSE coverage END AS coverage FROM qr"


def _reconciled(spark, sf_dir):
    count = lambda df, name: df.groupBy("rec").agg(F.count("*").alias(name))
    n = Q.normalized_clusters(clusters(spark, sf_dir), lenient=True)
    rows = _derived(spark, sf_dir).join(count(n, "sources"), "rec", "left").join(count(allowed(spark, sf_dir), "shown"), "rec", "left").fillna(0, ["sources", "shown"])
    return Q.reconciled_quality(rows)


@query("quality_reconciled", f"WITH {_CL}, {_SG}, {_QD}, {_QR} {_QRS}")
def _(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("rec", "state", F.array_join("codes", ",").alias("codes"), "coverage")


_FIN = f"""{_CL}, {_SG}, {_QD}, sh AS (SELECT rec, count(*) AS p FROM norm JOIN qd USING (rec) WHERE norm.trusted AND cluster_id IS NOT NULL AND qd.state <> 'unusable' AND (qd.state <> 'degraded' OR strong) GROUP BY rec),
fs AS (SELECT qd.rec, CASE WHEN state = 'reliable' AND coalesce(s, 0) > 0 AND coalesce(p, 0) = 0 THEN 'unusable' ELSE state END AS state, coverage FROM qd LEFT JOIN (SELECT rec, count(*) AS s FROM norm GROUP BY rec) USING (rec) LEFT JOIN sh USING (rec)),
fo AS (SELECT norm.rec, idx, cluster_id FROM norm JOIN fs USING (rec) WHERE trusted AND cluster_id IS NOT NULL AND fs.state <> 'unusable' AND (fs.state <> 'degraded' OR strong)), fl AS (SELECT rec, list(cluster_id) AS ok FROM fo GROUP BY rec)"""


def _finalized(spark, sf_dir):
    k = clusters(spark, sf_dir)
    exceeded = Q.normalized_clusters(k, lenient=True).select("rec").distinct().withColumn("exceeded", F.col("rec") % 5 == 0)
    return Q.finalized(diarized(spark, sf_dir), k, exceeded)


@query("finalize_analysis", f"""WITH {_FIN}
SELECT sg.rec, seg_idx, CASE WHEN coalesce(mixed, false) OR speaker = 'mixed' THEN 'mixed' WHEN list_contains(coalesce(ok, []::VARCHAR[]), speaker) THEN speaker WHEN list_contains(coalesce(ok, []::VARCHAR[]), cluster) THEN cluster ELSE 'unknown' END AS speaker, state FROM sg LEFT JOIN fs USING (rec) LEFT JOIN fl USING (rec)""")
def _(spark, sf_dir):
    segments_, _shown, quality = _finalized(spark, sf_dir)
    return segments_.join(quality.select("rec", "state"), "rec", "left").select("rec", "seg_idx", "speaker", "state")


@query("finalized_clusters", f"WITH {_FIN} SELECT rec, idx, cluster_id FROM fo")
def _(spark, sf_dir):
    return _finalized(spark, sf_dir)[1].select("rec", "idx", "cluster_id")


@query("finalized_quality", f"WITH {_FIN} SELECT rec, state, CASE WHEN state = 'unusable' THEN 0 ELSE coverage END AS coverage FROM fs")
def _(spark, sf_dir):
    return _finalized(spark, sf_dir)[2].select("rec", "state", "coverage")


@query("apply_matches", f"WITH {_SG}, m AS (SELECT c_custkey // 4 AS rec, 'cluster_' || (c_custkey % 4) AS cluster, c_name AS name FROM customer WHERE c_custkey % 2 = 0) SELECT sg.rec, seg_idx, CASE WHEN NOT coalesce(mixed, false) AND name IS NOT NULL THEN name WHEN mixed THEN 'mixed' WHEN NOT coalesce(mixed, false) AND sg.cluster IS NOT NULL THEN sg.cluster ELSE 'unknown' END AS speaker, CASE WHEN NOT coalesce(mixed, false) AND name IS NOT NULL THEN 'known' WHEN mixed THEN 'mixed' WHEN NOT coalesce(mixed, false) AND sg.cluster IS NOT NULL THEN 'cluster' ELSE 'unknown' END AS kind FROM (SELECT rec, seg_idx, cluster, mixed FROM sg) sg LEFT JOIN m ON m.rec = sg.rec AND m.cluster = sg.cluster".replace(_SG, _SG.split(",\noks")[0]))
def _(spark, sf_dir):
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").filter(k % 2 == 0).select(F.floor(k / 4).alias("rec"), F.concat(F.lit("cluster_"), (k % 4).cast("string")).alias("cluster"), F.concat(F.lit("person_"), k).alias("person_id"), F.col("c_name").alias("name"), F.lit(0.9).alias("score"))
    return matching.apply_matches(diarized(spark, sf_dir).withColumnRenamed("cluster", "speaker_cluster"), found).select("rec", "seg_idx", "speaker", "kind")


# Learning events and rollbacks, in order of event_id.
_LE = """sm AS (SELECT event_id AS seq, 'learn_' || substr(sha256(event_id::VARCHAR), 1, 20) AS learning_id, 'person_' || (user_id % 10) AS person_id, 'Name ' || (event_id % 3) AS name, event_id % 500 AS vid FROM events WHERE event_type = 'purchase'),
er AS (SELECT event_id, 'person_' || (user_id % 10) AS person_id FROM events WHERE event_type = 'error' AND event_id % 5 = 0),
rb AS (SELECT learning_id, er.event_id AS seq FROM er ASOF JOIN sm ON er.person_id = sm.person_id AND er.event_id > sm.seq),
kp AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY seq DESC) <= 16),
lv AS (SELECT * FROM sm WHERE learning_id NOT IN (SELECT learning_id FROM rb)), lk AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY seq DESC) <= 16)"""


def _proto(src):
    return f"""pv AS (SELECT person_id, learning_id, {UNIT.format(v='list_transform(embedding, lambda q: q::DOUBLE)')} AS u FROM {src} JOIN embeddings ON vec_id = vid),
pc AS (SELECT person_id, i, sum(x ORDER BY learning_id) AS x FROM (SELECT person_id, learning_id, unnest(u) AS x, unnest(range(len(u))) AS i FROM pv) GROUP BY ALL), ps AS (SELECT person_id, list(x ORDER BY i) AS s FROM pc GROUP BY ALL),
pp AS (SELECT person_id, {_TEXT.format(v=UNIT.format(v='s'))} AS prototype FROM ps), pi AS (SELECT person_id, arg_max(name, seq) AS name, count(*) AS n_samples, max(seq) AS updated_seq FROM {src} GROUP BY person_id)"""


def samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    rows = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("learn_"), F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 20)).alias("learning_id"), F.concat(F.lit("person_"), F.col("user_id") % 10).alias("person_id"), F.concat(F.lit("Name "), F.col("event_id") % 3).alias("name"), (F.col("event_id") % 500).alias("vec_id"))
    return rows.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id").drop("vec_id")


def rollbacks(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", F.concat(F.lit("person_"), F.col("user_id") % 10).alias("person_id"))
    learned = F.when(F.col("event_type") == "purchase", F.concat(F.lit("learn_"), F.substring(F.sha2(F.col("seq").cast("string").cast("binary"), 256), 1, 20)))
    latest = F.last(learned, ignorenulls=True).over(Window.partitionBy("person_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("learning_id", latest).filter("event_type = 'error' and seq % 5 = 0 and learning_id is not null").select("learning_id", "seq")


@query("profile_samples", f"WITH {_LE} SELECT person_id, learning_id, seq FROM kp")
def _(spark, sf_dir):
    return P.kept_samples(samples(spark, sf_dir)).select("person_id", "learning_id", "seq")


@query("profile_prototype", f"WITH {_LE}, {_proto('kp')} SELECT person_id, prototype FROM pp")
def _(spark, sf_dir):
    return P.profiles(samples(spark, sf_dir)).select("person_id", as_text(F.col("prototype")).alias("prototype"))


@query("profiles_after_rollback", f"WITH {_LE}, {_proto('lk')} SELECT person_id, n_samples, prototype FROM pi JOIN pp USING (person_id)")
def _(spark, sf_dir):
    left = P.rolled_back(samples(spark, sf_dir), rollbacks(spark, sf_dir))
    return P.profiles(left).select("person_id", "n_samples", as_text(F.col("prototype")).alias("prototype"))


@query("rollback_log", f"WITH {_LE} SELECT learning_id, min(seq) AS rolled_back_seq FROM rb GROUP BY learning_id")
def _(spark, sf_dir):
    return P.rollback_log(rollbacks(spark, sf_dir))


@query("list_speakers", f"WITH {_LE}, {_proto('kp')} SELECT person_id, name, n_samples, 0 AS n_candidates, updated_seq FROM pi")
def _(spark, sf_dir):
    return P.public_profiles(samples(spark, sf_dir))


@query("correct_speaker", f"""{_S}, d AS (SELECT *, seg_idx % 7 = 3 AS mixed, CASE WHEN seg_idx % 2 = 0 THEN 'cluster_' || (seg_idx % 3) END AS cluster, CASE WHEN seg_idx % 2 = 1 THEN 'cluster_' || (seg_idx % 3) ELSE speaker END AS sp FROM seg),
c AS (SELECT *, coalesce(cluster, CASE WHEN starts_with(sp, 'cluster_') THEN sp END) AS k FROM d), hit AS (SELECT DISTINCT rec, k FROM c WHERE seg_idx IN (1, 3) AND rec % 2 = 0 AND NOT mixed AND k IS NOT NULL)
SELECT c.rec, seg_idx, CASE WHEN h THEN 'Ada' ELSE sp END AS speaker, h AS corrected FROM (SELECT c.*, NOT mixed AND ((seg_idx IN (1, 3) AND rec % 2 = 0) OR EXISTS (SELECT 1 FROM hit WHERE hit.rec = c.rec AND hit.k = c.k)) AS h FROM c) c""")
def _(spark, sf_dir):
    name = F.concat(F.lit("cluster_"), (F.col("seg_idx") % 3).cast("string"))
    s = segments(spark, sf_dir).withColumns({"mixed": F.col("seg_idx") % 7 == 3, "cluster": F.when(F.col("seg_idx") % 2 == 0, name), "speaker": F.when(F.col("seg_idx") % 2 == 1, name).otherwise(F.col("speaker"))})
    ask = segments(spark, sf_dir).filter("seg_idx in (1, 3) and rec % 2 = 0").select("rec", "seg_idx", F.lit("person_ada").alias("person_id"), F.lit("Ada").alias("name"))
    return P.corrected(s, ask).select("rec", "seg_idx", "speaker", "corrected")


# Three clusters a recording, one of them not always trusted, one transient in some.
_EV = f"""{_S}, cs AS (SELECT rec, k AS cluster, k <> 1 OR rec % 2 = 0 AS trusted, CASE WHEN k = 2 AND rec % 3 = 0 THEN 'transient' ELSE 'stable' END AS stability, k AS w FROM (SELECT DISTINCT rec FROM seg), unnest(range(0, 3)) t(k)),
ev AS (SELECT rec, seg_idx, seg_idx % 3 AS cluster, end_ms - start_ms AS d FROM seg WHERE seg_idx % 7 <> 3 AND speaker <> 'system' AND (seg_idx % 4 <> 2 OR seg_idx % 8 = 2)),
el AS (SELECT ev.* FROM ev SEMI JOIN (SELECT * FROM cs WHERE trusted AND stability <> 'transient') c USING (rec, cluster)),
lg AS (SELECT r.rec, coalesce((SELECT sum(d) FROM el WHERE el.rec = r.rec), 0)::DOUBLE / 1000 AS seconds, cast(coalesce((SELECT sum(w) FROM cs SEMI JOIN el USING (rec, cluster) WHERE cs.rec = r.rec), 0) AS BIGINT) AS windows, EXISTS (SELECT 1 FROM el WHERE el.rec = r.rec) AS eligible FROM (SELECT DISTINCT rec FROM seg) r)"""


def _evidence(spark, sf_dir):
    k = F.col("seg_idx")
    purity = F.when(k % 8 == 2, F.lit(0.9)).when(k % 4 == 2, F.lit(0.5))
    s = segments(spark, sf_dir).withColumns({"mixed": k % 7 == 3, "speaker": F.when(F.col("speaker") == "system", F.lit("unknown")).otherwise(F.col("speaker")), "cluster": k % 3, "purity": purity})
    c = s.select("rec").distinct().select("rec", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("cluster"))
    c = c.withColumns({"trusted": (F.col("cluster") != 1) | (F.col("rec") % 2 == 0), "stability": F.when((F.col("cluster") == 2) & (F.col("rec") % 3 == 0), F.lit("transient")).otherwise(F.lit("stable")), "n_windows": F.col("cluster")})
    return P.learning_evidence(s, c)


@query("learning_gate", f"{_EV} SELECT rec, seconds, windows, eligible AND (seconds >= 1.5 OR windows >= 2) AS enough FROM lg")
def _(spark, sf_dir):
    return _evidence(spark, sf_dir).select("rec", "seconds", "windows", "enough")


@query("learning_eligible", f"{_EV} SELECT rec, eligible FROM lg")
def _(spark, sf_dir):
    return _evidence(spark, sf_dir).select("rec", "eligible")


@query("learning_embedding", f"""WITH v AS (SELECT vec_id // 10 AS rec, vec_id % 10 AS cluster, list_transform(embedding, lambda q: q::DOUBLE) AS v, 1 + vec_id % 4 AS n FROM embeddings WHERE (vec_id % 10) % 3 <> 1 AND vec_id % 10 NOT IN (2, 6)), u AS (SELECT rec, cluster, n, {UNIT.format(v='v')} AS u FROM v),
c AS (SELECT rec, i, sum(x * n ORDER BY cluster) AS x FROM (SELECT rec, cluster, n, unnest(u) AS x, unnest(range(len(u))) AS i FROM u) GROUP BY ALL), s AS (SELECT rec, list(x ORDER BY i) AS s FROM c GROUP BY ALL) SELECT rec, {_TEXT.format(v=UNIT.format(v='s'))} AS vector FROM s""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("rec"), (F.col("vec_id") % 10).alias("cluster"), F.col("embedding").cast("array<double>").alias("v"), (1 + F.col("vec_id") % 4).alias("n_windows"))
    named = e.select("rec", "cluster", F.when(F.col("cluster") % 3 == 0, F.lit(None).cast("double")).when(F.col("cluster") % 3 == 1, 0.5).otherwise(0.9).alias("purity"))
    named = named.withColumns({"speaker": F.lit("x"), "mixed": F.lit(False)})
    e = e.withColumns({"trusted": F.col("cluster") != 2, "stability": F.when(F.col("cluster") == 6, F.lit("transient")).otherwise(F.lit("stable"))})
    return P.learning_vectors(named, e).select("rec", as_text(F.col("prototype")).alias("vector"))


# Task states from events.
_TE = """te AS (SELECT 'task_' || substr(sha256(user_id::VARCHAR), 1, 20) AS task_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, event_id AS seq, user_id FROM events),
ls AS (SELECT task_id, arg_max(status, seq) AS status, max(seq) AS seq FROM te GROUP BY task_id)"""


def task_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", F.lit("queued")).when(F.col("event_type").isin("view", "click"), F.lit("running")).when(F.col("event_type") == "purchase", F.lit("completed")).otherwise(F.lit("failed"))
    return e.select(F.concat(F.lit("task_"), F.substring(F.sha2(F.col("user_id").cast("string").cast("binary"), 256), 1, 20)).alias("task_id"), status.alias("status"), F.col("event_id").alias("seq"), "user_id")


@query("task_latest_status", f"WITH {_TE} SELECT * FROM ls")
def _(spark, sf_dir):
    return T.latest_status(task_events(spark, sf_dir))


@query("recover_interrupted", f"WITH {_TE} SELECT task_id, CASE WHEN status IN ('queued', 'running') AND task_id NOT IN (SELECT task_id FROM te WHERE user_id % 4 = 0) THEN 'interrupted' ELSE status END AS status FROM ls")
def _(spark, sf_dir):
    e = task_events(spark, sf_dir)
    return T.recovered(T.latest_status(e), e.filter("user_id % 4 = 0").select("task_id")).select("task_id", "status")


@query("dedupe_starts", "SELECT user_id || ':' || event_type AS request_key, min(event_id) AS seq FROM events GROUP BY ALL")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("request_key"), F.col("event_id").alias("seq"))
    return T.first_starts(e)


@query("lease_active", "SELECT event_id FROM events WHERE event_type = 'view' OR 1706659200 - cast(floor(epoch(ts)) AS BIGINT) <= 86400")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") > 0, F.col("event_type") == "view").otherwise(F.col("event_type") == "view").alias("alive"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("beat"))
    return T.live_leases(e, F.lit(1706659200), 86400).select("event_id")


@query("sessions", """WITH e AS (SELECT user_id, event_id, cast(floor(epoch(ts)) AS BIGINT) AS t FROM events), o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 3600 THEN 0 ELSE 1 END AS n FROM e), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM o)
SELECT user_id, cast(k AS BIGINT) AS session, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return T.sessions(e, 3600)


_CP = "cp AS (SELECT o_orderkey AS task_id, cast(floor(o_totalprice) AS BIGINT) % 2000 AS d, CASE o_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 200 ELSE 900 END AS wish, o_orderkey % 13 AS free FROM orders), sz AS (SELECT *, CASE WHEN wish >= 60 THEN least(300, wish) WHEN free < 6 THEN 90 WHEN free < 10 THEN 120 ELSE 300 END AS c FROM cp), pl AS (SELECT task_id, i AS chunk, c AS chunk_s, i * c AS offset_s FROM sz, unnest(range(0, greatest(1, cast(ceil(d / c::DOUBLE) AS BIGINT)))) t(i))"


def planned(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("task_id"), (F.floor("o_totalprice") % 2000).alias("duration_s"), F.when(k % 3 == 0, 30).when(k % 3 == 1, 200).otherwise(900).alias("wish_s"), (k % 13).alias("free_gb"))
    return T.chunk_plan(t)


@query("chunk_plan", f"WITH {_CP} SELECT * FROM pl")
def _(spark, sf_dir):
    return planned(spark, sf_dir)


@query("remaining_chunks", f"WITH {_CP} SELECT * FROM pl WHERE (task_id + chunk) % 3 = 0")
def _(spark, sf_dir):
    p = planned(spark, sf_dir)
    return T.remaining(p, p.filter((F.col("task_id") + F.col("chunk")) % 3 != 0), ["task_id", "chunk"])


@query("chunk_progress", f"WITH {_CP}, t AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM pl) SELECT task_id, chunk, row_number() OVER (PARTITION BY task_id ORDER BY chunk) AS done, 38 + cast(floor(row_number() OVER (PARTITION BY task_id ORDER BY chunk)::DOUBLE / n * 28) AS BIGINT) AS percent FROM t")
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    p = planned(spark, sf_dir).withColumn("total", F.count("*").over(Window.partitionBy("task_id")))
    return T.chunk_progress(p).select("task_id", "chunk", "done", "percent")


@query("chunk_halving", f"""WITH {_CP}, f AS (SELECT task_id, offset_s, chunk_s, (task_id + chunk) % 4 AS fails FROM pl),
a AS (SELECT task_id, offset_s + i * h AS offset_s, h AS size_s, least(h, chunk_s - i * h) AS length_s, fails, 1 AS depth FROM (SELECT *, greatest(60, chunk_s // 2) AS h FROM f WHERE fails > 0 AND greatest(60, chunk_s // 2) < chunk_s) x, unnest(range(0, cast(ceil(chunk_s / h::DOUBLE) AS BIGINT))) t(i)
 UNION ALL SELECT task_id, offset_s, chunk_s, chunk_s, fails, 0 FROM f WHERE NOT (fails > 0 AND greatest(60, chunk_s // 2) < chunk_s)),
b AS (SELECT task_id, offset_s + i * h AS offset_s, least(h, length_s - i * h) AS length_s, 2 AS depth FROM (SELECT *, greatest(60, size_s // 2) AS h FROM a WHERE fails > 1 AND depth = 1 AND greatest(60, size_s // 2) < length_s) x, unnest(range(0, cast(ceil(length_s / h::DOUBLE) AS BIGINT))) t(i)
 UNION ALL SELECT task_id, offset_s, length_s, depth FROM a WHERE NOT (fails > 1 AND depth = 1 AND greatest(60, size_s // 2) < length_s)) SELECT * FROM b""")
def _(spark, sf_dir):
    return T.halved(planned(spark, sf_dir).withColumn("fails", (F.col("task_id") + F.col("chunk")) % 4))


@query("best_checkpoint", "WITH c AS (SELECT o_orderkey AS task_id, o_custkey AS asr_key, o_orderkey % 7 AS n, o_orderdate AS u FROM orders), w AS (SELECT task_id + 1 AS wanted_by, asr_key FROM c WHERE task_id % 10 = 0 UNION SELECT task_id, asr_key FROM c WHERE task_id % 10 = 5) SELECT wanted_by, task_id, n AS n_chunks FROM w JOIN c USING (asr_key) QUALIFY row_number() OVER (PARTITION BY wanted_by ORDER BY c.task_id = wanted_by DESC, n DESC, u DESC, c.task_id) = 1")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("asr_key"), (F.col("o_orderkey") % 7).alias("n_chunks"), F.col("o_orderdate").alias("updated"))
    w = c.filter("task_id % 10 = 0").select((F.col("task_id") + 1).alias("task_id"), "asr_key").union(c.filter("task_id % 10 = 5").select("task_id", "asr_key"))
    return T.best_checkpoint(c, w).select("wanted_by", "task_id", "n_chunks")


@query("cache_key", """SELECT p_partkey, sha256('{"name":"' || p_name || '","size":' || p_size || ',"brand":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || '"' ELSE 'null' END || '}') AS cache_key FROM part""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", hash_of(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))).alias("cache_key"))


_SK = """sk AS (SELECT p_partkey AS task_id, CASE WHEN p_size % 3 <> 0 THEN sha256('{"stage":"asr","source":"' || p_name || '","asr_model":"m' || p_size || '","chunk_s":300}') END AS a, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS sm FROM part)"""


def identities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("source"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("m"), F.col("p_size").cast("string"))).alias("asr_model"), F.lit(300).alias("chunk_s"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("speaker_model"), F.lit(1500).alias("window_ms"))


@query("stage_keys", f"""WITH {_SK} SELECT task_id, a AS asr_key, CASE WHEN a IS NOT NULL AND sm IS NOT NULL THEN sha256('{{"stage":"speaker","asr_key":"' || a || '","speaker_model":"' || sm || '","window_ms":1500}}') END AS speaker_key FROM sk""")
def _(spark, sf_dir):
    return T.stage_keys(identities(spark, sf_dir))


@query("stage_cache_lookup", f"WITH {_SK} SELECT task_id, task_id % 4 <> 0 AS hit, CASE WHEN task_id % 4 <> 0 THEN task_id * 10 + 2 END AS result FROM sk WHERE a IS NOT NULL")
def _(spark, sf_dir):
    k = T.stage_keys(identities(spark, sf_dir)).filter("asr_key is not null").select("task_id", F.lit("asr").alias("stage"), F.sha2(F.col("task_id").cast("string").cast("binary"), 256).alias("key"))
    entries = k.filter("task_id % 4 <> 0").select("stage", "key", F.explode(F.array(F.lit(1), F.lit(2))).alias("created"), "task_id").select("stage", "key", "created", (F.col("task_id") * 10 + F.col("created")).alias("result"))
    entries = entries.union(k.filter("task_id % 4 = 0").select(F.lit("other"), "key", F.lit(9), F.col("task_id")))
    return T.cache_lookup(entries, k).join(k, ["stage", "key"]).select("task_id", "hit", "result")


# Manifests from parts and suppliers.
_MF = """mf AS (SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 1 THEN '..' WHEN 2 THEN 'a/b' ELSE 'f' || (p_partkey % 700) END AS name, CASE WHEN p_partkey % 9 = 3 THEN 'zz' ELSE sha256(p_name) END AS sha256, CASE WHEN p_partkey % 9 = 4 THEN -1 WHEN p_partkey % 9 = 6 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 9 = 5 THEN '' ELSE 'https://x/' END AS url FROM part)"""


def entries(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 9 == 1, F.lit("..")).when(k % 9 == 2, F.lit("a/b")).otherwise(F.concat(F.lit("f"), (k % 700).cast("string"))).alias("name"), F.when(k % 9 == 3, F.lit("zz")).otherwise(F.sha2(F.col("p_name").cast("binary"), 256)).alias("sha256"),
        F.when(k % 9 == 4, -1).when(k % 9 != 6, F.col("p_size")).alias("size"), F.when(k % 9 == 5, F.lit("")).otherwise(F.lit("https://x/")).alias("url"))


@query("manifest_valid", f"WITH {_MF} SELECT k, CASE k % 9 WHEN 1 THEN 'bad_name' WHEN 2 THEN 'bad_name' WHEN 3 THEN 'bad_sha256' WHEN 4 THEN 'bad_size' END AS error FROM mf")
def _(spark, sf_dir):
    return M.validated(entries(spark, sf_dir)).select("k", "error")


@query("manifest_duplicates", f"WITH {_MF} SELECT name, count(*) AS n FROM mf GROUP BY name HAVING count(*) > 1")
def _(spark, sf_dir):
    return M.duplicates(entries(spark, sf_dir), ["name"])


@query("manifest_diff", "WITH e AS (SELECT p_partkey AS name, p_size AS sha, p_partkey % 6 <> 0 AS req FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS sha FROM part WHERE p_partkey % 3 <> 0), j AS (SELECT coalesce(e.name, f.name) AS name, CASE WHEN e.name IS NULL THEN 'unexpected' WHEN f.name IS NULL THEN CASE WHEN req THEN 'missing' END WHEN e.sha <> f.sha THEN 'changed' END AS problem FROM e FULL JOIN f ON e.name = f.name) SELECT * FROM j WHERE problem IS NOT NULL")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "name")
    expected = p.filter("name % 4 <> 0").select("name", F.col("p_size").alias("sha256"), (F.col("name") % 6 != 0).alias("required"))
    return M.compared(expected, p.filter("name % 3 <> 0").select("name", F.when(F.col("name") % 5 == 0, 0).otherwise(F.col("p_size")).alias("sha256")))


@query("manifest_reuse", f"WITH {_MF} SELECT k, k % 2 = 0 AS reuse FROM mf")
def _(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("version", F.col("k").cast("string"))
    return M.reusable(e, e.filter("k % 2 = 0").select("name", "sha256", "version")).select("k", "reuse")


@query("manifest_merge", "WITH m AS (SELECT 'p' || (p_partkey % 8) AS platform, CASE WHEN p_partkey % 8 = 3 THEN p_partkey % 2 ELSE 0 END AS part, CASE WHEN p_partkey % 8 = 5 THEN 'v2' ELSE 'v1' END AS version FROM part WHERE p_partkey % 8 <> 3 OR p_partkey % 16 IN (3, 11)) SELECT platform, min(version) AS version, count(*) AS n_files, CASE WHEN count(DISTINCT part) > 1 THEN 'duplicate_platform' WHEN min(version) <> 'v1' THEN 'version_conflict' END AS conflict FROM m GROUP BY platform")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (k % 8).cast("string")).alias("platform"), F.when(k % 8 == 3, k % 2).otherwise(0).alias("part"), F.when(k % 8 == 5, F.lit("v2")).otherwise(F.lit("v1")).alias("version"))
    return M.merged(m)


@query("first_valid_mirror", "WITH m AS (SELECT l_orderkey AS name, l_linenumber AS ordinal, l_quantity > 25 AND l_returnflag <> 'R' AS good FROM lineitem) SELECT name, min(ordinal) FILTER (WHERE good) AS ordinal, count(*) AS n_mirrors FROM m GROUP BY name")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("ordinal"), F.lit(1).alias("size"), F.when(F.col("l_quantity") > 25, 1).otherwise(2).alias("got_size"), F.lit("AB").alias("sha256"), F.when(F.col("l_returnflag") != "R", F.lit("ab")).alias("got_sha256"))
    return M.first_valid(m)




# One worker a lane, tasks that arrive faster than they end.
@query("queue", """WITH q AS (SELECT o_custkey % 4 AS lane, o_orderkey AS task_id, o_orderkey * 7 % 5000 AS arr, 1 + o_orderkey % 5 AS duration FROM orders),
s AS (SELECT *, sum(duration) OVER (PARTITION BY lane ORDER BY arr, task_id) AS upto FROM q)
SELECT lane, task_id, cast(max(arr - upto + duration) OVER (PARTITION BY lane ORDER BY arr, task_id) + upto - duration AS BIGINT) AS started, cast(max(arr - upto + duration) OVER (PARTITION BY lane ORDER BY arr, task_id) + upto AS BIGINT) AS ended FROM s""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("lane"), k.alias("task_id"), (k * 7 % 5000).alias("at"), (1 + k % 5).alias("duration"))
    return T.queued(q).select("lane", "task_id", "started", "ended")


_LP = """ev AS (SELECT user_id AS task_id, event_id AS seq, event_id * 13 % 4000 AS arr, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status FROM events WHERE event_id % 40 < 6),
po AS (SELECT event_id AS poll_id, user_id AS task_id, event_id * 29 % 4000 AS arr, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 90 WHEN 2 THEN -5 ELSE 20 END AS wait_s FROM events WHERE event_id % 3 = 0),
w AS (SELECT *, arr + least(50, greatest(0, coalesce(wait_s, 45))) AS until FROM po),
b AS (SELECT w.*, (SELECT status FROM ev WHERE ev.task_id = w.task_id AND ev.arr <= w.arr ORDER BY ev.arr DESC, seq DESC LIMIT 1) AS s0, (SELECT status FROM ev WHERE ev.task_id = w.task_id AND ev.arr <= w.until ORDER BY ev.arr DESC, seq DESC LIMIT 1) AS s1,
 (SELECT {'a': ev.arr, 's': status} FROM ev WHERE ev.task_id = w.task_id AND ev.arr > w.arr AND ev.arr <= w.until AND status IN ('completed', 'failed') ORDER BY ev.arr, seq LIMIT 1) AS e FROM w)"""


@query("long_polls", f"WITH {_LP} SELECT poll_id, CASE WHEN s0 IN ('completed', 'failed') THEN arr WHEN e IS NOT NULL THEN e.a ELSE until END AS answered_at, CASE WHEN s0 IN ('completed', 'failed') THEN s0 WHEN e IS NOT NULL THEN e.s ELSE s1 END AS status, coalesce(s0, '') NOT IN ('completed', 'failed') AND e IS NULL AS timed_out, CASE WHEN coalesce(s0, '') NOT IN ('completed', 'failed') AND e IS NULL THEN 500 END AS retry_ms FROM b")
def _(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("running")
    happened = e.filter(k % 40 < 6).select(F.col("user_id").alias("task_id"), k.alias("seq"), (k * 13 % 4000).alias("at"), status.alias("status"))
    polls = e.filter(k % 3 == 0).select(k.alias("poll_id"), F.col("user_id").alias("task_id"), (k * 29 % 4000).alias("at"), F.when(k % 4 == 1, 90).when(k % 4 == 2, -5).when(k % 4 == 3, 20).alias("wait_s"))
    return T.long_polls(polls, happened).select("poll_id", "answered_at", "status", "timed_out", "retry_ms")


@query("task_options", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'auto' WHEN p_size % 3 = 1 THEN 'auto' ELSE 'de' END AS language, CASE WHEN p_size % 2 = 0 THEN 'markdown' ELSE 'srt' END AS output_format, p_size % 5 <> 1 AS speaker_profile FROM part")
def _(spark, sf_dir):
    n = F.col("p_size")
    asked = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 3 == 1, "").when(n % 3 == 2, "de").alias("language"), F.when(n % 2 == 1, "srt").alias("output_format"), F.when(n % 5 == 1, F.lit(False)).when(n % 5 == 2, F.lit(True)).alias("speaker_profile"))
    return T.settled_options(asked)


@query("cache_identity", """SELECT p_partkey, sha256('{"version":4,"source":{"audio_path":"/a/' || p_partkey || '.wav","size":' || p_size || ',"mtime_ms":' || p_partkey * 1000 || '},"asr":{"version":2,"language":"auto","model":"asr.gguf","chunk_seconds":"adaptive"},"speaker":{"enabled":' || CASE WHEN p_size % 2 = 0 THEN 'true,"version":5,"model":"voice.onnx","batch_size":64,"profiles_fingerprint":"' || p_brand || '"' ELSE 'false,"version":null,"model":null,"batch_size":null,"profiles_fingerprint":null' END || '},"render":{"output_format":"markdown"}}') AS cache_key FROM part""")
def _(spark, sf_dir):
    n = F.col("p_size")
    tasks = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a/"), "p_partkey", F.lit(".wav")).alias("audio_path"), n.alias("size"), (F.col("p_partkey") * 1000).alias("modified_ms"), F.lit("auto").alias("language"), F.lit("markdown").alias("output_format"), (n % 2 == 0).alias("speaker_profile"), F.col("p_brand").alias("profiles_fingerprint"))
    found = T.cache_identities(tasks, {"model": "asr.gguf", "chunk_seconds": "adaptive"}, {"model": "voice.onnx", "batch_size": 64}, {"pipeline": 4, "asr": 2, "speaker": 5})
    return found.select("p_partkey", "cache_key")


@query("runtime_identity", """WITH c AS (SELECT p_partkey % 50 AS s, p_partkey AS k, 'lib' || printf('%05d', p_partkey) AS n, sha256(p_name) AS h FROM part WHERE p_partkey % 4 = 0), g AS (SELECT s, string_agg('{"name":"' || n || '","sha256":"' || h || '"}', ',' ORDER BY n) AS j, count(*) AS n FROM c GROUP BY s)
SELECT s_suppkey, coalesce(g.n, 0) AS n_companions, sha256('{"source":"env","name":"bin' || s_suppkey || '","sha256":"' || sha256(s_name) || '","companions":[' || coalesce(j, '') || ']}') AS runtime_key FROM supplier LEFT JOIN g ON g.s = s_suppkey""")
def _(spark, sf_dir):
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    programs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("bin"), "s_suppkey").alias("name"), F.lit("env").alias("source"), sha("s_name").alias("sha256"))
    beside = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.concat(F.lit("bin"), F.col("p_partkey") % 50).alias("of"), F.format_string("lib%05d", "p_partkey").alias("name"), sha("p_name").alias("sha256"))
    found = T.runtime_identities(programs.drop("s_suppkey"), beside)
    return found.select(F.substring("name", 4, 20).cast("long").alias("s_suppkey"), F.size("companions").cast("long").alias("n_companions"), "runtime_key")


@query("partial_results", f"{_S}, c AS (SELECT rec AS task_id, seg_idx AS k, trim(replace(text, chr(10), ' ')) AS t FROM seg WHERE (rec + seg_idx) % 3 <> 0) SELECT task_id, count(*) AS done, cast(count(*) * 300 AS BIGINT) AS covered_s, coalesce(string_agg(t, ' ' ORDER BY k) FILTER (WHERE t <> ''), '') AS text FROM c GROUP BY task_id")
def _(spark, sf_dir):
    s = segments(spark, sf_dir).filter("(rec + seg_idx) % 3 <> 0")
    return T.partial_results(s.select(F.col("rec").alias("task_id"), (F.col("seg_idx") * 300).alias("offset_s"), F.lit(300).alias("chunk_s"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))


@query("response_lines", """SELECT CASE WHEN p_partkey % 3 = 0 THEN '{"jsonrpc":"2.0","id":"' || p_partkey || '","error":{"code":"bad","message":"x {\\"vector\\":\\"[redacted]\\"}"}}' ELSE '{"jsonrpc":"2.0","id":"' || p_partkey || '","result":{"size":' || p_size || '}}' END AS value FROM part""")
def _(spark, sf_dir):
    p, bad = table(spark, sf_dir, "part"), F.col("p_partkey") % 3 == 0
    rows = p.select(F.col("p_partkey").cast("string").alias("id"), F.when(~bad, F.to_json(F.struct(F.col("p_size").alias("size")))).alias("result"), F.when(bad, "bad").alias("code"), F.when(bad, 'x {"vector":[1,2]}').alias("message"))
    return T.response_lines(rows)
