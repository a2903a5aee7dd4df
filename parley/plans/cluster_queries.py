"""Queries of vectors, clusters and profile matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import vectors as V
from parley.operators import clustering as C
from parley.operators import matching as M
from parley.operators.intervals import greedy_disjoint, union_length
from parley.plans.registry import query
from parley.plans.views import COS, POINTS, TEXT, UNIT, points, table

_P = f"WITH RECURSIVE {POINTS}"
_U = UNIT.format(v="v")
_BY = ["rec", "truth"]
_PROTO = f"""{_P}, u AS (SELECT rec, truth, key, start_ms, end_ms, v, {_U} AS u FROM pts),
c AS (SELECT rec, truth, i, sum(x ORDER BY key) AS x FROM (SELECT rec, truth, key, unnest(u) AS x, unnest(range(len(u))) AS i FROM u) GROUP BY ALL),
s AS (SELECT rec, truth, list(x ORDER BY i) AS s FROM c GROUP BY ALL), proto AS (SELECT rec, truth, {UNIT.format(v='s')} AS p FROM s)"""
_EDGES = f"""{_P}, o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_ms, key) AS rn FROM pts),
e AS (SELECT a.rec, a.key AS a, b.key AS b, {COS.format(a='a.v', b='b.v')} AS score FROM o a JOIN o b ON a.rec = b.rec AND a.rn BETWEEN b.rn - 48 AND b.rn - 1
 WHERE (SELECT min(x.end_ms) FROM o x WHERE x.rec = b.rec AND x.rn BETWEEN a.rn AND b.rn - 1) >= b.start_ms - 12000), edges AS (SELECT * FROM e WHERE score >= 0.72)"""
_SUPPORT = f"""{_PROTO}, iv AS (SELECT *, max(end_ms) OVER (PARTITION BY rec, truth ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
 row_number() OVER (PARTITION BY rec, truth ORDER BY start_ms, end_ms) AS rn FROM pts),
un AS (SELECT rec, truth, cast(sum(greatest(end_ms - greatest(start_ms, coalesce(seen, start_ms)), 0)) AS BIGINT) AS union_ms, count(*) AS size, min(key) AS canonical_key FROM iv GROUP BY ALL),
ev AS (SELECT rec, truth, rn, 1 AS n, end_ms AS last FROM iv WHERE rn = 1 UNION ALL SELECT i.rec, i.truth, i.rn, CASE WHEN i.start_ms >= ev.last THEN ev.n + 1 ELSE ev.n END, CASE WHEN i.start_ms >= ev.last THEN i.end_ms ELSE ev.last END
 FROM ev JOIN iv i ON i.rec = ev.rec AND i.truth = ev.truth AND i.rn = ev.rn + 1),
evs AS (SELECT rec, truth, max(n) AS evidence FROM ev GROUP BY ALL),
co AS (SELECT u.rec, u.truth, avg({COS.format(a='u.v', b='proto.p')}) AS coherence FROM u JOIN proto USING (rec, truth) GROUP BY ALL),
sup AS (SELECT un.*, evidence, coherence FROM un JOIN evs USING (rec, truth) JOIN co USING (rec, truth))"""


@query("normalize_vec", f"{_P} SELECT vec_id, {TEXT.format(v=_U)} AS unit FROM pts")
def _(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", V.as_text(V.unit(F.col("v"))).alias("unit"))


@query("cosine_pairs", f"{_P} SELECT a.vec_id, round({COS.format(a='a.v', b='b.v')}, 6) AS score FROM pts a JOIN pts b ON a.rec = b.rec AND b.idx = a.idx + 1")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    other = p.select("rec", (F.col("idx") - 1).alias("idx"), F.col("v").alias("w"))
    return p.join(other, ["rec", "idx"]).select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query("interval_union", f"{_SUPPORT} SELECT rec, truth, union_ms FROM un")
def _(spark, sf_dir):
    return union_length(points(spark, sf_dir), _BY, "start_ms", "end_ms", "union_ms")


@query("independent_evidence", f"{_SUPPORT} SELECT rec, truth, evidence FROM evs")
def _(spark, sf_dir):
    spans = F.collect_list(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end")))
    return points(spark, sf_dir).groupBy(*_BY).agg(greedy_disjoint(spans, 1000, 0).alias("evidence"))


@query("cluster_prototype", f"{_PROTO} SELECT rec, truth, {TEXT.format(v='p')} AS prototype FROM proto")
def _(spark, sf_dir):
    return C.prototypes(points(spark, sf_dir), _BY).select(*_BY, V.as_text(F.col("prototype")).alias("prototype"))


@query("weighted_prototype", _PROTO.replace("sum(x ORDER BY key)", "sum(x * w ORDER BY key)").replace("SELECT rec, truth, key, unnest(u) AS x", "SELECT rec, truth, key, greatest(1.0::DOUBLE, (vec_id % 5)::DOUBLE) AS w, unnest(u) AS x").replace("SELECT rec, truth, key, start_ms", "SELECT vec_id, rec, truth, key, start_ms") + f" SELECT rec, truth, {TEXT.format(v='p')} AS prototype FROM proto")
def _(spark, sf_dir):
    return C.prototypes(points(spark, sf_dir), _BY, (F.col("vec_id") % 5).cast("double")).select(*_BY, V.as_text(F.col("prototype")).alias("prototype"))


@query("mean_embedding", f"{_P}, c AS (SELECT rec, i, avg(x ORDER BY key) AS x FROM (SELECT rec, key, unnest(v) AS x, unnest(range(len(v))) AS i FROM pts) GROUP BY ALL), s AS (SELECT rec, list(x ORDER BY i) AS s FROM c GROUP BY ALL) SELECT rec, {TEXT.format(v=UNIT.format(v='s'))} AS mean FROM s")
def _(spark, sf_dir):
    return M.mean_vectors(points(spark, sf_dir), ["rec"]).select("rec", V.as_text(F.col("mean")).alias("mean"))


@query("floor_percentile", f"{_PROTO}, sc AS (SELECT u.rec, u.truth, list_sort(list(round({COS.format(a='u.v', b='proto.p')}, 6))) AS cs FROM u JOIN proto USING (rec, truth) GROUP BY ALL) SELECT rec, truth, cs[cast(floor((len(cs) - 1) * 0.2::DOUBLE) AS INT) + 1] AS p20 FROM sc")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    scores = p.join(C.prototypes(p, _BY), _BY).groupBy(*_BY).agg(F.collect_list(F.round(V.clamped_cosine(F.col("v"), F.col("prototype")), 6)).alias("cs"))
    return scores.select(*_BY, M.floor_percentile(F.col("cs"), 0.2).alias("p20"))


@query("cluster_support", f"{_SUPPORT} SELECT rec, truth, size, canonical_key, union_ms, evidence, round(coherence, 6) AS coherence FROM sup")
def _(spark, sf_dir):
    return C.support(points(spark, sf_dir), _BY).select(*_BY, "size", "canonical_key", "union_ms", "evidence", F.round("coherence", 6).alias("coherence"))


_TRUST = f"{_SUPPORT}, tr AS (SELECT *, evidence >= 3 AND union_ms >= 2500 AND coherence >= 0.48 AND (union_ms >= 3000 OR evidence >= 4) AND size >= 2 AS trusted, evidence >= 6 AND union_ms >= 6000 AND coherence >= 0.48 AS strong FROM sup)"


@query("cluster_trust", f"{_TRUST} SELECT rec, truth, trusted, strong FROM tr")
def _(spark, sf_dir):
    return C.trust(C.support(points(spark, sf_dir), _BY)).select(*_BY, "trusted", "strong")


@query("publication_cap", f"{_TRUST}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, trusted ORDER BY union_ms DESC, evidence DESC, canonical_key) AS k, count(*) FILTER (WHERE trusted) OVER (PARTITION BY rec) AS n, count(*) OVER (PARTITION BY rec) AS m FROM tr) SELECT rec, truth, trusted AND k <= 3 AS trusted, n > 3 OR m > 3 AS exceeded FROM r")
def _(spark, sf_dir):
    return C.publication_cap(C.trust(C.support(points(spark, sf_dir), _BY)), 3).select(*_BY, "trusted", "exceeded")


@query("sample_members", f"{_P}, r AS (SELECT rec, key, row_number() OVER (PARTITION BY rec ORDER BY key) - 1 AS at, count(*) OVER (PARTITION BY rec) AS n FROM pts), k AS (SELECT DISTINCT rec, n, cast(floor(i * n / 24) AS BIGINT) AS at FROM (SELECT DISTINCT rec, n FROM r), unnest(range(24)) t(i)) SELECT rec, key FROM r WHERE n <= 24 OR EXISTS (SELECT 1 FROM k WHERE k.rec = r.rec AND k.at = r.at)")
def _(spark, sf_dir):
    return C.sample_members(points(spark, sf_dir), ["rec"]).select("rec", "key")


@query("micro_edges", f"{_EDGES} SELECT rec, a, b, round(score, 6) AS score FROM edges")
def _(spark, sf_dir):
    return C.micro_edges(points(spark, sf_dir)).select("rec", "a", "b", F.round("score", 6).alias("score"))


@query("micro_clusters", f"{_EDGES}, sym AS (SELECT rec, a, b FROM edges UNION SELECT rec, b, a FROM edges), reach AS (SELECT rec, key, key AS r FROM pts UNION SELECT reach.rec, reach.key, sym.b FROM reach JOIN sym ON sym.rec = reach.rec AND sym.a = reach.r) SELECT rec, key, min(r) AS cluster FROM reach GROUP BY ALL")
def _(spark, sf_dir):
    return C.micro_clusters(points(spark, sf_dir))


@query("cluster_labels", f"{_P}, l AS (SELECT rec, truth, min(key) AS k FROM pts GROUP BY ALL) SELECT pts.rec, key, cast(d AS INT) AS label FROM pts JOIN (SELECT rec, truth, dense_rank() OVER (PARTITION BY rec ORDER BY k) - 1 AS d FROM l) USING (rec, truth)")
def _(spark, sf_dir):
    return C.labels(points(spark, sf_dir).select("rec", "key", F.col("truth").alias("cluster"))).select("rec", "key", "label")


_ANCHOR = f"{_P}, r AS (SELECT rec, key, row_number() OVER (PARTITION BY rec ORDER BY start_ms, key) - 1 AS t, row_number() OVER (PARTITION BY rec ORDER BY 1 + vec_id % 7 DESC, key) AS k, greatest(1, cast(ceil(count(*) OVER (PARTITION BY rec) / 16.0) AS BIGINT)) AS s FROM pts), anc AS (SELECT rec, key FROM r WHERE t % s = 0 OR k <= 8)"


def _summaries(spark, sf_dir):
    return points(spark, sf_dir).select("rec", F.col("key").alias("cluster"), F.col("start_ms").alias("first_ms"), (1 + F.col("vec_id") % 7).alias("size"), V.unit(F.col("v")).alias("prototype"))


_FEW = C.ClusterOptions(stride_anchors=16, large_anchors=8, look_back=10)


@query("anchors", f"{_ANCHOR} SELECT rec, key AS cluster FROM anc")
def _(spark, sf_dir):
    return C.anchors(_summaries(spark, sf_dir), _FEW).select("rec", "cluster")


@query("consolidation_candidates", f"""{_ANCHOR}, o AS (SELECT rec, key, v, row_number() OVER (PARTITION BY rec ORDER BY start_ms, key) AS rn FROM pts),
pr AS (SELECT DISTINCT a.rec, least(a.key, b.key) AS a, greatest(a.key, b.key) AS b FROM o a JOIN o b ON a.rec = b.rec AND a.key <> b.key WHERE a.rn BETWEEN b.rn - 10 AND b.rn - 1 OR EXISTS (SELECT 1 FROM anc WHERE anc.rec = a.rec AND anc.key = a.key))
SELECT pr.rec, pr.a, pr.b, round({COS.format(a='x.v', b='y.v')}, 6) AS score FROM pr JOIN pts x ON x.key = pr.a JOIN pts y ON y.key = pr.b WHERE {COS.format(a='x.v', b='y.v')} >= 0.38""")
def _(spark, sf_dir):
    return C.candidates(_summaries(spark, sf_dir), _FEW).select("rec", "a", "b", F.round("score", 6).alias("score"))


@query("consolidate")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.consolidate(p, C.micro_clusters(p))


@query("cluster_pipeline")
def _(spark, sf_dir):
    scored, _summary = C.cluster_points(points(spark, sf_dir))
    return scored.select("rec", "key", "label", F.round("score", 6).alias("score"))


@query("cluster_summary")
def _(spark, sf_dir):
    return C.cluster_points(points(spark, sf_dir))[1].select("rec", "label", "size", "canonical_key", "union_ms", "evidence", F.round("coherence", 6).alias("coherence"), "trusted", "strong", "exceeded")


_PROFILES = f"""{_PROTO}, pc AS (SELECT truth, i, sum(x ORDER BY rec, key) AS x FROM (SELECT rec, truth, key, unnest(u) AS x, unnest(range(len(u))) AS i FROM u) GROUP BY ALL),
ps AS (SELECT truth, list(x ORDER BY i) AS s FROM pc GROUP BY ALL), prof AS (SELECT 'person_' || truth AS person_id, 'Person ' || truth AS name, {UNIT.format(v='s')} AS q FROM ps)"""


def _profiles(spark, sf_dir):
    return C.prototypes(points(spark, sf_dir).withColumn("key", F.format_string("%09d%s", "rec", "key")), ["truth"]).select(
        F.concat(F.lit("person_"), "truth").alias("person_id"), F.concat(F.lit("Person "), "truth").alias("name"), "prototype")


@query("match_profiles", f"""{_PROFILES}, sc AS (SELECT rec, truth, person_id, name, {COS.format(a='proto.p', b='prof.q')} AS score FROM proto, prof),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec, truth ORDER BY score DESC, person_id) AS k, lead(score) OVER (PARTITION BY rec, truth ORDER BY score DESC, person_id) AS second FROM sc)
SELECT rec, truth, person_id, round(score, 6) AS score FROM rk WHERE k = 1 AND score >= 0.62 AND (second IS NULL OR score - second >= 0.05)""")
def _(spark, sf_dir):
    clusters = C.prototypes(points(spark, sf_dir), _BY)
    return M.match_profiles(clusters, _BY, _profiles(spark, sf_dir)).select(*_BY, "person_id", F.round("score", 6).alias("score"))


@query("match_profiles_legacy", f"""{_PROFILES}, sc AS (SELECT vec_id, person_id, {COS.format(a='pts.v', b='prof.q')} AS score FROM pts, prof),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, person_id) AS k, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, person_id) AS second FROM sc)
SELECT vec_id, person_id, round(score, 6) AS score FROM rk WHERE k = 1 AND score >= 0.62 AND (second IS NULL OR score - second >= 0.05)""")
def _(spark, sf_dir):
    return M.match_profiles(points(spark, sf_dir).select("vec_id", F.col("v").alias("prototype")), ["vec_id"], _profiles(spark, sf_dir)).select("vec_id", "person_id", F.round("score", 6).alias("score"))


@query("profile_fingerprint", f"{_PROFILES} SELECT substr(sha256(string_agg(person_id || '=' || name || '=' || {TEXT.format(v='q')}, ';' ORDER BY person_id)), 1, 16) AS fingerprint, count(*) AS n FROM prof")
def _(spark, sf_dir):
    return M.fingerprint(_profiles(spark, sf_dir))


@query("embed_lookup", f"{_P}, req AS (SELECT conv_id AS rec, (turn * 7) % 50 AS idx, turn AS pos FROM conversations), one AS (SELECT rec, idx, min(pos) AS pos FROM req GROUP BY ALL) SELECT one.rec, pos, key FROM one JOIN pts ON pts.rec = one.rec AND pts.idx = one.idx")
def _(spark, sf_dir):
    wanted = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("rec")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn"))), lambda x: x["turn"] * 7 % 50).alias("ids"), F.array_sort(F.collect_list("turn")).alias("turns"))
    found = M.ordered_lookup(wanted, points(spark, sf_dir).withColumnRenamed("idx", "id"))
    return found.select("rec", F.element_at("turns", F.col("pos") + 1).alias("pos"), "key")


@query("embedding_entries", f"{_P} SELECT rec, count(*) AS n, string_agg(key || ':' || len(v), ',' ORDER BY idx) AS entries FROM pts GROUP BY rec")
def _(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("key", F.when(F.col("idx") % 2 == 0, F.col("key")))
    entries = M.embedding_entries(p.withColumn("id", F.coalesce("key", F.format_string("w%06d", "vec_id"))), "v")
    return entries.groupBy("rec").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id", F.size("vector").alias("n")))), lambda e: F.concat_ws(":", e["id"], e["n"])), ",").alias("entries"))
