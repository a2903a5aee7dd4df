"""Queries of parsing, scalar functions, rendering and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.operators import manifests, reads, rendering
from parley.operators import profiles as P
from parley.operators import publication as Q
from parley.plans.registry import query
from parley.plans.views import SEGMENTS, TURNS, segments, table, turns
from parley.sources import transcripts

_S = f"WITH {SEGMENTS}"
#: Clean text in DuckDB; its white space class is ASCII, as the fixtures' is.
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<\|[^>]+\|>', '', 'g'), '\s+', ' ', 'g'))"
_RAW = rf"""raw AS (SELECT rec, id, seg_idx, start_ms, end_ms, '<|en|><|NEUTRAL|>' || replace(text, chr(10), ' ') AS t FROM seg WHERE text IS NOT NULL)"""


def raw_output(spark, sf_dir):
    """One recogniser output a recording: a log line, then timed lines, or for odd recordings plain ones."""
    text = F.concat(F.lit("<|en|><|NEUTRAL|>"), F.replace("text", F.lit("\n"), F.lit(" ")))
    timed = F.format_string("[%d.%03d-%d.%03d] %s", F.floor(F.col("start_ms") / 1000), F.col("start_ms") % 1000, F.floor(F.col("end_ms") / 1000), F.col("end_ms") % 1000, text)
    line = F.when(F.col("rec") % 2 == 0, timed).otherwise(text)
    rows = segments(spark, sf_dir).filter("text is not null").groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))).alias("ls"))
    return rows.select("rec", F.concat(F.lit("main: loading model\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("raw"))


@query("parse_asr_lines", f"""{_S}, {_RAW}, e AS (SELECT rec, start_ms / 1000.0 AS s, end_ms / 1000.0 AS e, {_CLEAN.format('t')} AS text, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) - 1 AS k FROM raw WHERE rec % 2 = 0 AND {_CLEAN.format('t')} <> '')
SELECT rec, printf('seg_%04d', k + 1) AS id, s::DOUBLE AS start, e::DOUBLE AS stop, text FROM e
UNION ALL SELECT rec, 'seg_0001', NULL, NULL, string_agg({_CLEAN.format('t')}, ' ' ORDER BY seg_idx) FROM raw WHERE rec % 2 = 1 AND {_CLEAN.format('t')} <> '' GROUP BY rec""")
def _(spark, sf_dir):
    return transcripts.parse_asr_lines(raw_output(spark, sf_dir)).select("rec", "id", "start", F.col("end").alias("stop"), "text")


@query("parse_asr_json", f"{_S}, c AS (SELECT rec, seg_idx, start_ms / 1000.0 AS s, CASE WHEN seg_idx % 3 <> 0 THEN end_ms / 1000.0 END AS e, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, speaker AS role FROM seg WHERE text IS NOT NULL) SELECT rec, printf('seg_%04d', row_number() OVER (PARTITION BY rec ORDER BY seg_idx)) AS id, s::DOUBLE AS start, e::DOUBLE AS stop, text, CASE WHEN seg_idx % 2 = 0 THEN role ELSE 'unknown' END AS speaker, CASE WHEN seg_idx % 4 = 1 THEN 0.5::DOUBLE END AS confidence FROM c WHERE text <> ''")
def _(spark, sf_dir):
    one = F.struct((F.col("start_ms") / 1000).alias("start"), F.when(F.col("seg_idx") % 3 != 0, F.col("end_ms") / 1000).alias("end"), F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("text"), F.when(F.col("seg_idx") % 2 == 0, F.col("speaker")).alias("speaker"), F.when(F.col("seg_idx") % 4 == 1, 0.5).alias("confidence"))
    listed = segments(spark, sf_dir).filter("text is not null").groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", one.alias("o")))), lambda x: x["o"]).alias("segments"))
    raw = listed.select("rec", F.when(F.col("rec") % 2 == 0, F.to_json("segments")).otherwise(F.to_json(F.struct("segments"))).alias("raw"))
    return transcripts.parse_asr_json(raw).select("rec", "id", "start", F.col("end").alias("stop"), "text", "speaker", "confidence")


@query("parse_rttm", f"WITH {TURNS} SELECT rec::VARCHAR AS uri, speaker, start::DOUBLE AS start, \"end\"::DOUBLE AS stop FROM ref WHERE event_id % 11 <> 0")
def _(spark, sf_dir):
    ref = turns(spark, sf_dir)[0]
    good = F.format_string("SPEAKER %d 1 %d.0 %d.0 <NA> <NA> %s <NA> <NA>", "rec", "start", F.col("end") - F.col("start"), "speaker")
    line = F.when(F.col("event_id") % 11 != 0, good).when(F.col("event_id") % 2 == 0, F.lit("# a comment")).otherwise(F.lit(""))
    return transcripts.parse_rttm(ref.select(line.alias("value"))).select("uri", "speaker", "start", F.col("end").alias("stop"))


@query("segment_intake", f"{_S}, r AS (SELECT rec, seg_idx, CASE WHEN seg_idx % 4 <> 0 THEN id END AS id, start_ms - 300 AS s, CASE WHEN seg_idx % 5 <> 0 THEN end_ms END AS e, max(end_ms) OVER (PARTITION BY rec) - 700 AS d FROM seg), x AS (SELECT rec, coalesce(id, 'seg_' || row_number() OVER (PARTITION BY rec ORDER BY seg_idx)) AS id, greatest(0, s) AS s, e, d FROM r), y AS (SELECT rec, id, s AS start_ms, least(d, CASE WHEN e > s THEN e ELSE d END) AS end_ms FROM x) SELECT * FROM y WHERE end_ms > start_ms")
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    s = segments(spark, sf_dir).withColumn("duration_ms", F.max("end_ms").over(Window.partitionBy("rec")) - 700)
    s = s.withColumns({"id": F.when(F.col("seg_idx") % 4 != 0, F.col("id")), "start_ms": F.col("start_ms") - 300, "end_ms": F.when(F.col("seg_idx") % 5 != 0, F.col("end_ms"))})
    return transcripts.segment_intake(s).select("rec", "id", "start_ms", "end_ms")


@query("clean_text", f"{_S} SELECT rec, seg_idx, {_CLEAN.format(chr(39) + '<|en|> ' + chr(39) + ' || text')} AS text FROM seg")
def _(spark, sf_dir):
    return segments(spark, sf_dir).select("rec", "seg_idx", S.clean_text(F.concat(F.lit("<|en|> "), "text")).alias("text"))


@query("format_clock", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '--:--:--' ELSE printf('%02d:%02d:%02d', cast(floor(o_totalprice) AS BIGINT) // 3600, cast(floor(o_totalprice) AS BIGINT) % 3600 // 60, cast(floor(o_totalprice) AS BIGINT) % 60) END AS clock FROM orders")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.format_clock(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))).alias("clock"))


@query("person_id", r"SELECT c_custkey, 'person_' || CASE WHEN s = '' THEN substr(sha256(n), 1, 16) ELSE substr(s, 1, 128) END AS person_id FROM (SELECT c_custkey, n, regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '\s+', '_', 'g'), '[^\p{L}\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '!?' ELSE ' ' || c_name || ' (' || c_mktsegment || ') ' END AS n FROM customer))")
def _(spark, sf_dir):
    n = F.when(F.col("c_custkey") % 9 == 0, F.lit("!?")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(") ")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.person_id(n).alias("person_id"))


@query("valid_ids", f"""{_S} SELECT rec, seg_idx, regexp_full_match(id, 'seg_[A-Za-z0-9][A-Za-z0-9_-]{{0,127}}') AS segment_ok, regexp_full_match('task_' || sha256(id), 'task_[a-f0-9]{{16,64}}') AS task_ok, regexp_full_match('learn_' || seg_idx, 'learn_[a-f0-9]{{16,64}}') AS learning_ok, regexp_full_match('person_' || speaker || ' ', 'person_[\\p{{L}}\\p{{N}}_-]{{1,128}}') AS person_ok FROM seg""")
def _(spark, sf_dir):
    return segments(spark, sf_dir).select(
        "rec", "seg_idx", S.valid_id("segment", F.col("id")).alias("segment_ok"), S.valid_id("task", F.concat(F.lit("task_"), F.sha2(F.col("id").cast("binary"), 256))).alias("task_ok"),
        S.valid_id("learning", F.concat(F.lit("learn_"), "seg_idx")).alias("learning_ok"), S.valid_id("person", F.concat(F.lit("person_"), "speaker", F.lit(" "))).alias("person_ok"))


@query("normalize_cluster_ids", f"{_S}, v AS (SELECT rec, seg_idx, CASE seg_idx % 4 WHEN 0 THEN seg_idx::VARCHAR WHEN 1 THEN 'cluster_' || seg_idx WHEN 2 THEN speaker ELSE 'cluster_a b' END AS x FROM seg) SELECT rec, seg_idx, CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'cluster_' || x WHEN regexp_full_match(x, 'cluster_[A-Za-z0-9_-]+') THEN x END AS canonical, CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'cluster_' || x ELSE x END AS lenient FROM v")
def _(spark, sf_dir):
    k = F.col("seg_idx") % 4
    x = F.when(k == 0, F.col("seg_idx").cast("string")).when(k == 1, F.concat(F.lit("cluster_"), "seg_idx")).when(k == 2, F.col("speaker")).otherwise(F.lit("cluster_a b"))
    return segments(spark, sf_dir).select("rec", "seg_idx", S.canonical_cluster_id(x).alias("canonical"), S.lenient_cluster_id(x).alias("lenient"))


@query("redact_message", f"""{_S} SELECT rec, seg_idx, 'failed: {{"vector":"[redacted]","id":"' || id || '"}}' AS message FROM seg""")
def _(spark, sf_dir):
    m = F.concat(F.lit('failed: {"vector":[0.1, 2,'), F.col("seg_idx").cast("string"), F.lit('],"id":"'), "id", F.lit('"}'))
    return segments(spark, sf_dir).select("rec", "seg_idx", Q.redacted_message(m).alias("message"))


@query("redact_public", f"""{_S} SELECT rec, seg_idx, '{{"id":"' || id || '","inner":{{"n":' || seg_idx || '}},"items":[{{"k":' || rec || '}}]}}' AS doc FROM seg""")
def _(spark, sf_dir):
    vec = F.array(F.lit(0.5)).alias("prototype")
    s = segments(spark, sf_dir).select("rec", "seg_idx", F.struct("id", vec, F.lit(1).alias("_secret"), F.struct(F.col("seg_idx").alias("n"), F.lit("x").alias("cacheIdentity")).alias("inner"), F.array(F.struct(F.col("rec").alias("k"), F.array(F.lit(1.0)).alias("Embedding"))).alias("items")).alias("doc"))
    return Q.redacted(s).select("rec", "seg_idx", F.to_json("doc").alias("doc"))


@query("reindex_segments", f"{_S} SELECT rec, seg_idx AS was, row_number() OVER (PARTITION BY rec ORDER BY start_ms DESC) - 1 AS seg_idx, printf('seg_%04d', row_number() OVER (PARTITION BY rec ORDER BY start_ms DESC)) AS id FROM seg")
def _(spark, sf_dir):
    s = segments(spark, sf_dir).withColumns({"was": F.col("seg_idx"), "neg": -F.col("start_ms")})
    return rendering.reindexed(s, ["neg"]).select("rec", "was", "seg_idx", "id")


@query("merge_chunks", f"{_S} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY seg_idx // 3, seg_idx) - 1 AS seg_idx, start_ms % 15000 + seg_idx // 3 * 300000 AS start_ms, start_ms % 15000 + end_ms - start_ms + seg_idx // 3 * 300000 AS end_ms FROM seg")
def _(spark, sf_dir):
    chunk = F.floor(F.col("seg_idx") / 3)
    local = F.col("start_ms") % 15000
    s = segments(spark, sf_dir).select("rec", F.col("seg_idx").alias("pos"), (chunk * 300000).alias("offset_ms"), local.alias("start_ms"), (local + F.col("end_ms") - F.col("start_ms")).alias("end_ms"))
    return rendering.merged_chunks(s).select("rec", "seg_idx", "start_ms", "end_ms")


@query("default_segment", f"{_S}, g AS (SELECT rec, count(*) FILTER (WHERE speaker = 'system') AS n FROM seg GROUP BY rec) SELECT rec, greatest(n, 1) AS n_segments, n = 0 AS made_up FROM g")
def _(spark, sf_dir):
    one = F.struct("id", F.col("start_ms"), F.col("end_ms"), "text")
    t = segments(spark, sf_dir).groupBy("rec").agg(F.collect_list(F.when(F.col("speaker") == "system", one)).alias("segments"), F.max("text").alias("text"))
    made = rendering.default_segments(t)
    return made.select("rec", F.size("segments").cast("long").alias("n_segments"), F.col("segments")[0]["end_ms"].isNull().alias("made_up"))


@query("transcript_text", f"{_S} SELECT rec, string_agg({_CLEAN.format('text')}, ' ' ORDER BY seg_idx) AS text FROM seg WHERE {_CLEAN.format('text')} <> '' GROUP BY rec")
def _(spark, sf_dir):
    return rendering.transcript_text(segments(spark, sf_dir))


@query("render_markdown", f"""{_S} SELECT rec, '# 本地转写' || chr(10) || chr(10) || '- 任务：task_' || rec || chr(10) || '- 音频：/audio/' || rec || '.wav' || chr(10) || '- 片段数：' || count(*) || chr(10) || chr(10) || string_agg('### [' || printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || '] ' || CASE WHEN seg_idx % 5 = 4 THEN '未知说话人' ELSE speaker END || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY seg_idx) AS markdown FROM seg GROUP BY rec""")
def _(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("speaker", F.when(F.col("seg_idx") % 5 != 4, F.col("speaker")))
    tasks = s.select("rec").distinct().select("rec", F.concat(F.lit("task_"), "rec").alias("task_id"), F.concat(F.lit("/audio/"), "rec", F.lit(".wav")).alias("audio_path"))
    return rendering.markdown(s, tasks)


_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("render_srt", f"""{_S}, t AS (SELECT rec, seg_idx, speaker, text, CASE WHEN seg_idx % 4 = 3 THEN seg_idx * 5000 ELSE start_ms END AS s, CASE WHEN seg_idx % 4 = 3 OR seg_idx % 4 = 1 THEN seg_idx * 5000 + 5000 ELSE end_ms END AS e FROM seg)
SELECT rec, string_agg((seg_idx + 1) || chr(10) || {_CLOCK.format('s')} || ' --> ' || {_CLOCK.format('e')} || chr(10) || CASE WHEN seg_idx % 5 = 4 THEN '未知说话人' ELSE speaker END || '：' || coalesce(text, '') || chr(10), chr(10) ORDER BY seg_idx) AS subtitles FROM t GROUP BY rec""")
def _(spark, sf_dir):
    timed = F.col("seg_idx") % 4 != 3
    end = F.when(F.col("seg_idx") % 4 == 1, F.col("start_ms")).when(timed, F.col("end_ms"))
    return rendering.subtitles(segments(spark, sf_dir).withColumns({"start_ms": F.when(timed, F.col("start_ms")), "end_ms": end, "speaker": F.when(F.col("seg_idx") % 5 != 4, F.col("speaker"))}))


@query("read_page", f"{_S}, n AS (SELECT rec, seg_idx, id, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) - 1 AS k, count(*) OVER (PARTITION BY rec) AS total FROM seg) SELECT rec, seg_idx, id, total, total > 4 AS has_more FROM n WHERE k BETWEEN 1 AND 3")
def _(spark, sf_dir):
    return reads.page(segments(spark, sf_dir), 1, 3).select("rec", "seg_idx", "id", "total", "has_more")


@query("search_transcript", f"""{_S}, i AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) - 1 AS "index" FROM seg), h AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) AS k FROM i WHERE contains(lower(coalesce(text, '')), 'the') OR speaker = 'system'), l AS (SELECT * FROM h WHERE k <= 2) SELECT rec, seg_idx, "index", count(*) OVER (PARTITION BY rec) AS n_matches FROM l""")
def _(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("person_id", F.concat(F.lit("person_"), "speaker"))
    return reads.search(s, " The", "person_system", 2).select("rec", "seg_idx", "index", "n_matches")


@query("read_transcripts", f"""{_S}, {{_REQ}}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) - 1 AS k, rec IN (SELECT rec FROM req) AS asked FROM seg), c AS (SELECT *, CASE WHEN asked THEN (rec, id) IN (SELECT (rec, id) FROM req) ELSE k BETWEEN 1 AND 3 END AS hit FROM n),
g AS (SELECT rec, count(*) AS total_segments, count(*) FILTER (WHERE hit) AS returned_segments, bool_or(asked) AS asked, string_agg(text, chr(10) ORDER BY seg_idx) FILTER (WHERE hit AND text <> '') AS lines FROM c GROUP BY rec)
SELECT rec, CASE WHEN returned_segments = total_segments THEN 'whole' ELSE coalesce(lines, '') END AS text, CASE WHEN returned_segments = total_segments THEN 'full' ELSE 'selected_segments' END AS text_scope, total_segments, 1 AS "offset", returned_segments, NOT asked AND 1 + returned_segments < total_segments AS has_more FROM g""".replace("{_REQ}", "req AS (SELECT conv_id AS rec, printf('seg_%04d', turn * 2 + 1) AS id FROM conversations WHERE conv_id % 3 <> 0 AND turn < 3)"))
def _(spark, sf_dir):
    s = segments(spark, sf_dir)
    return reads.transcripts(s.select("rec", F.lit("whole").alias("text")).distinct(), s, _requests(spark, sf_dir), 1, 3, include_text=True)


_REQ = "req AS (SELECT conv_id AS rec, printf('seg_%04d', turn * 2 + 1) AS id FROM conversations WHERE conv_id % 3 <> 0 AND turn < 3)"


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("conv_id % 3 <> 0 and turn < 3").select(F.col("conv_id").alias("rec"), F.format_string("seg_%04d", F.col("turn") * 2 + 1).alias("id"))


@query("read_by_ids", f"{_S}, {_REQ} SELECT rec, id FROM seg WHERE (rec, id) IN (SELECT (rec, id) FROM req) OR rec NOT IN (SELECT rec FROM req)")
def _(spark, sf_dir):
    return P.requested_segments(_requests(spark, sf_dir), segments(spark, sf_dir)).select("rec", "id")


@query("missing_ids", f"{_S}, {_REQ} SELECT rec, id FROM req WHERE (rec, id) NOT IN (SELECT (rec, id) FROM seg)")
def _(spark, sf_dir):
    return P.missing_requests(_requests(spark, sf_dir), segments(spark, sf_dir))


@query("url_allowed", r"""SELECT page_id, regexp_extract(lower(url), '^https://([^/?#:@]+)', 1) IN ('tionsh.example.net', 'example.org') OR regexp_extract(lower(url), '^https://([^/?#:@]+)', 1) LIKE '%.example.org' OR regexp_extract(lower(url), '^https://([^/?#:@]+)', 1) LIKE '%.tionsh.example.net' AS allowed, regexp_replace(url, '[?#].*$', '') AS redacted FROM pages""")
def _(spark, sf_dir):
    hosts = ("tionsh.example.net", "example.org")
    return table(spark, sf_dir, "pages").select("page_id", manifests.url_allowed(F.col("url"), hosts).alias("allowed"), manifests.url_redacted(F.col("url")).alias("redacted"))


@query("task_status", f"{_S} SELECT rec::VARCHAR AS task_id, CASE WHEN rec % 2 = 0 THEN 'completed' ELSE 'running' END AS status, status AS stage, true AS partial_available, 0 AS n_warnings, true AS no_audio, CASE WHEN rec % 2 = 0 THEN 100 ELSE 0 END AS percent, substr(string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx), 1, 1200) AS preview, length(string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx)) AS n_chars, count(*) AS n_segments FROM seg GROUP BY rec")
def _(spark, sf_dir):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    t = segments(spark, sf_dir).groupBy(F.col("rec").cast("string").alias("task_id")).agg(joined.alias("text"), F.count("*").alias("n_segments"))
    out = reads.task_status(t.withColumns({"status": F.when(F.col("task_id").cast("long") % 2 == 0, F.lit("completed")).otherwise(F.lit("running")), "percent": F.lit(None).cast("int")}))
    return out.select("task_id", "status", "stage", "percent", "preview", "n_chars", "n_segments", "partial_available", F.size("warnings").alias("n_warnings"), F.col("audio").isNull().alias("no_audio"))


@query("asr_mock")
def _(spark, sf_dir):
    from parley.functions.processes import transcribe

    audio = segments(spark, sf_dir).groupBy("rec").agg(F.max("end_ms").alias("duration_ms"))
    return transcribe(audio)
