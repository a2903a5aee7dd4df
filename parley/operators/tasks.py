"""Task state, chunks, caches and leases as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.scalars import hash_of, progress, valid_id

#: States of a task.
ACTIVE = ("queued", "running")
TERMINAL = ("completed", "failed", "cancelled", "interrupted")
#: Defaults of a request, seconds of a long poll by default and at most, and until the next one.
LANGUAGE, OUTPUT_FORMAT = "auto", "markdown"
POLL_SECONDS, MOST_POLL_SECONDS, RETRY_MS = 45, 50, 500


def latest_status(events: DataFrame) -> DataFrame:
    """task_id, status, seq of each task's last event; task_id, seq, status are read. Sums before the exchange."""
    return events.groupBy("task_id").agg(F.max(F.struct("seq", "status")).alias("x")).select("task_id", "x.status", "x.seq")


def recovered(tasks: DataFrame, live: DataFrame) -> DataFrame:
    """tasks where active ones without a live lease are interrupted; ids that are none go."""
    leased = live.select("task_id").distinct().withColumn("__live", F.lit(True))
    lost = F.col("status").isin(*ACTIVE) & F.col("__live").isNull()
    return tasks.filter(valid_id("task", F.col("task_id"))).join(leased, "task_id", "left").withColumns({"recovered": lost, "status": F.when(lost, F.lit("interrupted")).otherwise(F.col("status"))}).drop("__live")


def live_leases(leases: DataFrame, now: Column, stale: int) -> DataFrame:
    """leases (alive, beat) that hold: the process lives, or the last beat is fresh."""
    return leases.filter(F.coalesce("alive", F.lit(False)) | (now - F.col("beat") <= stale))


def first_starts(starts: DataFrame) -> DataFrame:
    """Of equal starts (request_key) the first stays."""
    order = Window.partitionBy("request_key").orderBy("seq")
    return starts.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def chunk_plan(tasks: DataFrame) -> DataFrame:
    """task_id, chunk, offset_s, chunk_s: tumbling chunks over a duration.

    A wish of 60 seconds or more is taken up to 300; without one, less free memory
    means shorter chunks. tasks has duration_s, wish_s, free_gb.
    """
    size = F.when(F.col("wish_s") >= 60, F.least(F.lit(300), F.floor("wish_s"))).when(F.col("free_gb") < 6, 90).when(F.col("free_gb") < 10, 120).otherwise(300).cast("int")
    sized = tasks.withColumn("chunk_s", size)
    last = F.greatest(F.lit(1), F.ceil(F.col("duration_s") / F.col("chunk_s"))).cast("int") - 1
    return sized.select("task_id", F.explode(F.sequence(F.lit(0), last)).alias("chunk"), "chunk_s").withColumn("offset_s", F.col("chunk") * F.col("chunk_s"))


def halved(chunks: DataFrame, depth: int = 2, least: int = 60) -> DataFrame:
    """chunks with the parts that remain after failing ones (fails: how often in a row) were split into halves, at most depth times."""
    rows = chunks.select("task_id", "offset_s", F.col("chunk_s").alias("size_s"), F.col("chunk_s").alias("length_s"), "fails", F.lit(0).alias("depth"))
    for level in range(depth):
        half = F.greatest(F.lit(least), F.floor(F.col("size_s") / 2)).cast("int")
        splits = (F.col("fails") > level) & (F.col("depth") == level) & (half < F.col("length_s"))
        parts = F.when(splits, F.sequence(F.lit(0), F.ceil(F.col("length_s") / half).cast("int") - 1)).otherwise(F.array(F.lit(0)))
        rows = rows.withColumns({"__half": half, "__split": splits}).select("*", F.explode(parts).alias("__i"))
        at = F.col("__i") * F.col("__half")
        rows = rows.select(
            "task_id", F.when(F.col("__split"), F.col("offset_s") + at).otherwise(F.col("offset_s")).alias("offset_s"), F.when(F.col("__split"), F.col("__half")).otherwise(F.col("size_s")).alias("size_s"),
            F.when(F.col("__split"), F.least(F.col("__half"), F.col("length_s") - at)).otherwise(F.col("length_s")).cast("int").alias("length_s"), "fails", F.when(F.col("__split"), level + 1).otherwise(F.col("depth")).alias("depth"),
        )
    return rows.select("task_id", "offset_s", "length_s", "depth")


def remaining(planned: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """What of the plan no checkpoint has yet."""
    return planned.join(done.select(*by).distinct(), by, "left_anti")


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """task_id, chunk, done, percent after each finished chunk; chunks has total."""
    done = F.row_number().over(Window.partitionBy("task_id").orderBy("chunk"))
    return chunks.withColumn("done", done).withColumn("percent", progress(F.col("done"), F.col("total")))


def best_checkpoint(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (task_id, asr_key) one checkpoint of the key: its own, else that of most chunks, then the newest."""
    w = wanted.select(F.col("task_id").alias("wanted_by"), "asr_key")
    order = Window.partitionBy("wanted_by").orderBy(F.desc(F.col("task_id") == F.col("wanted_by")), F.desc("n_chunks"), F.desc("updated"), "task_id")
    return w.join(checkpoints, "asr_key").withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def cache_lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (stage, key) with the result of the newest valid entry, and hit."""
    good = entries.filter(F.col("key").rlike("^[a-f0-9]{64}$") & F.col("stage").isin("asr", "speaker"))
    newest = good.groupBy("stage", "key").agg(F.max(F.struct("created", "result")).alias("x"))
    return wanted.join(newest, ["stage", "key"], "left").select("stage", "key", F.col("x.result").alias("result"), F.col("x").isNotNull().alias("hit"))


def stage_keys(identities: DataFrame) -> DataFrame:
    """task_id, asr_key, speaker_key: the second chains the first; null where what they depend on isn't ready.

    Paths of models, thresholds of matching and profiles take no part.
    """
    asr = hash_of(F.struct(F.lit("asr").alias("stage"), F.col("source"), F.col("asr_model"), F.col("chunk_s")))
    keyed = identities.withColumn("asr_key", F.when(F.col("asr_model").isNotNull(), asr))
    speaker = hash_of(F.struct(F.lit("speaker").alias("stage"), F.col("asr_key"), F.col("speaker_model"), F.col("window_ms")))
    return keyed.select("task_id", "asr_key", F.when(F.col("asr_key").isNotNull() & F.col("speaker_model").isNotNull(), speaker).alias("speaker_key"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """user_id, session, first, last, n: runs of events less than gap seconds apart; events has user_id and at."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    opens = F.coalesce((F.col("at") - F.lag("at").over(order) >= gap).cast("int"), F.lit(1))
    numbered = events.withColumn("__o", opens).withColumn("session", F.sum("__o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def settled_options(requests: DataFrame) -> DataFrame:
    """requests with language, output_format and speaker_profile settled: empty ones by default, profiles unless refused."""
    return requests.withColumns({
        "language": F.coalesce(F.nullif("language", F.lit("")), F.lit(LANGUAGE)),
        "output_format": F.coalesce(F.nullif("output_format", F.lit("")), F.lit(OUTPUT_FORMAT)),
        "speaker_profile": F.coalesce("speaker_profile", F.lit(True)),
    })


def cache_identities(tasks: DataFrame, asr: dict, speaker: dict, versions: dict) -> DataFrame:
    """tasks with identity, a record of all that a result depends on, and cache_key, its hash.

    tasks has audio_path, size, modified_ms, language, output_format, speaker_profile
    and profiles_fingerprint. asr and speaker are settings by name, versions has
    pipeline, asr and speaker; the speaker's part is empty where profiles are refused.
    """
    on = F.col("speaker_profile")
    given = lambda values: [F.lit(v).alias(k) for k, v in values.items()]
    source = F.struct("audio_path", "size", F.col("modified_ms").alias("mtime_ms"))
    mine = F.struct(on.alias("enabled"), *(F.when(on, F.lit(v)).alias(k) for k, v in {"version": versions["speaker"], **speaker}.items()), F.when(on, F.col("profiles_fingerprint")).alias("profiles_fingerprint"))
    identity = F.struct(F.lit(versions["pipeline"]).alias("version"), source.alias("source"), F.struct(F.lit(versions["asr"]).alias("version"), "language", *given(asr)).alias("asr"), mine.alias("speaker"), F.struct("output_format").alias("render"))
    return tasks.withColumn("identity", identity).withColumn("cache_key", hash_of(F.col("identity")))


def runtime_identities(binaries: DataFrame, companions: DataFrame) -> DataFrame:
    """name, source, sha256, companions (name and sha256 in order of names) and runtime_key, a hash of all, of each program.

    binaries has name, source, sha256; companions has of (a program's name), name and
    sha256 of the files that stand beside it and belong to it.
    """
    beside = companions.groupBy(F.col("of").alias("name")).agg(F.array_sort(F.collect_set(F.struct("name", "sha256"))).alias("companions"))
    none = F.array().cast("array<struct<name:string,sha256:string>>")
    out = binaries.join(beside, "name", "left").withColumn("companions", F.coalesce("companions", none))
    return out.withColumn("runtime_key", hash_of(F.struct("source", "name", "sha256", "companions")))


def queued(tasks: DataFrame, lane: str = "lane") -> DataFrame:
    """tasks with started and ended where each lane works on one task at a time, in order of arrival.

    tasks has the lane, at (arrival) and duration; ties go by task_id. A task starts
    when it has arrived and the one before has ended: of a sum of durations, the
    greatest start that any task before allows. A window of one lane holds its queue.
    """
    order = Window.partitionBy(lane).orderBy("at", "task_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = tasks.withColumn("__sum", F.sum("duration").over(order))
    free = F.max(F.col("at") - (F.col("__sum") - F.col("duration"))).over(order)
    return summed.withColumn("ended", free + F.col("__sum")).withColumn("started", F.col("ended") - F.col("duration")).drop("__sum")


def long_polls(polls: DataFrame, events: DataFrame) -> DataFrame:
    """polls (poll_id, task_id, at, wait_s) with answered_at, status, timed_out and retry_ms.

    A poll is answered when its task reaches a final state, at once if it had, or after
    its wait (0 to 50 seconds, 45 unless given) with the state of then. events has
    task_id, at, seq and status; a task that has no event yet has status null.
    """
    wait = F.least(F.lit(MOST_POLL_SECONDS), F.greatest(F.lit(0), F.coalesce("wait_s", F.lit(POLL_SECONDS))))
    asked = polls.withColumn("__until", F.col("at") + wait)
    happened = events.select("task_id", F.col("at").alias("__at"), F.col("seq").alias("__seq"), F.col("status").alias("__status"))
    seen = asked.select("poll_id", "task_id", F.col("at").alias("__from"), "__until").join(happened, "task_id").filter(F.col("__at") <= F.col("__until"))
    final = F.col("__status").isin(*TERMINAL)
    state = lambda when: F.max(F.when(when, F.struct("__at", "__seq", "__status")))["__status"]
    per = seen.groupBy("poll_id").agg(
        state(F.col("__at") <= F.col("__from")).alias("__then"), F.min(F.when(final & (F.col("__at") > F.col("__from")), F.struct("__at", "__seq", "__status"))).alias("__end"), state(F.lit(True)).alias("__last"))
    out = asked.join(per, "poll_id", "left")
    at_once = F.coalesce(F.col("__then").isin(*TERMINAL), F.lit(False))
    ends = F.col("__end").isNotNull()
    timed = ~at_once & ~ends
    return out.select(*polls.columns, F.when(at_once, F.col("at")).when(ends, F.col("__end.__at")).otherwise(F.col("__until")).alias("answered_at"), F.when(at_once, F.col("__then")).when(ends, F.col("__end.__status")).otherwise(F.col("__last")).alias("status"), timed.alias("timed_out"), F.when(timed, RETRY_MS).alias("retry_ms"))


def partial_results(chunks: DataFrame) -> DataFrame:
    """task_id, done, covered_s and text of the chunks that are finished, in order; chunks has offset_s, chunk_s and text."""
    parts = F.array_sort(F.collect_list(F.struct("offset_s", F.trim(F.coalesce("text", F.lit(""))).alias("t"))))
    text = F.array_join(F.transform(F.filter(parts, lambda x: x["t"] != ""), lambda x: x["t"]), " ")
    return chunks.groupBy("task_id").agg(F.count("*").alias("done"), F.sum("chunk_s").alias("covered_s"), text.alias("text"))


def response_lines(results: DataFrame) -> DataFrame:
    """value, a line of JSON for each of results (id, result as JSON text, code, message); code makes it an error, whose message is redacted."""
    from parley.operators.publication import redacted_message

    version, own = F.lit("2.0").alias("jsonrpc"), F.col("id")
    error = F.struct(version, own, F.struct("code", redacted_message(F.coalesce("message", F.lit(""))).alias("message")).alias("error"))
    good = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.regexp_extract(F.to_json(F.struct(own), {"ignoreNullFields": "false"}), r'^\{"id":(.*)\}$', 1), F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    return results.select(F.when(F.col("code").isNull(), good).otherwise(F.to_json(error, {"ignoreNullFields": "false"})).alias("value"))


class Log:
    """An append-only table under a path: rows of the newest entry count, and a cleared one counts as none."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def add(self, rows: DataFrame) -> None:
        """rows has the keys, an order column seq, and values."""
        rows.withColumn("cleared", F.lit(False)).write.mode("append").parquet(self.path)

    def clear(self, keys: DataFrame, seq: int) -> None:
        keys.select(*self.keys).distinct().withColumns({"seq": F.lit(seq).cast("long"), "cleared": F.lit(True)}).write.mode("append").parquet(self.path)

    def live(self) -> DataFrame:
        """The newest entry of each key that wasn't cleared after; sums before the exchange."""
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path)
        values = [c for c in rows.columns if c not in (*self.keys, "seq", "cleared")]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct("seq", "cleared", *values)).alias("x"))
        return last.filter("not x.cleared").select(*self.keys, "x.seq", *(F.col(f"x.{v}").alias(v) for v in values))


def checkpoint_log(spark: SparkSession, path: str) -> Log:
    """Checkpoints of tasks: task_id, asr_key, n_chunks, chunks; cleared when a task has ended."""
    return Log(spark, path, ["task_id"])


def cache_log(spark: SparkSession, path: str) -> Log:
    """Results of stages: stage, key, result."""
    return Log(spark, path, ["stage", "key"])
