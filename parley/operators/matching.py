"""Matching vectors to known profiles, and lookups of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.vectors import as_text, cosine, unit, valid

#: Least score of a match and least lead over the runner-up.
THRESHOLD, MARGIN = 0.62, 0.05
#: Profiles that go to every task (64 numbers each make 5 MB); more are compared in shuffled blocks of about as many.
BROADCAST_PROFILES = 10_000
#: Parts into which rows are dealt for each block.
PARTS = 32


def match_profiles(rows: DataFrame, keys: list[str], profiles: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """keys, person_id, name and score of each row's nearest profile, if near enough and clearly nearest.

    Every row is a query against all profiles. These are a counted, small table that
    every task gets, and rows don't move; or they come in blocks, and only the two best
    of each row leave a block. keys name a row.
    """
    known = profiles.select("person_id", "name", F.col("prototype").alias("__q"))
    count = profiles.count()
    if count <= BROADCAST_PROFILES:
        folded = F.broadcast(known.agg(F.collect_list(F.struct("person_id", "name", "__q")).alias("__all")))
        blocks = rows.join(folded)
    else:
        n = -(-count // BROADCAST_PROFILES)
        folded = known.groupBy(F.pmod(F.xxhash64("person_id"), F.lit(n)).alias("__block")).agg(F.collect_list(F.struct("person_id", "name", "__q")).alias("__all"))
        folded = folded.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("__part", F.col("__part").cast("long"))
        dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
        blocks = dealt.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__block", F.col("__block").cast("long")).join(folded, ["__block", "__part"])
    scores = F.transform("__all", lambda p: F.struct((-cosine(F.col("prototype"), p["__q"])).alias("s"), p["person_id"].alias("person_id"), p["name"].alias("name")))
    top = F.slice(F.array_sort(F.filter(scores, lambda x: x["s"].isNotNull())), 1, 2)
    best = blocks.select(*keys, top.alias("top"))
    if count > BROADCAST_PROFILES:
        best = best.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, 2).alias("top"))
    first, second = F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))
    ok = (-first["s"] >= threshold) & (second["s"].isNull() | (second["s"] - first["s"] >= margin))
    return best.filter(ok).select(*keys, first["person_id"].alias("person_id"), first["name"].alias("name"), (-first["s"]).alias("score"))


def apply_matches(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Segments with speaker, person_id and match kind by their cluster's match; mixed ones are never matched.

    matches has rec, cluster, person_id, name, score.
    """
    found = matches.select("rec", F.col("cluster").alias("speaker_cluster"), F.col("person_id").alias("__p"), F.col("name").alias("__n"), F.col("score").alias("__s"))
    known = ~F.coalesce("mixed", F.lit(False)) & F.col("__p").isNotNull()
    single = ~F.coalesce("mixed", F.lit(False)) & F.col("speaker_cluster").isNotNull()
    return segments.join(found, ["rec", "speaker_cluster"], "left").select(
        "rec", "seg_idx", F.when(known, F.col("__n")).when(F.col("mixed"), F.lit("mixed")).when(single, F.col("speaker_cluster")).otherwise(F.lit("unknown")).alias("speaker"),
        F.when(known, F.col("__p")).alias("person_id"), F.when(known, F.lit("known")).when(F.col("mixed"), F.lit("mixed")).when(single, F.lit("cluster")).otherwise(F.lit("unknown")).alias("kind"),
        F.when(single, F.col("speaker_cluster")).alias("cluster"), F.when(known, F.col("__s")).alias("confidence"),
    )


def mean_vectors(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and mean: the normalised mean of the vectors that have the first one's length."""
    good = rows.filter(valid(F.col("v")))
    first = good.groupBy(*by).agg(F.min(F.struct("key", F.size("v").alias("n")))["n"].alias("n"))
    coords = good.select(*by, F.size("v").alias("n"), F.posexplode("v").alias("pos", "x")).groupBy(*by, "n", "pos").agg(F.avg("x").alias("x"))
    return coords.join(first, [*by, "n"]).groupBy(*by).agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])).alias("mean"))


def floor_percentile(values: Column, fraction: float) -> Column:
    """The element at floor((n - 1) fraction) in order, without interpolation; -1 of nothing."""
    at = F.floor((F.size(values) - 1) * F.lit(float(fraction))).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1)))).otherwise(F.lit(-1.0))


def fingerprint(profiles: DataFrame) -> DataFrame:
    """16 hex digits of all profiles in order of their ids, and their number. The registry is one row's worth of text a person."""
    text = F.concat_ws("=", "person_id", "name", as_text(F.col("prototype")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("person_id", text.alias("t")))), lambda x: x["t"]), ";")
    return profiles.agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("fingerprint"), F.count("*").alias("n"))


def ordered_lookup(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of each requested id in request order (pos): the first of a repeated id, unknown ones left out.

    requests has rec and ids; its other columns are kept.
    """
    extra = [c for c in requests.columns if c not in ("rec", "ids")]
    wanted = requests.select("rec", *extra, F.posexplode("ids").alias("pos", "id"))
    first = wanted.withColumn("__k", F.row_number().over(Window.partitionBy("rec", "id").orderBy("pos"))).filter("__k = 1").drop("__k")
    return first.join(rows, ["rec", "id"])


def embedding_entries(rows: DataFrame, vector: str) -> DataFrame:
    """rows with id and vector, of those that have both."""
    return rows.withColumn("vector", F.col(vector)).filter(F.col("id").isNotNull() & (F.size("vector") > 0))
