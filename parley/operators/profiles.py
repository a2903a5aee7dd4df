"""Speaker profiles: an append-only log of learned samples, corrections, rollback.

samples has seq (order), learning_id, person_id, name, v; rollbacks has learning_id
and seq. A profile is a fold of a person's last samples that were not rolled back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.clustering import prototypes

#: Samples that a profile keeps, and what learning takes at least.
KEPT_SAMPLES = 16
LEAST_PURITY, LEAST_SECONDS, LEAST_WINDOWS = 0.8, 1.5, 2


def kept_samples(samples: DataFrame, most: int = KEPT_SAMPLES) -> DataFrame:
    """Each person's last samples."""
    order = Window.partitionBy("person_id").orderBy(F.desc("seq"))
    return samples.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= most).drop("__k")


def profiles(samples: DataFrame, most: int = KEPT_SAMPLES) -> DataFrame:
    """person_id, name, n_samples, updated_seq and prototype of every person with samples."""
    kept = kept_samples(samples, most)
    info = kept.groupBy("person_id").agg(F.max_by("name", "seq").alias("name"), F.count("*").alias("n_samples"), F.max("seq").alias("updated_seq"))
    return info.join(prototypes(kept.withColumn("key", F.col("learning_id")), ["person_id"]).drop("size"), "person_id")


def rolled_back(samples: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """samples without those of rolled-back learning events; rolling back twice changes nothing."""
    return samples.join(rollbacks.select("learning_id").distinct(), "learning_id", "left_anti")


def rollback_log(rollbacks: DataFrame) -> DataFrame:
    """learning_id and the first time it was rolled back."""
    return rollbacks.groupBy("learning_id").agg(F.min("seq").alias("rolled_back_seq"))


def public_profiles(samples: DataFrame) -> DataFrame:
    """What may be listed: no vectors. Candidate samples are never collected, so their number is 0."""
    return profiles(samples).select("person_id", "name", "n_samples", F.lit(0).cast("long").alias("n_candidates"), "updated_seq")


def cluster_of(cluster: Column, speaker: Column) -> Column:
    """A segment's cluster: its own, else its speaker if that names one."""
    return F.coalesce(F.when(cluster.rlike(r"^cluster_[A-Za-z0-9_-]+$"), cluster), F.when(speaker.startswith("cluster_"), speaker))


def corrected(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """segments with speaker and person_id of a correction, and corrected.

    requests has rec, seg_idx, person_id, name: one person a recording. Affected are the
    non-mixed segments that are requested or share a cluster with a requested
    non-mixed one; mixed segments never change.
    """
    own = segments.withColumn("__c", cluster_of(F.col("cluster"), F.col("speaker")))
    asked = requests.select("rec", "seg_idx", F.lit(True).alias("__asked"))
    who = requests.groupBy("rec").agg(F.min(F.struct("person_id", "name")).alias("__who"))
    marked = own.join(asked.distinct(), ["rec", "seg_idx"], "left").join(who, "rec", "left")
    clusters = marked.filter("__asked and not mixed and __c is not null").select("rec", "__c").distinct().withColumn("__named", F.lit(True))
    all_rows = marked.join(clusters, ["rec", "__c"], "left")
    hit = ~F.col("mixed") & (F.coalesce("__asked", F.lit(False)) | F.coalesce("__named", F.lit(False)))
    return all_rows.withColumns({"speaker": F.when(hit, F.col("__who.name")).otherwise(F.col("speaker")), "person_id": F.when(hit, F.col("__who.person_id")), "corrected": hit}).drop("__c", "__asked", "__named", "__who")


def missing_requests(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Requested ids that the recording has not."""
    return requests.join(segments.select("rec", "id"), ["rec", "id"], "left_anti")


def requested_segments(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """The requested segments; a recording that requests none gets all."""
    some = requests.select(F.col("rec").alias("__rec")).distinct()
    asked = segments.join(requests.select("rec", "id").distinct(), ["rec", "id"], "left_semi")
    whole = segments.join(some, segments["rec"] == some["__rec"], "left_anti")
    return asked.unionByName(whole.select(asked.columns))


def eligible_segments(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """The segments that may be learned from: one known speaker, pure or of unknown purity, of a trusted cluster that isn't transient.

    segments has rec, cluster, speaker, mixed and purity; clusters has rec, cluster, trusted and stability.
    """
    pure = F.col("purity").isNull() | F.isnan("purity") | (F.col("purity") >= LEAST_PURITY)
    fit = segments.filter(~F.coalesce("mixed", F.lit(False)) & (F.coalesce("speaker", F.lit("")) != "unknown") & pure)
    stable = clusters.filter(F.coalesce("trusted", F.lit(False)) & (F.coalesce("stability", F.lit("")) != "transient")).select("rec", "cluster").distinct()
    return fit.join(stable, ["rec", "cluster"], "left_semi")


def learning_evidence(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """rec, seconds of the eligible segments, windows of the distinct clusters they name, and whether that is enough to learn from.

    Every recording of segments gets a row. segments also has start_ms and end_ms, clusters n_windows.
    """
    fit = eligible_segments(segments, clusters)
    length = F.greatest(F.lit(0), F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    seconds = fit.groupBy("rec").agg((F.sum(length) / 1000).alias("seconds"))
    windows = clusters.join(fit.select("rec", "cluster").distinct(), ["rec", "cluster"], "left_semi").groupBy("rec").agg(F.sum(F.greatest(F.lit(0), F.coalesce("n_windows", F.lit(0)))).alias("windows"))
    out = segments.select("rec").distinct().join(seconds, "rec", "left").join(windows, "rec", "left").select("rec", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("windows", F.lit(0)).alias("windows"), F.col("seconds").isNotNull().alias("eligible"))
    return out.withColumn("enough", F.col("eligible") & ((F.col("seconds") >= LEAST_SECONDS) | (F.col("windows") >= LEAST_WINDOWS)))


def learning_vectors(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """rec and prototype: the mean of the prototypes of the clusters that eligible segments name, weighted by windows.

    clusters also has v and n_windows; a weight of none is 1.
    """
    named = eligible_segments(segments, clusters).select("rec", "cluster").distinct()
    members = clusters.join(named, ["rec", "cluster"], "left_semi").withColumn("key", F.col("cluster").cast("string"))
    return prototypes(members, ["rec"], F.greatest(F.lit(1.0), F.coalesce("n_windows", F.lit(1)).cast("double"))).select("rec", "prototype")
