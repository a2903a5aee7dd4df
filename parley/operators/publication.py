"""Quality of a speaker analysis, and what of it may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import canonical_cluster_id, lenient_cluster_id

#: The states of an analysis; the reason codes and limits of the quality functions are fixed too.
STATES = ("reliable", "degraded", "unusable")
#: Field names that never leave the engine, and the beginnings of private ones.
PRIVATE_NAMES = ("prototype", "embedding", "embeddings", "vector", "cacheidentity")


def segment_labels(votes: DataFrame) -> DataFrame:
    """Votes with speaker, kind (mixed, cluster, unknown) and the dominant cluster's id."""
    name = F.when(F.col("cluster") >= 0, F.format_string("cluster_%d", "cluster"))
    kind = F.when(F.col("mixed"), F.lit("mixed")).when(F.col("cluster") >= 0, F.lit("cluster")).otherwise(F.lit("unknown"))
    return votes.withColumns({"dominant": name, "kind": kind}).withColumn("speaker", F.when(F.col("kind") == "cluster", F.col("dominant")).otherwise(F.col("kind")))


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(condition, F.lit(code)) for condition, code in pairs)), lambda x: x.isNotNull())


def timeline_quality(spans: DataFrame, votes: DataFrame, counts: DataFrame) -> DataFrame:
    """Per recording: coverage and unknown share of the time, mixed share of the segments, reason codes and state.

    spans has start, end and shown; votes has mixed; counts has candidates, trusted and exceeded.
    """
    length = F.col("end") - F.col("start")
    time = spans.filter("end > start").groupBy("rec").agg(F.sum(length).alias("all"), F.sum(F.when(F.col("shown") >= 0, length).otherwise(0)).alias("known"), F.countDistinct("seg_idx").alias("scored"))
    mixed = votes.groupBy("rec").agg(F.count_if("mixed").alias("mixed"))
    q = counts.join(time, "rec", "left").join(mixed, "rec", "left").fillna(0, ["all", "known", "scored", "mixed"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    q = q.withColumns({"coverage": ratio("known", "all"), "unknown_ratio": F.when(F.col("all") > 0, (F.col("all") - F.col("known")) / F.col("all")).otherwise(F.lit(0.0)), "mixed_ratio": ratio("mixed", "scored")})
    some, none = F.col("candidates") > 0, F.col("trusted") == 0
    many = (F.col("candidates") > F.greatest(F.lit(24), F.col("trusted") * 4)) & ~none
    q = q.withColumn("codes", _codes((none & some, "no_trusted_speakers"), ((F.col("coverage") < 0.20) & some, "low_trusted_coverage"), (F.col("unknown_ratio") > 0.55, "high_unknown_ratio"), (F.col("mixed_ratio") > 0.40, "high_mixed_ratio"), (F.col("exceeded"), "speaker_count_exceeded"), (many, "excessive_private_candidates")))
    unusable = (none & some) | ((F.col("coverage") < 0.20) & none)
    return q.withColumn("state", F.when(unusable, F.lit("unusable")).when((F.col("coverage") < 0.55) | (F.col("unknown_ratio") > 0.35) | many, F.lit("degraded")).otherwise(F.lit("reliable")))


def normalized_clusters(rows: DataFrame, lenient: bool) -> DataFrame:
    """rows with cluster_id, trusted, strong and stability settled; trusted is tri-state on input.

    lenient picks the analyzer's reading of ids; without it only canonical ids stay.
    """
    evidence, voiced = F.greatest(F.lit(0), F.coalesce("evidence", F.lit(0))), F.col("voiced")
    enough = (evidence >= 3) | F.coalesce(voiced >= 3, F.lit(False))
    trusted = F.coalesce(F.col("trusted"), (F.coalesce("stability", F.lit("")) == "stable") & enough)
    strong = F.coalesce(F.col("strong"), trusted & ((evidence >= 6) | F.coalesce(voiced >= 6, F.lit(False))))
    source = F.coalesce(F.col("cluster_id"), F.when(trusted, F.col("idx").cast("string")))
    named = (lenient_cluster_id if lenient else canonical_cluster_id)(source)
    out = rows.withColumns({"__trusted": trusted, "__strong": strong, "__id": named, "evidence": evidence})
    out = out.withColumns({"trusted": F.col("__trusted"), "strong": F.col("__strong"), "cluster_id": F.col("__id"), "stability": F.when(F.col("__trusted"), F.lit("stable")).otherwise(F.lit("transient"))})
    return out.filter(F.col("cluster_id").isNotNull() | ~F.col("trusted")).drop("__trusted", "__strong", "__id")


def allowed_clusters(clusters: DataFrame, states: DataFrame) -> DataFrame:
    """The clusters that may be shown: none of an unusable analysis, of a degraded one the strong among the trusted."""
    fit = F.col("trusted") & (F.col("stability") == "stable") & F.col("cluster_id").isNotNull()
    return clusters.join(states.select("rec", "state"), "rec").filter(fit & (F.col("state") != "unusable") & ((F.col("state") != "degraded") | F.col("strong")))


def derived_quality(segments: DataFrame, clusters: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Quality where none is given: shares of the segments' number, reason codes, state; rounded.

    counts (rec, exceeded) says where there were more speakers than allowed. A
    recording of any of the tables gets a row; without segments its shares are 0.
    """
    recs = segments.select("rec").union(clusters.select("rec"))
    if counts is not None:
        recs = recs.union(counts.select("rec"))
    more = counts.select("rec", "exceeded") if counts is not None else recs.select("rec").distinct().withColumn("exceeded", F.lit(False))
    s = segments.groupBy("rec").agg(F.count("*").alias("n"), F.count_if(F.coalesce("mixed", F.lit(False)) | (F.col("speaker") == "mixed")).alias("m"), F.count_if(F.col("speaker") == "unknown").alias("u"))
    c = clusters.groupBy("rec").agg(F.count("*").alias("candidates"), F.count_if("trusted").alias("trusted"))
    share = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(F.lit(0.0))
    q = recs.distinct().join(s, "rec", "left").join(c, "rec", "left").join(more, "rec", "left").fillna(0, ["n", "m", "u", "candidates", "trusted"]).fillna(False, ["exceeded"]).withColumns({"unknown": share("u"), "mix": share("m")})
    none, some = F.col("trusted") == 0, F.col("candidates") > 0
    many = (F.col("candidates") > F.greatest(F.lit(24), F.col("trusted") * 4)) & ~none
    codes = _codes((none & some, "no_trusted_speakers"), (F.col("unknown") > 0.55, "high_unknown_ratio"), (F.col("mix") > 0.40, "high_mixed_ratio"), (F.col("exceeded"), "speaker_count_exceeded"), (many, "excessive_private_candidates"))
    state = F.when(none & some, F.lit("unusable")).when((F.col("unknown") > 0.35) | many, F.lit("degraded")).otherwise(F.lit("reliable"))
    return q.select("rec", "trusted", F.round(1 - F.col("unknown"), 6).alias("coverage"), F.round("unknown", 6).alias("unknown_ratio"), F.round("mix", 6).alias("mixed_ratio"), codes.alias("codes"), state.alias("state"))


def normalized_quality(rows: DataFrame) -> DataFrame:
    """state outside the known ones is reliable; ratios that are no finite number are 0; counts default to the trusted clusters'."""
    number = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).otherwise(F.lit(0.0))
    return rows.withColumns({"state": F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(F.lit("reliable")), "trusted_count": F.coalesce("trusted_count", "trusted"), **{c: number(c) for c in ("coverage", "unknown_ratio", "mixed_ratio")}})


def reconciled_quality(rows: DataFrame) -> DataFrame:
    """A reliable analysis with clusters of which none may be shown is unusable, with two reasons added; rows has sources and shown counts."""
    wrong = (F.col("state") == "reliable") & (F.col("sources") > 0) & (F.col("shown") == 0)
    added = F.array_union(F.col("codes"), F.array(F.lit("no_trusted_speakers"), F.lit("inconsistent_quality_summary")))
    return rows.withColumns({"codes": F.when(wrong, added).otherwise(F.col("codes")), "coverage": F.when(wrong, F.lit(0.0)).otherwise(F.col("coverage")), "state": F.when(wrong, F.lit("unusable")).otherwise(F.col("state"))})


def projected_segments(segments: DataFrame, allowed: DataFrame) -> DataFrame:
    """Segments with only allowed clusters named: speaker, dominant, kind, cluster and spans.

    segments has speaker, cluster, dominant, mixed and spans (array of speaker,
    confidence). The allowed clusters of a recording come as one array.
    """
    sets = allowed.groupBy("rec").agg(F.collect_set("cluster_id").alias("__ok"))
    none = F.array().cast("array<string>")
    s = segments.join(sets, "rec", "left").withColumn("__ok", F.coalesce("__ok", none))
    fine = lambda c: F.array_contains(F.col("__ok"), c)
    spans = F.transform("spans", lambda x: F.when(fine(x["speaker"]), x).otherwise(F.struct(F.lit("unknown").alias("speaker"), F.lit(0.0).alias("confidence"))))
    first = F.try_element_at(F.transform(F.filter("spans", lambda x: fine(x["speaker"])), lambda x: x["speaker"]), F.lit(1))
    mixed = F.coalesce("mixed", F.lit(False)) | (F.coalesce("speaker", F.lit("")) == "mixed")
    one = F.when(F.coalesce(fine(F.col("speaker")), F.lit(False)), F.col("speaker")).when(F.coalesce(fine(F.col("cluster")), F.lit(False)), F.col("cluster"))
    kept = F.when(F.coalesce(fine(F.col("dominant")), F.lit(False)), F.col("dominant"))
    return s.withColumns({
        "__mixed": mixed, "__one": one,
        "__dominant": F.when(mixed, F.coalesce(kept, first)).when(one.isNotNull(), F.coalesce(kept, one)), "__spans": spans,
    }).select("rec", "seg_idx", F.when(F.col("__mixed"), F.lit("mixed")).otherwise(F.coalesce("__one", F.lit("unknown"))).alias("speaker"), F.col("__dominant").alias("dominant"),
        F.when(~F.col("__mixed"), F.col("__one")).alias("cluster"), F.col("__mixed").alias("mixed"), F.col("__spans").alias("spans"))


def finalized(segments: DataFrame, clusters: DataFrame, counts: DataFrame | None = None, quality: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments, clusters and quality that may be shown of an analysis.

    clusters are settled first; quality (rec, state, codes, trusted, coverage,
    unknown_ratio, mixed_ratio) is derived where it isn't given; it is reconciled with
    what it lets be shown, and then decides what is shown. Of an unusable analysis the
    coverage is 0.
    """
    known = normalized_clusters(clusters, lenient=True)
    first = derived_quality(segments, known, counts) if quality is None else quality
    count = lambda df, name: df.groupBy("rec").agg(F.count("*").alias(name))
    rows = first.join(count(known, "sources"), "rec", "left").join(count(allowed_clusters(known, first), "shown"), "rec", "left").fillna(0, ["sources", "shown"])
    settled = reconciled_quality(rows).drop("sources", "shown").withColumn("coverage", F.when(F.col("state") == "unusable", F.lit(0.0)).otherwise(F.col("coverage")))
    shown = allowed_clusters(known, settled)
    return projected_segments(segments, shown), shown, settled


def redacted(rows: DataFrame) -> DataFrame:
    """rows without private fields, at any depth of structs and arrays of structs."""
    from pyspark.sql import types as T

    hidden = lambda name: name.startswith("_") or name.lower() in PRIVATE_NAMES

    def strip(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind if not hidden(f.name)]
            return F.when(value.isNotNull(), F.struct(*(strip(value[f.name], f.dataType).alias(f.name) for f in kept))) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType):
            return F.transform(value, lambda x: strip(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            kept = F.map_filter(value, lambda k, _: ~(k.startswith("_") | F.lower(k).isin(*PRIVATE_NAMES)))
            return F.transform_values(kept, lambda _, v: strip(v, kind.valueType)) if isinstance(kind.valueType, T.StructType | T.ArrayType | T.MapType) else kept
        return value

    return rows.select(*(strip(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema if not hidden(f.name)))


def redacted_message(text: Column) -> Column:
    """A message with the numbers of vectors taken out."""
    return F.regexp_replace(text, r'(?i)"(prototype|embedding|embeddings|vector)"\s*:\s*\[[^\]]*\]', '"$1":"[redacted]"')
