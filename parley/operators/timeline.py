"""From labelled analysis windows to a smoothed speaker timeline, in window functions.

Rows are labelled windows: rec, seg_idx, key, start_ms, end_ms, seg_start, seg_end,
label (-1: none), stability (stable, transient or unknown) and score. A window
partition is one segment, or one recording's spans in time order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOUCH = 1e-6


@dataclass(frozen=True)
class TimelineOptions:
    """Fixed values, in milliseconds: what is noise, what can be bridged, and which gap is small."""

    noise_ms: float = 400
    bridge_ms: float = 1500
    gap_ms: float = 500
    isolated_ms: float = 1000


DEFAULT = TimelineOptions()


def analysis_windows(segments: DataFrame, window_ms: int = 1500, shift_ms: int = 750, least_ms: int = 250) -> DataFrame:
    """rec, seg_idx, key, start_ms, end_ms: windows over each segment, every shift and one at its tail."""
    length = F.col("end_ms") - F.col("start_ms")
    full = F.transform(F.sequence(F.lit(0), F.floor((length - window_ms) / shift_ms).cast("int")), lambda i: i.cast("long") * shift_ms)
    starts = F.when(length <= window_ms, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(full, F.array((length - window_ms).cast("long")))))
    each = segments.filter(length >= least_ms).select("rec", "seg_idx", "id", "start_ms", "end_ms", F.posexplode(starts).alias("i", "at"))
    return each.select("rec", "seg_idx", F.format_string("%s:w%d", "id", "i").alias("key"), (F.col("start_ms") + F.col("at")).alias("start_ms"), F.least("end_ms", F.col("start_ms") + F.col("at") + window_ms).alias("end_ms"))


def voronoi(windows: DataFrame) -> DataFrame:
    """rec, seg_idx, key, start, end, cluster, stability, confidence: each window's share of its segment, up to the middle between window centres."""
    centre = (F.col("start_ms") + F.col("end_ms")) / 2
    own = Window.partitionBy("rec", "seg_idx")
    order = own.orderBy("centre", "key", "start_ms", "end_ms", "label")
    declared = F.coalesce(F.col("seg_end") > F.col("seg_start"), F.lit(False))
    each = windows.withColumns({"centre": centre, "__low": F.when(declared, F.col("seg_start")).otherwise(F.col("start_ms")), "__high": F.when(declared, F.col("seg_end")).otherwise(F.col("end_ms"))})
    each = each.withColumns({"low": F.min("__low").over(own), "high": F.max("__high").over(own), "before": F.lag("centre").over(order), "after": F.lead("centre").over(order)})
    # Null at the ends: greatest and least would leave a null out.
    edge = lambda other: F.when(F.col(other).isNotNull(), F.greatest(F.col("low"), F.least(F.col("high"), (F.col(other) + F.col("centre")) / 2)))
    known = (F.col("label") >= 0) & (F.col("stability") != "unknown")
    score = F.when((F.col("label") >= 0) & F.col("score").isNotNull() & ~F.isnan("score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).otherwise(F.lit(0.0))
    return each.select(
        "rec", "seg_idx", "key", F.coalesce(edge("before"), F.col("low")).cast("double").alias("start"), F.coalesce(edge("after"), F.col("high")).cast("double").alias("end"),
        F.when(known, F.col("label")).otherwise(-1).alias("cluster"), F.when(known, F.col("stability")).otherwise(F.lit("unknown")).alias("stability"), score.alias("confidence"),
    ).filter("end > start")


def run_length(spans: DataFrame, by: list[str], same: list[str]) -> DataFrame:
    """by, same, key, start, end, confidence: neighbouring spans that touch and agree in ``same``, as one; confidence is weighted by length."""
    order = Window.partitionBy(*by).orderBy("start", "end", "key")
    opens = F.abs(F.lag("end").over(order) - F.col("start")) > _TOUCH
    for c in same:
        opens = opens | (F.lag(c).over(order) != F.col(c))
    marked = spans.withColumn("__new", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.col("end") - F.col("start")
    return marked.groupBy(*by, "__run", *same).agg(F.min("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), (F.sum(F.col("confidence") * length) / F.sum(length)).alias("confidence")).drop("__run")


def _global():
    return Window.partitionBy("rec").orderBy("start", "end", "key", "cluster", "seg_idx")


def islands(spans: DataFrame, o: TimelineOptions = DEFAULT) -> DataFrame:
    """spans with island: a number for each run of transient spans of one cluster with small gaps, null for others; and their total length."""
    order = _global()
    transient = F.col("stability") == "transient"
    goes_on = (F.lag("stability").over(order) == "transient") & (F.lag("cluster").over(order) == F.col("cluster")) & (F.greatest(F.lit(0.0), F.col("start") - F.lag("end").over(order)) <= o.gap_ms)
    marked = spans.withColumn("__opens", (transient & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = marked.withColumn("island", F.when(transient, F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__opens")
    total = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("rec", "island"))
    return numbered.withColumn("island_ms", F.when(transient, total))


def bridged(spans: DataFrame, o: TimelineOptions = DEFAULT) -> DataFrame:
    """islands' rows with shown (the cluster to present), fate (kept, noise, bridged or suppressed) and confidence."""
    order = _global()
    neighbour = F.struct("stability", "cluster", "start", "end", "confidence")
    near = spans.withColumns({"__l": F.lag(neighbour).over(order), "__r": F.lead(neighbour).over(order)})
    island = near.filter("island is not null").groupBy("rec", "island").agg(F.min_by("__l", F.struct("start", "end", "key")).alias("l"), F.max_by("__r", F.struct("start", "end", "key")).alias("r"), F.min("start").alias("first"), F.max_by("end", F.struct("start", "end", "key")).alias("last"), F.max("island_ms").alias("total"))
    fits = (F.col("l.stability") == "stable") & (F.col("r.stability") == "stable") & (F.col("l.cluster") >= 0) & (F.col("l.cluster") == F.col("r.cluster")) & (F.col("first") - F.col("l.end") <= o.gap_ms) & (F.col("r.start") - F.col("last") <= o.gap_ms)
    fate = F.when(F.col("total") < o.noise_ms, F.lit("noise")).when((F.col("total") <= o.bridge_ms) & F.coalesce(fits, F.lit(False)), F.lit("bridged")).otherwise(F.lit("suppressed"))
    fates = island.select("rec", "island", fate.alias("fate"), F.col("l.cluster").alias("__to"), ((F.col("l.confidence") + F.col("r.confidence")) / 2).alias("__mean"))
    return spans.join(fates, ["rec", "island"], "left").select(
        "rec", "seg_idx", "key", "start", "end", "cluster", "stability", F.coalesce("fate", F.lit("kept")).alias("fate"),
        F.when(F.col("fate").isNull(), F.col("cluster")).when(F.col("fate") == "bridged", F.col("__to")).otherwise(-1).alias("shown"),
        F.when(F.col("fate").isNull(), F.col("confidence")).when(F.col("fate") == "bridged", F.col("__mean")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def inherited(spans: DataFrame, o: TimelineOptions = DEFAULT) -> DataFrame:
    """bridged rows where short, still unknown transient spans take a stable neighbour's cluster: the left one's, else the right one's; none if they differ."""
    order = _global()

    def side(step, gap):
        ok = (step("stability").over(order) == "stable") & (step("shown").over(order) >= 0) & (F.greatest(F.lit(0.0), gap) <= o.gap_ms)
        return F.coalesce(ok, F.lit(False)), step("shown").over(order), step("confidence").over(order)

    left, lc, lf = side(F.lag, F.col("start") - F.lag("end").over(order))
    right, rc, rf = side(F.lead, F.lead("start").over(order) - F.col("end"))
    takes = (F.col("stability") == "transient") & (F.col("shown") < 0) & (F.col("end") - F.col("start") < o.isolated_ms) & (left | right) & ~(left & right & (lc != rc))
    return spans.withColumns({"shown": F.when(takes, F.when(left, lc).otherwise(rc)).otherwise(F.col("shown")), "confidence": F.when(takes, F.when(left, lf).otherwise(rf)).otherwise(F.col("confidence"))})


def stages(windows: DataFrame, o: TimelineOptions = DEFAULT) -> dict[str, DataFrame]:
    """Every step's rows, by name."""
    spans = voronoi(windows)
    runs = run_length(spans, ["rec", "seg_idx"], ["cluster", "stability"])
    found = islands(runs, o)
    crossed = bridged(found, o)
    final = inherited(crossed, o)
    shown = run_length(final.select("rec", "seg_idx", "key", "start", "end", "confidence", "shown"), ["rec", "seg_idx"], ["shown"])
    return {"voronoi": spans, "runs": runs, "islands": found, "bridged": crossed, "inherited": final, "timeline": shown}


def vote(spans: DataFrame) -> DataFrame:
    """rec, seg_idx, cluster, purity, mixed from spans with shown: the cluster of most time, its share of all time, and whether there are several."""
    length = F.sum(F.col("end") - F.col("start"))
    each = spans.groupBy("rec", "seg_idx", "shown").agg(length.alias("w"))
    known = F.col("shown") >= 0
    best = F.min(F.when(known, F.struct((-F.col("w")).alias("w"), F.col("shown").alias("c"))))
    out = each.groupBy("rec", "seg_idx").agg(best.alias("b"), F.sum("w").alias("total"), F.count_if(known).alias("n"))
    return out.select("rec", "seg_idx", F.coalesce("b.c", F.lit(-1)).alias("cluster"), F.coalesce(-F.col("b.w") / F.col("total"), F.lit(0.0)).alias("purity"), (F.col("n") > 1).alias("mixed"))


def counters(windows: DataFrame, o: TimelineOptions = DEFAULT) -> DataFrame:
    """Per recording: raw transient spans, raw mixed segments, spans of each fate and shown mixed segments."""
    s = stages(windows, o)
    share = 0.80
    raw = s["voronoi"].groupBy("rec", "seg_idx", "cluster").agg(F.sum(F.col("end") - F.col("start")).alias("w")).groupBy("rec", "seg_idx").agg(F.count_if(F.col("cluster") >= 0).alias("n"), F.sum("w").alias("total"), F.max(F.when(F.col("cluster") >= 0, F.col("w"))).alias("best"), F.sum(F.when(F.col("cluster") < 0, F.col("w")).otherwise(0)).alias("unknown"))
    mixed = (F.col("n") > 0) & ((F.col("n") > 1) | (F.col("unknown") / F.col("total") >= 1.0 - share) | (F.col("best") / F.col("total") < share))
    spans = s["bridged"].groupBy("rec").agg(F.count_if(F.col("stability") == "transient").alias("raw_transient"), *(F.count_if(F.col("fate") == x).alias(x) for x in ("noise", "bridged", "suppressed")))
    shown = vote(s["inherited"]).groupBy("rec").agg(F.count_if("mixed").alias("shown_mixed"))
    return raw.groupBy("rec").agg(F.count_if(mixed).alias("raw_mixed")).join(spans, "rec").join(shown, "rec")


def rolled_up(scored: DataFrame, clusters: DataFrame, windows: DataFrame, n_batches: DataFrame | None = None, o: TimelineOptions = DEFAULT) -> DataFrame:
    """All 17 counters of an analysis, per recording.

    scored are the points with label, clusters their summaries (trusted, exceeded),
    windows the labelled windows, n_batches (rec, n_batches) what the vectors took.
    Clusters beyond the ceiling are never merged by force.
    """
    points = scored.groupBy("rec").agg(F.count("*").alias("windows"), F.count_if(F.col("label") >= 0).alias("valid_windows"), F.count_if(F.col("label") < 0).alias("noise_windows"))
    found = clusters.groupBy("rec").agg(F.count("*").alias("clusters"), F.bool_or("exceeded").alias("exceeded"), F.count_if(~F.col("trusted")).alias("transient_clusters"), F.count_if("trusted").alias("trusted_speakers"))
    out = points.join(found, "rec", "left").join(counters(windows, o), "rec", "left")
    out = out.join(n_batches.select("rec", "n_batches"), "rec", "left") if n_batches is not None else out.withColumn("n_batches", F.lit(0).cast("long"))
    numbers = ("clusters", "transient_clusters", "trusted_speakers", "raw_transient", "noise", "bridged", "suppressed", "raw_mixed", "shown_mixed", "n_batches")
    return out.fillna(0, list(numbers)).fillna(False, ["exceeded"]).select(
        "rec", "windows", "valid_windows", "noise_windows", "clusters", F.col("clusters").alias("post_threshold_clusters"), "exceeded", F.lit(0).cast("long").alias("forced_merges"), "transient_clusters", F.col("clusters").alias("private_candidates"), "trusted_speakers",
        "raw_transient", F.col("noise").alias("micro_noise"), "bridged", "suppressed", "raw_mixed", "shown_mixed", "n_batches",
    )
