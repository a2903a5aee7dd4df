"""Grouping analysis windows into speakers.

Rows are points: rec, key, start_ms, end_ms and v (an array of double). Links are
local in time, so they come from bounded look-back; the order-dependent merge of
micro-clusters runs per recording on cluster summaries, never on all points.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.vectors import clamped_cosine, unit, valid
from parley.operators.intervals import greedy_disjoint, union_length


@dataclass(frozen=True)
class ClusterOptions:
    """The thresholds of speaker clustering."""

    micro_threshold: float = 0.72
    look_back: int = 48
    look_back_ms: int = 12_000
    consolidate_threshold: float = 0.38
    consolidate_floor: float = 0.22
    floor_fraction: float = 0.20
    consolidate_margin: float = 0.035
    established_threshold: float = 0.58
    established_evidence: int = 2
    established_ms: int = 2_000
    sample_size: int = 24
    stride_anchors: int = 64
    large_anchors: int = 32
    evidence_ms: int = 1_000
    min_evidence: int = 3
    min_union_ms: int = 2_500
    min_trusted_ms: int = 3_000
    min_coherence: float = 0.48
    strong_evidence: int = 6
    strong_ms: int = 6_000
    min_size: int = 2
    max_speakers: int = 64

    def settled(self) -> ClusterOptions:
        """With thresholds in [-1, 1] and those that follow another raised to it."""
        from dataclasses import replace

        clip = lambda x, other: other if x != x or abs(x) == float("inf") else max(-1.0, min(1.0, x))
        base = clip(self.consolidate_threshold, 0.38)
        return replace(self, consolidate_threshold=base, micro_threshold=max(base, clip(self.micro_threshold, 0.72)), established_threshold=max(base, clip(self.established_threshold, 0.58)), max_speakers=max(1, self.max_speakers))


DEFAULT = ClusterOptions()


def micro_edges(points: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """rec, a, b (keys of an earlier and a later point) and score of links within the look-back.

    A point looks back over at most ``look_back`` points and stops at the first after
    which more than ``look_back_ms`` pass. The look-back is a window frame, so each
    row meets a bounded list and there is no join.
    """
    order = Window.partitionBy("rec").orderBy("start_ms", "key")
    before = F.collect_list(F.struct("key", "end_ms", "v")).over(order.rowsBetween(-o.look_back, -1))
    each = points.filter(valid(F.col("v"))).select("rec", "key", "start_ms", "v", F.reverse(before).alias("before"))
    # The nearest earlier point that ended too long ago ends the look-back.
    late = F.transform("before", lambda x: (F.col("start_ms") - x["end_ms"] > o.look_back_ms).cast("int"))
    stop = F.array_position(late, 1)
    reach = F.when(stop > 0, F.slice("before", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("before"))
    # Compared inside the list, so that only links become rows and no vector is copied.
    scored = F.transform(reach, lambda x: F.struct(x["key"].alias("a"), clamped_cosine(x["v"], F.col("v")).alias("score")))
    linked = each.select("rec", F.col("key").alias("b"), F.explode(F.filter(scored, lambda x: x["score"] >= o.micro_threshold)).alias("x"))
    return linked.select("rec", "x.a", "b", "x.score")


def micro_clusters(points: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """rec, key and cluster, the least key of the component, for every valid point.

    Each recording's links are joined by union-find in the task that holds them: a
    recording is one group of at most ``look_back`` links a point.
    """
    nodes = points.filter(valid(F.col("v"))).select("rec", F.col("key").alias("a"), F.col("key").alias("b"))
    edges = micro_edges(points, o).select("rec", "a", "b").union(nodes)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([group["a"], group["b"]]), return_inverse=True)
        a, b = np.split(codes, 2)
        low = np.arange(len(names))
        while True:  # least reachable index by hooking and shortcutting
            least = low.copy()
            np.minimum.at(least, a, low[b])
            np.minimum.at(least, b, low[a])
            least = least[least]
            if (least == low).all():
                break
            low = least
        return pd.DataFrame({"rec": group["rec"].iloc[0], "key": names, "cluster": names[low]})

    return edges.groupBy("rec").applyInPandas(join, points.select("rec", "key", F.col("key").alias("cluster")).schema)


def prototypes(members: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, size and prototype: the normalised sum of the members' unit vectors, optionally weighted by at least 1.

    Vectors of another length than the group's first, by key, are left out. Sums are
    made per coordinate, with partial sums before the exchange.
    """
    each = members.filter(valid(F.col("v"))).select(*by, "key", unit(F.col("v")).alias("u"), (F.greatest(F.lit(1.0), weight) if weight is not None else F.lit(1.0)).alias("w"))
    first = each.groupBy(*by).agg(F.min(F.struct("key", F.size("u").alias("n")))["n"].alias("n"), F.count("*").alias("size"))
    coords = each.select(*by, "w", F.size("u").alias("n"), F.posexplode("u").alias("pos", "x")).groupBy(*by, "n", "pos").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    sums = coords.join(first, [*by, "n"]).groupBy(*by, "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"))
    return sums.select(*by, "size", unit(F.col("sum")).alias("prototype"))


def support(members: DataFrame, by: list[str], o: ClusterOptions = DEFAULT) -> DataFrame:
    """by, size, canonical_key, prototype, union_ms, evidence, coherence of each cluster."""
    lengths = union_length(members, by, "start_ms", "end_ms", "union_ms")
    folded = members.groupBy(*by).agg(F.min("key").alias("canonical_key"), greedy_disjoint(F.collect_list(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))), o.evidence_ms, 0).alias("evidence"))
    proto = prototypes(members, by)
    close = members.join(proto, by).select(*by, clamped_cosine(F.col("v"), F.col("prototype")).alias("c")).filter("c > -1").groupBy(*by).agg(F.avg("c").alias("coherence"))
    return proto.join(lengths, by, "left").join(folded, by).join(close, by, "left").fillna(0, ["union_ms"]).fillna(-1.0, ["coherence"])


def trust(rows: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """rows of ``support`` with trusted and strong."""
    steady = (F.col("evidence") >= o.min_evidence) & (F.col("union_ms") >= o.min_union_ms) & (F.col("coherence") >= o.min_coherence)
    trusted = steady & ((F.col("union_ms") >= o.min_trusted_ms) | (F.col("evidence") >= o.min_evidence + 1)) & (F.col("size") >= o.min_size)
    strong = (F.col("evidence") >= o.strong_evidence) & (F.col("union_ms") >= o.strong_ms) & (F.col("coherence") >= o.min_coherence)
    return rows.withColumns({"trusted": trusted, "strong": strong})


def publication_cap(rows: DataFrame, most: int) -> DataFrame:
    """Of each recording's trusted clusters only the best supported stay trusted; exceeded tells that there were more."""
    order = Window.partitionBy("rec", "trusted").orderBy(F.desc("union_ms"), F.desc("evidence"), "canonical_key")
    count = F.sum(F.col("trusted").cast("int")).over(Window.partitionBy("rec"))
    ranked = rows.withColumns({"__rank": F.row_number().over(order), "exceeded": (count > most) | (F.count("*").over(Window.partitionBy("rec")) > most)})
    return ranked.withColumn("trusted", F.col("trusted") & (F.col("__rank") <= most)).drop("__rank")


def sample_members(members: DataFrame, by: list[str], size: int = DEFAULT.sample_size) -> DataFrame:
    """At most ``size`` members of each cluster, evenly spread in key order."""
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = members.withColumns({"__n": n, "__at": F.row_number().over(Window.partitionBy(*by).orderBy("key")) - 1})
    # Place i of size is taken at floor(i n / size): the row is one if some i falls on it.
    i = F.ceil(F.col("__at") * size / F.col("__n"))
    taken = (F.col("__n") <= size) | ((i < size) & (F.floor(i * F.col("__n") / size) == F.col("__at")))
    return ranked.filter(taken).drop("__n", "__at")


def anchors(summaries: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """The rows of summaries (rec, cluster, first_ms, size) that every other is compared with."""
    time = Window.partitionBy("rec").orderBy("first_ms", "cluster")
    large = Window.partitionBy("rec").orderBy(F.desc("size"), "cluster")
    stride = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("rec")) / o.stride_anchors))
    marked = summaries.withColumns({"__turn": F.row_number().over(time) - 1, "__rank": F.row_number().over(large), "__stride": stride})
    return marked.filter((F.col("__turn") % F.col("__stride") == 0) | (F.col("__rank") <= o.large_anchors)).drop("__turn", "__rank", "__stride")


def candidates(summaries: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """rec, a, b (a < b) and score of the pairs of micro-clusters that may merge: near in time, or one an anchor.

    Each row meets at most look_back + anchors others (a constant), so the pairs grow
    with the clusters.
    """
    order = Window.partitionBy("rec").orderBy("first_ms", "cluster")
    before = F.collect_list(F.struct("cluster", "prototype")).over(order.rowsBetween(-o.look_back, -1))
    seen = summaries.select("rec", F.col("cluster").alias("x"), F.col("prototype").alias("p"), before.alias("before"))
    near = seen.select("rec", "x", "p", F.explode("before").alias("y")).select("rec", "x", "p", F.col("y.cluster").alias("y"), F.col("y.prototype").alias("q"))
    fixed = anchors(summaries, o).select("rec", F.col("cluster").alias("y"), F.col("prototype").alias("q"))
    wide = summaries.select("rec", F.col("cluster").alias("x"), F.col("prototype").alias("p")).join(fixed, "rec").filter("x <> y")
    both = near.union(wide.select("rec", "x", "p", "y", "q")).select("rec", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), clamped_cosine(F.col("p"), F.col("q")).alias("score"))
    return both.groupBy("rec", "a", "b").agg(F.max("score").alias("score")).filter(F.col("score") >= o.consolidate_threshold)


def _floor_percentile(values: np.ndarray, fraction: float) -> float:
    return float(np.sort(values)[int(np.floor((len(values) - 1) * fraction))]) if len(values) else -1.0


class _Merger:
    """Merging of one recording's micro-clusters, best pair first, each merge subject to a veto."""

    def __init__(self, sizes, samples, spans, o: ClusterOptions):
        self.o, self.size, self.sample = o, sizes, samples  # sample: cluster -> list of (key, unit vector)
        self.spans, self.edges = spans, [dict() for _ in sizes]
        self.alive, self.version = [True] * len(sizes), [0] * len(sizes)
        self.queue: list[tuple] = []

    def push(self, a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        if self.edges[a][b] >= self.o.consolidate_threshold:
            heapq.heappush(self.queue, (-self.edges[a][b], a, b, self.version[a], self.version[b]))

    def established(self, a: int) -> bool:
        spans = sorted(self.spans[a])
        reach, total, last, n = -1, 0, None, 0
        for s, e in spans:
            total += max(0, e - max(s, reach))
            reach = max(reach, e)
            if e - s >= self.o.evidence_ms and (last is None or s >= last):
                n, last = n + 1, e
        return n >= self.o.established_evidence and total >= self.o.established_ms

    def drawn(self, a: int) -> np.ndarray:
        rows = sorted(self.sample[a], key=lambda x: x[0])
        if len(rows) > self.o.sample_size:
            rows = [rows[i * len(rows) // self.o.sample_size] for i in range(self.o.sample_size)]
        return np.stack([v for _, v in rows])

    def vetoed(self, a: int, b: int, score: float) -> bool:
        x, y = self.drawn(a), self.drawn(b)
        pooled = np.concatenate([x, y])
        mean = pooled.sum(axis=0)
        length = np.linalg.norm(mean)
        if length == 0 or _floor_percentile(pooled @ (mean / length), self.o.floor_fraction) < self.o.consolidate_floor:
            return True
        if _floor_percentile((x @ y.T).ravel(), self.o.floor_fraction) < self.o.consolidate_floor:
            return True
        if score >= self.o.established_threshold:
            return False
        rivals = [w for side, other in ((a, b), (b, a)) for c, w in self.edges[side].items() if c != other and self.alive[c]]
        if rivals and max(rivals) > -1 and score - max(rivals) < self.o.consolidate_margin:
            return True
        return self.established(a) or self.established(b)

    def merge(self, a: int, b: int) -> None:
        na, nb = self.size[a], self.size[b]
        for c in {*self.edges[a], *self.edges[b]} - {a, b}:
            if self.alive[c]:
                x, y = self.edges[a].get(c), self.edges[b].get(c)
                self.edges[a][c] = self.edges[c][a] = y if x is None else x if y is None else (x * na + y * nb) / (na + nb)
        self.alive[b] = False
        self.size[a] = na + nb
        self.sample[a] = self.sample[a] + self.sample[b]
        self.spans[a] = self.spans[a] + self.spans[b]
        self.version[a] += 1
        for c in self.edges[a]:
            if self.alive[c]:
                self.push(a, c)

    def run(self) -> list[int]:
        into = list(range(len(self.size)))
        while self.queue:
            negative, a, b, va, vb = heapq.heappop(self.queue)
            if self.alive[a] and self.alive[b] and (va, vb) == (self.version[a], self.version[b]) and not self.vetoed(a, b, -negative):
                self.merge(a, b)
                into[b] = a
        for i in range(len(into)):
            j = i
            while into[j] != j:
                j = into[j]
            into[i] = j
        return into


def consolidate(points: DataFrame, micro: DataFrame, o: ClusterOptions = DEFAULT) -> DataFrame:
    """rec, key, cluster of each point after micro-clusters were merged; cluster is the least key of the whole.

    Merging depends on its order, so one task does one recording: it gets the
    recording's candidate pairs and its points' unit vectors.
    """
    o = o.settled()
    members = points.join(micro, ["rec", "key"]).select("rec", "key", "cluster", "start_ms", "end_ms", "v")
    proto = prototypes(members, ["rec", "cluster"])
    first = members.groupBy("rec", "cluster").agg(F.min("start_ms").alias("first_ms"))
    pairs = candidates(proto.join(first, ["rec", "cluster"]), o).select(F.col("rec").alias("of"), "a", "b", "score")

    def merge(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"rec": [], "key": [], "cluster": []})
        rows = rows.sort_values("key", kind="stable")
        vectors = [np.asarray(v, dtype=np.float64) for v in rows["v"]]
        rows = rows.assign(u=[v / np.linalg.norm(v) for v in vectors])
        groups = sorted(rows.groupby("cluster"), key=lambda x: (x[1]["start_ms"].min(), x[0]))
        number = {name: i for i, (name, _) in enumerate(groups)}
        m = _Merger([len(g) for _, g in groups], [list(zip(g["key"], g["u"], strict=True)) for _, g in groups], [list(zip(g["start_ms"], g["end_ms"], strict=True)) for _, g in groups], o)
        for a, b, s in zip(edges["a"], edges["b"], edges["score"], strict=True):
            i, j = number[a], number[b]
            m.edges[i][j] = m.edges[j][i] = float(s)
        for i in range(len(groups)):
            for j in m.edges[i]:
                if i < j:
                    m.push(i, j)
        into = m.run()
        whole: dict[int, str] = {}
        for name, i in number.items():
            whole[into[i]] = min(name, whole.get(into[i], name))
        return pd.DataFrame({"rec": rows["rec"].to_numpy(), "key": rows["key"].to_numpy(), "cluster": [whole[into[number[c]]] for c in rows["cluster"]]})

    return members.groupBy("rec").cogroup(pairs.groupBy("of")).applyInPandas(merge, members.select("rec", "key", "cluster").schema)


def labels(members: DataFrame) -> DataFrame:
    """members (rec, key, cluster) with label: 0, 1, ... in the order of the clusters' least keys."""
    least = members.groupBy("rec", "cluster").agg(F.min("key").alias("__least"))
    numbered = least.withColumn("label", (F.row_number().over(Window.partitionBy("rec").orderBy("__least")) - 1).cast("int")).drop("__least")
    return members.join(numbered, ["rec", "cluster"])


def cluster_points(points: DataFrame, o: ClusterOptions = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The whole pipeline: points with label (-1: invalid) and score, and the clusters' summaries."""
    o = o.settled()
    whole = labels(consolidate(points, micro_clusters(points, o), o))
    members = points.join(whole, ["rec", "key"])
    summary = publication_cap(trust(support(members, ["rec", "label"], o), o), o.max_speakers)
    placed = points.join(whole.select("rec", "key", "label"), ["rec", "key"], "left").fillna(-1, ["label"])
    scored = placed.join(summary.select("rec", "label", "prototype"), ["rec", "label"], "left").withColumn("score", F.coalesce(clamped_cosine(F.col("v"), F.col("prototype")), F.lit(0.0))).drop("prototype")
    return scored, summary
