"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label and dimension are compared, as unit vectors about their mean in
a basis ordered by variance (one covariance a dimension, summed in the partitions).
Equal vectors are one class. Classes are ordered by cells of their first COORDINATES
coordinates and cut into tiles of bounded size. Two vectors of cosine at least t lie
within sqrt(2 - 2t) of each other, so a tile only meets tiles whose box comes that
close. In a pair of tiles, products are accumulated over blocks of leading
dimensions; the rest is at most the product of the suffix norms, and pairs that
cannot reach t any more are left out of the further blocks. What remains is
confirmed in the original coordinates, in double precision.

Neighbouring tiles travel as a block, and a pair of blocks with tiles that meet is
one group for one task, so a vector is sent once a block and not once a tile. A task
returns each vector's number of links and a spanning forest of them, so its output
is no longer than its input.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
number, and rows without label, link with nothing; vectors are scaled by a power of
two first, so tiny and huge ones compare by direction; vectors of different
dimension don't link; rows that repeat a vec_id count as vectors of their own but
share its node, rows whose vec_id is null link with nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.llm.components import components
from parley.llm.scratch import Scratch

THRESHOLD = 0.93
#: Vectors of 64 dimensions in a tile (1 MB; fewer of more dimensions), and tiles in a block.
TILE, BLOCK = 2048, 8
#: Dimensions added at a time.
STEP = 8
#: Leading coordinates that tiles are ordered and bounded by, and the width of their cells.
COORDINATES, CELL = 3, 0.1
#: Dimensions, the commonest first, that get a basis of their own; vectors of others keep their order of coordinates.
BASES = 8
#: Dimensions of a vector beyond which only its coordinates are ordered by variance: a covariance has their square.
WIDE = 768
#: Rounding that the bounds allow for.
_EPS = 1e-9


def _valid(vector):
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & clean & F.exists(vector, lambda x: x != 0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Frame:
    """A mean, and a basis of the differences from it in order of variance."""

    def __init__(self, width: int, count: float = 0, sums: np.ndarray | None = None, squares: np.ndarray | None = None):
        """squares: sums of products of each two coordinates, or of each with itself."""
        self.mean, self.order, self.basis = np.zeros(width), np.arange(width), None
        if count:
            self.mean = sums / count
            if squares.ndim == 2:
                self.basis = np.linalg.eigh(squares / count - np.outer(self.mean, self.mean))[1][:, ::-1].copy()
            else:
                self.order = np.argsort(self.mean**2 - squares / count, kind="stable")

    def turned(self, units: np.ndarray) -> np.ndarray:
        away = units - self.mean
        return away[:, self.order] if self.basis is None else away @ self.basis


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each dimension in a batch."""
    sizes = np.array([len(v) for v in batch.column(column)], dtype=np.int64)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        flat = batch.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.astype(np.float64).reshape(-1, int(width))


def _frames(classes: DataFrame) -> dict[int, Frame]:
    """A frame for each of the BASES commonest dimensions: (WIDE + 1) squared numbers each at most, whatever the rows."""
    common = [r["width"] for r in classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(BASES).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {w: np.zeros((w + 1, w + 1) if w <= WIDE else (2, w + 1)) for w in common}
        for batch in batches:
            for _, x in _by_width(batch, 0):
                w = x.shape[1]
                if w in totals:
                    u = np.column_stack([_units(x), np.ones(len(x))])
                    totals[w] += u.T @ u if w <= WIDE else np.stack([u.sum(axis=0), (u * u).sum(axis=0)])
        for w, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, w)), pa.array(np.arange(total.size)), pa.array(total.ravel())], ["width", "k", "v"])

    rows = classes.filter(F.col("width").isin(common)).select("vector").mapInArrow(run, "width long, k long, v double").groupBy("width", "k").agg(F.sum("v").alias("v")).collect()
    found: dict[int, dict[int, float]] = {w: {} for w in common}
    for r in rows:
        found[r["width"]][r["k"]] = r["v"]
    out = {}
    for w, values in found.items():
        m = np.array([values[k] for k in range(len(values))]).reshape(-1, w + 1)
        out[w] = Frame(w, m[-1, w], m[w if w <= WIDE else 0, :w], m[:w, :w] if w <= WIDE else m[1, :w])
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 of the edges that connect what all of them connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


class Tile:
    """Vectors as differences from the mean: of two, the cosine is their offsets plus the product of the differences."""

    def __init__(self, vectors: np.ndarray, frame: Frame):
        self.raw = _scaled(vectors)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        units = self.raw / self.norm[:, None]
        self.turned = frame.turned(units)
        self.offset = units @ frame.mean - frame.mean @ frame.mean / 2
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1))
        lead = self.turned[:, :COORDINATES]
        self.low, self.high = lead.min(axis=0), lead.max(axis=0)

    def reaches(self, other: Tile, threshold: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(gap @ gap) <= 2 - 2 * threshold + _EPS

    def close(self, other: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of at least this cosine."""
        width = self.raw.shape[1]
        first = min(STEP, width)
        part = self.turned[:, :first] @ other.turned[:, :first].T + self.offset[:, None] + other.offset
        rows, cols = np.nonzero(part + self.suffix[:, first][:, None] * other.suffix[:, first] >= threshold - _EPS)
        sums = part[rows, cols]
        for at in range(first, width, STEP):
            stop = min(at + STEP, width)
            sums = sums + np.einsum("ij,ij->i", self.turned[rows, at:stop], other.turned[cols, at:stop])
            live = sums + self.suffix[rows, stop] * other.suffix[cols, stop] >= threshold - _EPS
            rows, cols, sums = rows[live], cols[live], sums[live]
        exact = np.einsum("ij,ij->i", self.raw[rows], other.raw[cols]) / (self.norm[rows] * other.norm[cols])
        ok = exact >= threshold
        return rows[ok], cols[ok]


def _placed(classes: DataFrame, frames: dict[int, Frame]) -> DataFrame:
    """classes with lead, the first coordinates, and the numbers of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads: list = [None] * batch.num_rows
            for at, x in _by_width(batch, batch.num_columns - 1):
                frame = frames.get(x.shape[1]) or Frame(x.shape[1])
                for i, row in zip(at.tolist(), frame.turned(_units(x))[:, :COORDINATES].tolist(), strict=True):
                    leads[i] = [*row, *[0.0] * (COORDINATES - len(row))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads, pa.list_(pa.float64()))], names)

    names = ["label", "width", "node", "copies", "id", "vector", "lead"]
    led = classes.select(*names[:-1]).mapInArrow(run, T.StructType([*(classes.schema[c] for c in names[:-1]), T.StructField("lead", T.ArrayType(T.DoubleType()))]))
    cell = [F.floor(F.col("lead")[k] / CELL).cast("int").alias(f"c{k}") for k in range(COORDINATES)]
    return led.select("*", *cell)


def _tiles(led: DataFrame, tile: int) -> DataFrame:
    """The rows with tile: runs of about ``tile`` rows of 64 dimensions in the order of cells, for each label and dimension.

    Places come from counts of cells, whose number is bounded as coordinates are, so no
    label is sorted in one task; a cell of more rows is dealt out by hash.
    """
    cells = [f"c{k}" for k in range(COORDINATES)]
    group = ["label", "width"]
    counted = led.groupBy(*group, *cells).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(*cells).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    places = counted.select(*group, *cells, "n", before.alias("before"))
    inside = F.col("before") + F.pmod(F.xxhash64("vector"), F.col("n"))
    size = F.greatest(F.lit(16), F.floor(F.lit(64 * tile) / F.col("width")))
    return led.join(places, [*group, *cells]).select(*group, "vector", "node", "copies", "lead", F.floor(inside / size).cast("int").alias("tile"))


def _meets(tiled: DataFrame, threshold: float) -> DataFrame:
    """label, width, i and j (i <= j): the blocks of which two tiles' boxes come close enough."""
    group = ["label", "width"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _EPS
    ends = [f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(COORDINATES) for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = tiled.groupBy(*group, "tile").agg(*ends)
    # Two ranges come within reach where the ranges, each longer by reach, share a stripe; the later one's first stripe is taken.
    first, last = F.floor(F.col("low0") / reach).cast("int"), F.floor((F.col("high0") + reach) / reach).cast("int")
    striped = boxes.withColumn("first", first).withColumn("stripe", F.explode(F.sequence("first", last)))
    left, right = striped.alias("l"), striped.alias("r")
    gap = F.lit(0.0)
    for k in range(COORDINATES):
        d = F.greatest(F.lit(0.0), F.col(f"l.low{k}") - F.col(f"r.high{k}"), F.col(f"r.low{k}") - F.col(f"l.high{k}"))
        gap = gap + d * d
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*group, "stripe")]
    near = left.join(right, [*same, F.col("l.tile") <= F.col("r.tile"), F.col("l.stripe") == F.greatest("l.first", "r.first"), gap <= 2 - 2 * threshold + _EPS])
    block = lambda side: F.floor(F.col(f"{side}.tile") / BLOCK).cast("int")
    return near.select("l.label", "l.width", block("l").alias("i"), block("r").alias("j")).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector")), "rows")
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("vector")))
    classes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # Ids of classes differ also where rows repeat a vec_id.
    classes = scratch.save(classes.select("label", F.size("vector").alias("width"), F.xxhash64("label", "vector").alias("node"), "copies", "id", "vector"), "classes")
    frames = _frames(classes)
    led = scratch.save(_placed(classes, frames), "led")
    tiled = scratch.save(_tiles(led, tile), "tiles")
    scratch.drop(led)
    meets = scratch.save(_meets(tiled, threshold), "meets")
    sides = meets.select("label", "width", "i", "j", F.col("i").alias("block")).union(meets.filter("i < j").select("label", "width", "i", "j", F.col("j").alias("block")))
    placed = tiled.withColumn("block", F.floor(F.col("tile") / BLOCK).cast("int"))
    dealt = placed.join(sides, ["label", "width", "block"]).select("label", "width", "i", "j", "block", "tile", "node", "copies", "vector")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType())])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        width, same = int(group["width"].iloc[0]), group["i"].iloc[0] == group["j"].iloc[0]
        frame = frames.get(width) or Frame(width)
        group = group.sort_values(["tile", "node"], ignore_index=True)
        block, node, copies = (group[c].to_numpy() for c in ("block", "node", "copies"))
        edges = np.flatnonzero(np.diff(group["tile"].to_numpy())) + 1
        starts, stops = [0, *edges.tolist()], [*edges.tolist(), len(group)]
        tiles = [Tile(np.stack(group["vector"].iloc[a:b].to_numpy()).astype(np.float64).reshape(b - a, width), frame) for a, b in zip(starts, stops, strict=True)]
        links = np.zeros(len(group), np.int64)
        joined = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for x in range(len(tiles)):
            for y in range(x, len(tiles)):
                # Two tiles of one block meet in the group of that block with itself.
                if (not same and block[starts[x]] == block[starts[y]]) or not tiles[x].reaches(tiles[y], threshold):
                    continue
                r, c = tiles[x].close(tiles[y], threshold)
                if x == y:
                    r, c = r[r < c], c[r < c]
                r, c = r + starts[x], c + starts[y]
                np.add.at(links, r, copies[c])
                np.add.at(links, c, copies[r])
                joined = list(_forest(len(group), np.concatenate([joined[0], r]), np.concatenate([joined[1], c])))
        linked = np.flatnonzero(links)
        counted = pd.DataFrame({"node": node[linked], "links": links[linked], "other": None})
        return pd.concat([counted, pd.DataFrame({"node": node[joined[0]], "links": 0, "other": node[joined[1]]})]).astype({"node": "int64", "links": "int64", "other": "Int64"})

    found = scratch.save(dealt.groupBy("label", "width", "i", "j").applyInPandas(compare, schema), "found")
    scratch.drop(tiled, meets)
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    part = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    named = classes.join(part, "node", "left").select("label", "vector", "id", "node", "copies", F.coalesce("component", "node").alias("group"))
    named = scratch.save(named.join(counts, "node", "left").select("label", "vector", "id", "group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    placed = rows.join(named.select("label", "vector", "group", "n_links"), ["label", "vector"], "left").select("vec_id", *(F.when(F.col("vec_id").isNotNull(), F.col(c)).alias(c) for c in ("group", "n_links")))
    placed = scratch.save(placed, "placed")
    if placed.groupBy("vec_id").count().filter("count > 1 and vec_id is not null").isEmpty():
        least = named.groupBy("group").agg(F.min("id").alias("component_id"))
        out = placed.join(least, "group", "left")
    else:
        through = placed.filter("group is not null").groupBy("vec_id").agg(F.min("group").alias("a"), F.collect_set("group").alias("bs")).select("a", F.explode("bs").alias("b"))
        joined = components(through, scratch).select(F.col("node").alias("group"), "component")
        groups = placed.select("vec_id", "group").dropna().distinct().join(joined, "group")
        least = groups.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        nodes = groups.join(least, "component").select(F.col("vec_id").alias("own"), "component_id").distinct()
        out = placed.join(nodes, placed["vec_id"] == nodes["own"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
