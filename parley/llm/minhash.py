"""MinHash near-dedup by an inverted join of signature coordinates.

1. Each document's set of word shingles is hashed; documents with equal sets become
   one class, named by its least doc_id.
2. A class is posted under each (coordinate, value) pair of its signature. Two
   classes that agree in at least MATCHES of COORDINATES places are candidates.
   Values that only one class has can't count, so a class with fewer shared values
   than MATCHES leaves here. Of the rest, ordered by rarity, only the prefix is
   merged that any sufficient agreement must touch; the long lists of common values
   after it are skipped.
3. In a list, each class meets the list's medoid: as many pairs as postings. Those
   whose full signatures agree in MATCHES places and whose full sets have the stated
   similarity are links, and join classes into components.
4. Pairs of different components remain. Lists also give a spanning forest of all
   pairs whose sketches agree, so whatever may link lies in one neighbourhood. Each
   neighbourhood of several components is compared inside the tasks, in tiles of
   bounded size; a task returns a forest of the links that it confirmed, never pairs.

Lists and tiles are streamed from sorted partitions; long lists are dealt out.

Defined results: null texts and texts without words have an empty set, link with
nothing and stay; a text of fewer words than a shingle is one shingle; rows that
repeat a doc_id are one node; an empty table gives no rows; other columns are
ignored by ``near_duplicates`` and carried along by ``dedup_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.llm.components import components
from parley.llm.scratch import Scratch

SHINGLE_WORDS = 5
#: Similarity as a percentage.
PERCENT = 75
COORDINATES = 64
MATCHES = 34
#: Equal bits of two sketches (a bit for each coordinate): 56 expected at the threshold, standard deviation 2.6; 32 by chance.
SKETCH_BITS = 46
#: Rows of a list that meet each other at a time.
BLOCK = 2048
#: Rows of a list that one task holds (40 bytes each); longer lists are dealt out in slices, and slices meet in pairs.
SLICE = 50_000
#: Classes of a tile, with their texts.
TILE = 1024
_SEED = 20_250_101

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, size: int = SHINGLE_WORDS, most_words: int = 1_000_000):
        self.size, self.most, self.known = size, most_words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = text.translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.size + 1)
        width = min(self.size, len(h))
        out = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def _signature(sets: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A row of COORDINATES 32-bit minima for each non-empty set; sets lie one after the other."""
    out = np.empty((len(starts), len(factors)), dtype=np.uint32)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(((sets * f[0] + f[1]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _factors() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 1 << 63, size=(COORDINATES, 2), dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (16 bytes; null: empty set) and sig (COORDINATES x 4 bytes) for each row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, factors = Shingler(), _factors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t) for t in some.column(1).to_pylist()]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                keys: list[bytes | None] = [None] * len(sets)
                sigs: list[bytes | None] = [None] * len(sets)
                if len(full):
                    rows = _signature(np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full], factors)
                    for i, row in zip(full, rows, strict=True):
                        keys[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema.names)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


_POSTING = "id long, token long, sketch long"


def _postings(classes: DataFrame) -> DataFrame:
    """id, token (of a coordinate and its value) and sketch (a bit of each coordinate): COORDINATES rows a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        bit = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(-1, COORDINATES).astype(np.uint64)
            mixed = _mix(sig + place)
            sketch = ((mixed & np.uint64(1)) * bit).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, COORDINATES)), pa.array(mixed.ravel().view(np.int64)), pa.array(np.repeat(sketch, COORDINATES))], ["id", "token", "sketch"])

    return classes.select("id", "sig").mapInArrow(run, _POSTING)


def _prefixes(postings: DataFrame) -> DataFrame:
    """The postings that merging must look at: those of each class's rarest shared values."""
    often = postings.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    shared = postings.join(often, "token")
    rarity = Window.partitionBy("id").orderBy("often", "token")
    ranked = shared.select("*", F.row_number().over(rarity).alias("rank"), F.count("*").over(Window.partitionBy("id")).alias("shared"))
    # COORDINATES - shared values come before these and match nothing.
    return ranked.filter((F.col("shared") >= MATCHES) & (F.col("rank") <= F.col("shared") - MATCHES + 1)).select("token", "id", "sketch", _slices(F.col("often")).alias("slices"))


def _slices(rows: Column) -> Column:
    """Into how many parts a list of so many rows is dealt, so that none outgrows a task."""
    return F.ceil(rows / SLICE).cast("int")


def _slice() -> Column:
    return F.pmod(F.xxhash64("id", "token"), F.col("slices")).cast("int")


def _equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return COORDINATES - np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)  # of signed numbers it would count the absolute value's


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each list, from batches sorted by token (the first column)."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield [c[a:b] for c in cols]
        held = [c[edges[-1] :] for c in cols] if len(cols[0]) else held
    if held is not None and len(held[0]):
        yield held


def _medoid(ids: np.ndarray, sketch: np.ndarray) -> int:
    """The place of the class whose sketch is nearest to the bitwise majority."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(ids), BLOCK):
        votes += np.unpackbits(sketch[at : at + BLOCK].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    major = np.packbits(votes * 2 > len(ids), bitorder="little").view("<i8")[0]
    return int(np.lexsort((ids, -_equal_bits(sketch, major)))[0])


def _forest(ids: np.ndarray, sketch: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what pairs of agreeing sketches connect, at most one less than the classes."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(ids))
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            ok = _equal_bits(sketch[left], sketch[at]) >= SKETCH_BITS
            found = left[ok].tolist()
            a += [int(ids[at])] * len(found)
            b += ids[found].tolist()
            stack += found
            left = left[~ok]
    return a, b


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, star: of each list the pairs with its medoid (star), and a forest of its agreeing sketches."""

    def out(rows: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], ["a", "b", "star"])

    held: tuple[list, list, list] = ([], [], [])
    for _, ids, sketch, own in _lists(batches):
        if len(ids) < 2:
            continue
        pairs = [(*_forest(ids, sketch), False)]
        if own.all():  # not the meeting of two slices
            mid = _medoid(ids, sketch)
            near = ids[(_equal_bits(sketch, sketch[mid]) >= SKETCH_BITS) & (ids != ids[mid])].tolist()
            pairs.append(([int(ids[mid])] * len(near), near, True))
        for a, b, star in pairs:
            held[0].extend(map(min, a, b))
            held[1].extend(map(max, a, b))
            held[2].extend([star] * len(a))
        if len(held[0]) >= 1 << 16:
            yield out(held)
            held = ([], [], [])
    if held[0]:
        yield out(held)


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in MATCHES places and whose set sizes allow the similarity."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(-1, COORDINATES) for k in (2, 3))
                ok = pa.array((x == y).sum(axis=1) >= MATCHES)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets have the similarity; texts has id and text of their classes."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingles(x), shingles(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _neighbourhoods(classes: DataFrame, texts: DataFrame, near: DataFrame, part: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components, from comparing neighbourhoods (node, component: near) tile by tile.

    A component of more than TILE classes has tiles of its own, which never meet each
    other; the small ones of a neighbourhood share tiles.
    """
    size = near.select(F.col("node").alias("id"), F.col("component").alias("place")).join(part.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "place", F.coalesce("component", "id").alias("part"))
    size = scratch.save(size, "places")
    parts = size.groupBy("place", "part").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("place").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("n") <= TILE, F.col("n")).otherwise(0)).alias("small")).filter("parts > 1")
    deal = lambda what, rows: F.pmod(F.xxhash64(what), F.ceil(rows / TILE))
    large = F.col("n") > TILE
    dealt = size.join(parts, ["place", "part"]).join(mixed, "place").select(
        "place", "id", "part", F.when(large, F.xxhash64("part", deal("id", F.col("n")))).otherwise(F.xxhash64(F.lit("small"), deal("part", F.col("small")))).alias("tile"), F.when(large, F.col("part")).alias("whole"))
    dealt = scratch.save(dealt, "tiles")
    tiles = dealt.select("place", "tile", "whole").distinct()
    left, right = tiles.alias("l"), tiles.alias("r")
    meets = left.join(right, (F.col("l.place") == F.col("r.place")) & (F.col("l.tile") <= F.col("r.tile")) & ~F.coalesce(F.col("l.whole") == F.col("r.whole"), F.lit(False)))
    meets = scratch.save(meets.select(F.xxhash64("l.place", "l.tile", "r.tile").alias("meet"), F.col("l.place").alias("place"), F.array_distinct(F.array("l.tile", "r.tile")).alias("sides")), "meets")
    sides = meets.select("meet", "place", F.posexplode("sides").alias("side", "tile"))
    signed = dealt.join(sides, ["place", "tile"]).join(classes.select("id", "sig"), "id").select("meet", "side", "id", "part", "sig")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            keep = _hopeful(group)
            if keep.any():
                yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    # Signatures meet first: texts travel only for classes that agree with one of another component there.
    left = scratch.save(signed.repartition("meet").sortWithinPartitions("meet").mapInArrow(screen, signed.schema), "hopeful")
    rows = left.join(texts, "id").select("meet", "side", "id", "part", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for group in _groups(batches):
            a, b = _confirm(group, shingles)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which batches are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _signatures(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(4).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)


def _hopeful(group: pa.Table) -> np.ndarray:
    """Which rows of a tile, or of two, agree in MATCHES places with one of another component that they meet."""
    side, part, sig = group.column(1).to_numpy(), group.column(3).to_numpy(), _signatures(group)
    out = np.zeros(len(side), dtype=bool)
    two = side.max() > 0
    for i in np.flatnonzero(side == 0).tolist():
        others = np.flatnonzero((part != part[i]) & ((side == 1) if two else (np.arange(len(side)) > i)))
        near = others[(sig[others] == sig[i]).sum(axis=1) >= MATCHES]
        if len(near):
            out[i] = True
            out[near] = True
    return out


def _confirm(group: pa.Table, shingles: Shingler) -> tuple[list[int], list[int]]:
    """A forest of the links between different components in a tile, or across two."""
    side, ids, part = (group.column(k).to_numpy() for k in (1, 2, 3))
    sig = _signatures(group)
    texts, sets = group.column(5), {}
    names, root = np.unique(part, return_inverse=True)
    two = side.max() > 0
    out: tuple[list[int], list[int]] = ([], [])

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i].as_py())
        return sets[i]

    for i in range(len(ids)):
        if two and side[i] == 1:
            continue
        ok = (root != root[i]) & (side == 1 if two else np.arange(len(ids)) > i)
        others = np.flatnonzero(ok)
        agree = (sig[others] == sig[i]).sum(axis=1)
        near = agree >= MATCHES
        others, agree = others[near], agree[near]
        for j in others[np.argsort(-agree, kind="stable")].tolist():
            if root[i] == root[j]:
                continue
            s, t = of(i), of(j)
            if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(t) - both):
                root[root == root[j]] = root[i]
                out[0].append(int(ids[i]))
                out[1].append(int(ids[j]))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; doc_id is an integer."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(signatures(docs), "signed")
    classes = signed.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # A doc_id that repeats with another text may name two classes; each class has an id of its own.
    classes = scratch.save(classes.select(F.xxhash64("key").alias("id"), "key", "first", "n", "sig"), "classes")
    postings = scratch.save(_prefixes(_postings(classes)), "postings")
    texts = _texts_of(docs, classes, postings, scratch)
    sliced = postings.select("token", "id", "sketch", _slice().alias("slice"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    sliced = sliced.select(F.xxhash64("token", F.least("slice", "other"), F.greatest("slice", "other")).alias("list"), "id", "sketch", (F.col("slice") == F.col("other")).alias("own"))
    merged = sliced.repartition("list").sortWithinPartitions("list").mapInArrow(_merge_lists, "a long, b long, star boolean")
    merged = scratch.save(merged.distinct(), "merged")
    links = scratch.save(_confirmed(_agreeing(merged.filter("star").select("a", "b"), classes), texts), "links")
    part = components(links, scratch)
    more = _neighbourhoods(classes, texts, components(merged, scratch), part, scratch)
    more = scratch.save(more, "more")
    whole = components(links.union(more), scratch)
    named = classes.select("id", "key", "first").join(whole.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "first", F.coalesce("component", "id").alias("group"))
    if signed.groupBy("doc_id").count().filter("count > 1").isEmpty():
        nodes = named.join(named.groupBy("group").agg(F.min("first").alias("component_id")), "group").select("key", "component_id")
        out = signed.join(nodes, "key", "left")
    else:
        # Rows that repeat a doc_id are one node: their classes' groups are joined through it.
        groups = signed.join(named.select("key", "group"), "key").select("doc_id", "group")
        through = groups.groupBy("doc_id").agg(F.min("group").alias("a"), F.collect_set("group").alias("bs")).select("a", F.explode("bs").alias("b"))
        joined = components(through, scratch).select(F.col("node").alias("group"), "component")
        least = groups.join(joined, "group").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        nodes = groups.join(joined, "group").join(least, "component").select(F.col("doc_id").alias("own"), "component_id").distinct()
        out = signed.join(nodes, signed["doc_id"] == nodes["own"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def _texts_of(docs: DataFrame, classes: DataFrame, postings: DataFrame, scratch: Scratch) -> DataFrame:
    """id and text of the classes that have postings left."""
    wanted = postings.select("id").distinct().join(classes.select("id", "first", "key"), "id")
    rows = docs.select(F.col("doc_id").alias("first"), F.col("text").cast("binary").alias("text")).join(wanted, "first").select("id", "key", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler()  # another row of this doc_id may have another set
        for batch in batches:
            ok = pa.array([k == xxhash.xxh3_128_digest(shingles(t).tobytes()) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], ["id", "text"])

    return scratch.save(rows.mapInArrow(own, "id long, text binary").dropDuplicates(["id"]), "texts")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each group stays: that of the least doc_id.

    Rows that repeat a doc_id are one document; those without doc_id are one for each text.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    # Of rows that repeat a doc_id, or a text without one, that of the least hash; counts and minima are summed before they move.
    id_, own = F.col("doc_id"), F.xxhash64("text")
    marked = left.withColumns({"__mark": own, "__node": F.struct(id_.alias("id"), F.when(id_.isNull(), own).alias("text"))})
    least = marked.groupBy("__node").agg(F.min("__mark").alias("__least")).withColumnRenamed("__node", "__of")
    kept = marked.join(least, marked["__node"].eqNullSafe(least["__of"]) & (marked["__mark"] == least["__least"]), "left_semi")
    return kept.dropDuplicates(["__node"]).drop("__mark", "__node")
