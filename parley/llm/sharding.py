"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together. For
each boundary between shards an interval of keys is kept; a round counts the exact
bytes between candidate keys over all partitions (at most PROBES keys a boundary,
whatever the data) and narrows each interval to the two keys around the target,
until a key is within tolerance. Then rows are exchanged once. A group of equal
texts is only cut where keeping it whole would miss the tolerance.

Defined results: a null text has size 1 and the hash of its null; an empty text
size 1; repeated rows can't be told apart and share a shard; an empty table gives
no rows; other columns are carried along by ``shard_documents``, but for those named
size, shard and slot, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.scratch import Scratch

PROBES = 32
#: Permitted distance of a boundary from its target, as a part of a shard's bytes.
TOLERANCE = 0.001
#: Ranges into which a shard's rows are split to number them.
RANGES = 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Key:
    """A place between rows: rows whose (hash, id) is less lie below it."""

    hash: int
    id: int

    def number(self) -> int:
        return ((self.hash - _LOW) << 64) + (self.id - _LOW)

    @staticmethod
    def of(number: int) -> Key:
        return Key((number >> 64) + _LOW, (number & ((1 << 64) - 1)) + _LOW)


def _rank(keys: list[Key]) -> Column:
    """How many of the ordered keys are at or below the row's key, as a binary search."""

    def literal(x: int) -> str:
        return f"{x}L" if x > _LOW else f"({x + 1}L - 1L)"

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        h, d = literal(keys[mid].hash), literal(keys[mid].id)
        return f"if(__hash < {h} or (__hash = {h} and __id < {d}), {search(lo, mid)}, {search(mid + 1, hi)})"

    return F.expr(search(0, len(keys)))


def _counts(keyed: DataFrame, keys: list[Key]) -> list[tuple[int, Key | None, Key | None]]:
    """Bytes, least and greatest key between each two neighbouring keys."""
    place = F.struct("__hash", "__id")
    got = keyed.groupBy(_rank(keys).alias("slot")).agg(F.sum("__size").alias("bytes"), F.min(place).alias("least"), F.max(place).alias("most")).collect()
    by = {r["slot"]: (r["bytes"], Key(*r["least"]), Key(*r["most"])) for r in got}
    return [by.get(i, (0, None, None)) for i in range(len(keys) + 1)]


def splitters(keyed: DataFrame, shares: int, tolerance: float = TOLERANCE) -> list[Key]:
    """Keys that cut the rows into ``shares`` parts of near equal bytes."""
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    if not total:
        return [Key(_HIGH, _HIGH)] * (shares - 1)
    slack = max(1.0, tolerance * total / shares)
    targets = [total * i / shares for i in range(1, shares)]
    # Per boundary: the greatest key known to have at most the target below it, the least known to have more, and their bytes.
    ends = [[(0, 0), (1 << 128, total)] for _ in targets]
    done: dict[int, int] = {}
    while len(done) < len(targets):
        probes = set()
        for i, ((a, _), (b, _)) in enumerate(ends):
            if i not in done:
                probes.update(a + (b - a) * k // (PROBES + 1) for k in range(1, PROBES + 1))
                # The starts of the hash groups at the ends: cutting there keeps equal texts together.
                probes.update(x for x in (((a >> 64) + 1) << 64, (b >> 64) << 64) if a < x < b)
        probes = sorted(x for x in probes if 0 < x < 1 << 128)
        got = _counts(keyed, [Key.of(x) for x in probes])
        below, at, seen = 0, [], []
        for n, (size, least, most) in enumerate(got):
            if least is not None:
                # The bytes below the first row of a slot are those of the slots before it.
                seen += [(least.number(), below), (most.number() + 1, below + size)]
            below += size
            if n < len(probes):
                at.append((probes[n], below))
        for i, target in enumerate(targets):
            if i in done:
                continue
            known = sorted({*ends[i], *at, *seen})
            near = [x for x in known if abs(x[1] - target) <= slack]
            if whole := [x for x in near if x[0] & ((1 << 64) - 1) == 0]:
                done[i] = min(whole, key=lambda x: abs(x[1] - target))[0]
                continue
            low = max((x for x in known if x[1] <= target), key=lambda x: (x[1], x[0]))
            high = min((x for x in known if x[1] > target), key=lambda x: (x[1], x[0]), default=(1 << 128, total))
            same_group = low[0] >> 64 == (high[0] - 1) >> 64
            if near and same_group or high[0] - low[0] <= 1 or [low, high] == ends[i]:
                done[i] = min([low, high, *near], key=lambda x: abs(x[1] - target))[0]
            else:
                ends[i] = [low, high]
    return [Key.of(min(done[i], (1 << 128) - 1)) for i in range(len(targets))]


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of docs, with size, shard and slot, a gapless number in the shard."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns({"__size": size, "__hash": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))})
    narrow = scratch.save(keyed.select("__size", "__hash", "__id"), "keys")
    cuts = sorted(splitters(narrow, shards, tolerance), key=Key.number)
    # Inside a shard, rows are numbered by ranges of even hash width; their counts give each range's first number.
    edges = [0, *(k.number() for k in cuts), 1 << 128]
    inner = [Key.of(min(a + (b - a) * k // RANGES, (1 << 128) - 1)) for a, b in zip(edges, edges[1:], strict=False) for k in range(1, RANGES)]
    shard = _rank(cuts)
    ranges = narrow.withColumns({"__shard": shard, "__range": _rank(sorted(inner, key=Key.number))})
    # A range of a hot text has more rows than others: it is dealt out by doc_id, in parts of at most the mean.
    counted = ranges.groupBy("__shard", "__range").count().collect()
    mean = max(1, sum(r["count"] for r in counted) // (shards * RANGES))
    parts = {(r["__shard"], r["__range"]): -(-r["count"] // (2 * mean)) for r in counted}
    wide = {k: n for k, n in parts.items() if n > 1}
    number = F.col("__shard") * len(edges) * RANGES + F.col("__range")

    def looked_up(table: dict[tuple[int, int], int], otherwise: int) -> Column:
        if not table:
            return F.lit(otherwise)
        pairs = [F.lit(x) for (s, g), v in table.items() for x in (s * len(edges) * RANGES + g, v)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), number), F.lit(otherwise))

    def dealt(df: DataFrame) -> DataFrame:
        placed = df.withColumns({"__shard": shard, "__range": _rank(sorted(inner, key=Key.number))})
        return placed.withColumn("__deal", F.pmod(F.xxhash64("__id"), looked_up(wide, 1).cast("long")).cast("int"))

    # The first number of each part: its shard's rows before it.
    sizes = sorted(tuple(r) for r in dealt(narrow).groupBy("__shard", "__range", "__deal").count().collect())
    rows, n = [], dict.fromkeys(range(shards), 0)
    for s, g, d, count in sizes:
        rows.append((s, g, d, n[s]))
        n[s] += count
    first = docs.sparkSession.createDataFrame(rows, "__shard int, __range int, __deal int, __first long")
    # At most (shards x RANGES x 2) rows, whatever the data.
    part = ["__shard", "__range", "__deal"]
    numbered = dealt(keyed).withColumn("__row", F.row_number().over(Window.partitionBy(*part).orderBy("__hash", "__id")) - 1)
    out = numbered.join(F.broadcast(first), part)
    return out.withColumns({"size": F.col("__size"), "shard": F.col("__shard").cast("int"), "slot": F.col("__first") + F.col("__row")}).drop("__size", "__hash", "__id", "__row", "__first", *part)


def digests(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The op8 contract's columns; only ids and checksums take part in the exchange."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = shard_documents(docs.select("doc_id", "text", crc.alias("text_crc32")), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
