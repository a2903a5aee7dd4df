"""Benchmark decontamination over a distributed positional inverted index.

Tasks cut their documents into segments of bounded length and store each segment's
postings: its terms, and of each the places where it stands, one list after the
other. The index is written once to the shared folder; a common term's list is
thereby split by documents, and postings never travel. Test phrases then come to the
segments in blocks of bounded size: a phrase starts from the list of its rarest term
in the segment, and the other terms' lists, moved by their offset, are intersected
with it, rarest first. Proximity starts from an item's rarest term in all documents
in the same way, with ranges of places instead of places. One block is held at a
time; with more than one, each document's matches are merged afterwards.

Defined results: null texts have no words; an item without words or id is no item;
repeated item ids count once, their terms together; repeated document rows get a row
each; an empty table gives no rows, an empty benchmark no hits; other columns are
ignored by ``contamination`` and carried along by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.scratch import Scratch

WINDOW = 13
#: Proximity matches: so many of an item's rarest terms, within so many words of the rarest.
PROXIMITY = (3, 12)
#: Bytes of benchmark text that tasks hold at a time.
BLOCK_BYTES = 8 << 20
#: Documents and words at which a segment is full (a longer document is one of its own).
SEGMENT_DOCS, SEGMENT_WORDS = 2048, 500_000
#: Candidate places that are intersected at a time.
_AT_ONCE = 1 << 20
#: Contaminated documents (16 bytes each) that are broadcast to filter a table; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

#: Lower-case letters, digits and all bytes of non-ASCII characters are kept; A-Z is lowered; the rest separates words.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Phrases:
    """Distinct word windows of test items, as rows of term numbers; -1 pads the short ones."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        known: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        terms_of: dict[str, set[int]] = {}
        for item, text in items:
            ids = [known.setdefault(w, len(known)) for w in words(text)]
            if ids:
                terms_of.setdefault(item, set()).update(ids)
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.terms = list(known)
        self.rows = np.full((len(owners), size), -1, dtype=np.int64)
        for i, w in enumerate(owners):
            self.rows[i, : len(w)] = w
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.owners = [sorted(x) for x in owners.values()]
        self.names = list(terms_of)
        self.terms_of = [np.array(sorted(x)) for x in terms_of.values()]

    def rarest(self, often: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the items that have ``least`` terms that occur, and these terms: by how often, then by their bytes."""
        place = np.empty(len(self.terms), dtype=np.int64)
        place[sorted(range(len(self.terms)), key=self.terms.__getitem__)] = np.arange(len(self.terms))
        items, rows = [], []
        for i, terms in enumerate(self.terms_of):
            terms = terms[often[terms] > 0]
            if len(terms) >= least:
                items.append(i)
                rows.append(terms[np.lexsort((place[terms], often[terms]))][:least])
        return np.array(items, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, least)


class Segment:
    """Terms of some documents and where each stands, counted in words from the segment's beginning."""

    def __init__(self, ends: np.ndarray, terms: list[bytes], counts: np.ndarray, places: np.ndarray):
        self.ends, self.terms, self.counts, self.places = ends, terms, counts, places

    @staticmethod
    def of(texts: list[list[bytes]]) -> Segment:
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        known: dict[bytes, int] = {}
        numbers = np.fromiter((known.setdefault(w, len(known)) for x in texts for w in x), dtype=np.int32, count=int(ends[-1]) if len(ends) else 0)
        return Segment(ends, list(known), np.bincount(numbers, minlength=len(known)), np.argsort(numbers, kind="stable"))

    def packed(self) -> bytes:
        """The lists as steps from place to place, each list from zero."""
        steps = np.diff(self.places, prepend=0)
        first = np.cumsum(self.counts) - self.counts
        steps[first] = self.places[first]
        return steps.astype("<i4").tobytes()

    @staticmethod
    def unpacked(ends: list[int], terms: list[bytes], counts: list[int], steps: bytes) -> Segment:
        n = np.array(counts, dtype=np.int64)
        sums = np.cumsum(np.frombuffer(steps, dtype="<i4"), dtype=np.int64)
        before = np.concatenate(([0], sums))[np.cumsum(n) - n]
        return Segment(np.array(ends, dtype=np.int64), terms, n, sums - np.repeat(before, n))

    def open(self, p: Phrases) -> None:
        """Look the phrases' terms up; all lists become one ascending row of (term, place) keys."""
        index = {t: i for i, t in enumerate(self.terms)}
        self.number = np.array([index.get(t, -1) for t in p.terms], dtype=np.int64)
        self.often = np.where(self.number >= 0, np.append(self.counts, 0)[self.number], 0)
        self.first = np.append(np.cumsum(self.counts) - self.counts, 0)[self.number]
        self.span = int(self.ends[-1]) + 1 if len(self.ends) else 1
        self.keys = np.append(np.repeat(np.arange(len(self.counts)) * self.span, self.counts) + self.places, np.iinfo(np.int64).max)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of each term, one list after the other, and which term each is of."""
        n = self.often[terms]
        which = np.repeat(np.arange(len(terms)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return self.places[self.first[terms][which] + inside], which

    def stands(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term's list has a place from low to high."""
        base = self.number[terms] * self.span
        return (self.number[terms] >= 0) & (self.keys[np.searchsorted(self.keys, base + low)] <= base + high)

    def phrases(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Start and phrase number of each exact occurrence inside a document."""
        never = np.iinfo(np.int64).max
        rarity = np.where(p.rows >= 0, self.often[p.rows], never) if len(p.rows) and len(self.places) else np.zeros((0, 1), np.int64)
        live = np.flatnonzero((rarity > 0).all(axis=1))
        turns = np.argsort(rarity[live], axis=1, kind="stable")
        lead = self.often[p.rows[live, turns[:, 0]]] if len(live) else np.zeros(0, np.int64)
        starts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(lead) // _AT_ONCE)) + 1) if len(live) else []:
            rows, lengths, turn = p.rows[live[some]], p.lengths[live[some]], turns[some]
            at, which = self.lists(rows[np.arange(len(some)), turn[:, 0]])
            start = at - turn[which, 0]
            for k in range(1, p.rows.shape[1]):
                offset = turn[which, k]
                term = rows[which, offset]
                ok = (start >= 0) & ((term < 0) | self.stands(term, start + offset, start + offset))
                start, which = start[ok], which[ok]
            ok = (start >= 0) & (start + lengths[which] < self.span)
            start, which = start[ok], which[ok]
            ok = self.document(start) == self.document(start + lengths[which] - 1)
            starts.append(start[ok])
            numbers.append(live[some][which[ok]])
        return np.concatenate(starts), np.concatenate(numbers)

    def near(self, rare: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and row number of each row of rare terms that stand within slop words of its first one."""
        if not len(rare) or not len(self.places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = self.lists(rare[:, 0])
        for k in range(1, rare.shape[1]):
            doc = self.document(at)
            begin = np.concatenate(([0], self.ends))[doc]
            ok = self.stands(rare[which, k], np.maximum(at - slop, begin), np.minimum(at + slop, self.ends[doc] - 1))
            at, which = at[ok], which[ok]
        pairs = np.unique(np.column_stack([self.document(at), which]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def build_index(docs: DataFrame) -> DataFrame:
    """segment, docs (doc_id, mark and n_words of each row in it), terms, counts and postings of all words of all rows (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    row = T.StructType([T.StructField("doc_id", kind), T.StructField("mark", T.LongType()), T.StructField("n_words", T.LongType())])
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("docs", T.ArrayType(row)), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("postings", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids, marks, texts, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            s = Segment.of(texts)
            rows = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(marks), pa.array([len(x) for x in texts], pa.int64())], names=row.names)
            cells = [pa.array([made], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], rows), pa.array([s.terms], pa.list_(pa.binary())), pa.array([s.counts], pa.list_(pa.int64())), pa.array([s.packed()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, schema.names)

        for batch in batches:
            for k in range(batch.num_rows):
                own = words(batch.column(2)[k].as_py())
                if texts and (len(texts) >= SEGMENT_DOCS or held + len(own) > SEGMENT_WORDS):
                    yield segment()
                    made, ids, marks, texts, held = made + 1, [], [], [], 0
                ids.append(batch.column(0).slice(k, 1))
                marks.append(batch.column(1).slice(k, 1))
                texts.append(own)
                held += len(own)
        if texts:
            yield segment()

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _segments(batch: pa.RecordBatch) -> Iterator[Segment]:
    """The segments of a batch with docs, terms, counts and postings as its last columns."""
    docs, terms, counts, steps = (batch.column(k) for k in range(batch.num_columns - 4, batch.num_columns))
    for k in range(batch.num_rows):
        sizes = docs[k].values.field("n_words").to_numpy(zero_copy_only=False)
        yield Segment.unpacked(np.cumsum(sizes, dtype=np.int64), terms[k].as_py(), counts[k].values.to_numpy(zero_copy_only=False), steps[k].as_py())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks of at most BLOCK_BYTES or one item; an empty block if there is none."""
    block, held, first = [], 0, True
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).dropna().toLocalIterator():
        if block and held + len(text) > BLOCK_BYTES:
            whole, block, held, first = block, [], 0, False
            yield whole
            del whole
        block.append((item, bytes(text)))
        held += len(text)
    if block or first:
        yield block


def _often(index: DataFrame, sent, size: int) -> np.ndarray:
    """How often each term of a block occurs in all documents; only the index's terms and counts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(Phrases(sent.value, size).terms)}
        counts = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for terms, n in zip(batch.column(0), batch.column(1), strict=True):
                for t, c in zip(terms.as_py(), n.values.to_numpy(zero_copy_only=False).tolist(), strict=True):
                    if t in number:
                        counts[number[t]] += c
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(Phrases(sent.value, size).terms), dtype=np.int64)
    for term, n in found.toLocalIterator():  # as many as the block has terms, at most
        out[term] = n
    return out


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_NAMES = T.ArrayType(T.StringType())


def _searched(index: DataFrame, sent, often, size: int, proximity: tuple[int, int] | None, whole: bool) -> DataFrame:
    """segment, row, doc_id, mark, n_words, runs, items and near_items of the documents that a block's items are found in, or of all."""
    row = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), *row, T.StructField("runs", _RUNS), T.StructField("items", _NAMES), T.StructField("near_items", _NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Phrases(sent.value, size)
        items, rare = p.rarest(often.value, proximity[0]) if proximity else (None, None)
        for batch in batches:
            for k, s in enumerate(_segments(batch)):
                s.open(p)
                n = len(s.ends)
                runs: list[list[dict]] = [[] for _ in range(n)]
                found: list[set[str]] = [set() for _ in range(n)]
                near: list[set[str]] = [set() for _ in range(n)]
                start, number = s.phrases(p)
                edge = np.zeros(s.span + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + p.lengths[number], -1)
                hit = np.cumsum(edge) > 0
                owner = s.document(start)
                for d in np.unique(owner).tolist():
                    a = int(s.ends[d - 1]) if d else 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit[a : s.ends[d]], [False])).astype(np.int8)))
                    runs[d] = [{"start": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()]
                for d, i in set(zip(owner.tolist(), number.tolist(), strict=True)):
                    found[d].update(p.owners[i])
                if proximity:
                    for d, i in zip(*(x.tolist() for x in s.near(rare, proximity[1])), strict=True):
                        near[d].add(p.names[items[i]])
                keep = np.arange(n) if whole else np.array([d for d in range(n) if found[d] or near[d]], dtype=np.int64)
                own = batch.column(1)[k].values.take(pa.array(keep))
                lists = [pa.array([sorted(x[d]) for d in keep], pa.list_(pa.string())) for x in (found, near)]
                cells = [pa.array(np.repeat(batch.column(0)[k].as_py(), len(keep))), pa.array(keep.astype(np.int32)), *(own.field(c) for c in row.names), pa.array([runs[d] for d in keep], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *lists]
                yield pa.RecordBatch.from_arrays(cells, schema.names)

    return index.select("segment", "docs", "terms", "counts", "postings").mapInArrow(run, schema)


def _united(runs):
    """The union of the ranges in an array of arrays of them."""
    kind = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("last"))

    def step(s, x):
        longer = F.struct(s["last"]["start"].alias("start"), F.greatest(s["last"]["end"], x["end"]).alias("end"))
        done = F.when(s["last"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["last"]))
        return F.when(x["start"] <= s["last"]["end"], F.struct(s["done"].alias("done"), longer.alias("last"))).otherwise(F.struct(done.alias("done"), x.alias("last")))

    return F.aggregate(F.array_sort(F.flatten(runs)), start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["last"])))


def _found(docs: DataFrame, benchmark: DataFrame, size: int, divisor: int, proximity: tuple[int, int] | None) -> DataFrame:
    """The columns of ``contamination``, and mark, a hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    index = scratch.save(build_index(docs), "index")
    parts: list[DataFrame] = []
    blocks = _blocks(benchmark)
    while (block := next(blocks, None)) is not None:
        sent, often = spark.sparkContext.broadcast(block), None
        del block  # tasks and the driver hold one at a time
        if proximity:
            often = spark.sparkContext.broadcast(_often(index, sent, size))
        parts.append(scratch.save(_searched(index, sent, often, size, proximity, whole=not parts), "found"))
        for x in (sent, often) if proximity else (sent,):
            x.destroy()
    scratch.drop(index)
    out = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("segment", "row").agg(*(F.first(c).alias(c) for c in ("doc_id", "mark", "n_words")), _united(F.collect_list("runs")).alias("runs"), names("items"), names("near_items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = out.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", "mark", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (divisor * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "runs", "items", *(["near_items"] if proximity else []),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, divisor: int = 20, proximity: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs, items for each document row.

    runs are the hit word ranges (start, end), items the ids whose windows occur, both
    sorted. With proximity=(terms, slop), near_items also lists the items of which that
    many of the rarest terms, by their count in all documents, stand within slop words
    of one place of the rarest.
    """
    return _found(docs, benchmark, size, divisor, proximity).drop("mark")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, divisor: int = 20) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated.

    Rows stay where they lie while the contaminated ones are at most BROADCAST_KEYS;
    beyond, both are shuffled.
    """
    bad = _found(docs, benchmark, size, divisor, None).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    bad = Scratch(docs.sparkSession).save(bad, "contaminated")
    few = bad.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__mark"]), "left_anti")
