"""Packing by concatenation: the corpus is one long id stream, cut every ``length`` ids.

Pass 1 tokenizes each text once and stores its ids, with the ids that precede it
in its partition. A prefix sum over the partitions' totals (one row a partition)
then gives each document its place in the stream, and pass 2 cuts at multiples of
``length``. No document moves between machines in either pass.

Defined results: null and empty texts hold only the end id; repeated rows are
packed each by itself; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.llm.scratch import Scratch

#: Partition totals are broadcast up to this many rows (16 bytes each) and joined by a shuffle beyond.
BROADCAST_PARTITIONS = 1_000_000

#: Fixed value: the split pattern of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile(r"[\t-\r -~\xa1-\u017f]*")


@lru_cache(maxsize=2)
def _load(tokenizer_path: str):
    """The tokenizer and, where its vocabulary allows, a quicker encoder of the same ids.

    The quick one reads the same file: in byte-level BPE whose merges are numbered
    in order, ids are merge ranks.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    vocab = model.get("vocab") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or []]
    if not plain or model.get("type") != "BPE" or any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return whole, None, ()
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    ranks = {bytes(bytes_of[c] for c in w): i for w, i in vocab.items() if w not in special}
    return whole, tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), special


class TextEncoder:
    """Ids of whole texts, as little-endian bytes of 2 or 4 each.

    The quick encoder takes texts of Latin script without special tokens; where the
    two libraries' character classes could differ, the tokenizer itself is asked.
    """

    def __init__(self, tokenizer_path: str, wide: bool):
        self.whole, self.quick, self.special = _load(tokenizer_path)
        self.code = "I" if wide else "H"

    def _plain(self, text: str) -> bool:
        return self.quick is not None and _LATIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        ids = self.quick.encode_ordinary(text) if self._plain(text) else self.whole.encode(text, add_special_tokens=False).ids
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0, wide: bool = False) -> DataFrame:
    """doc_id, part, before (ids before it in its partition), n, ids (little-endian, 2 or, if wide, 4 bytes each)."""
    dtype = "<u4" if wide else "<u2"
    end = np.array([end_id], dtype=dtype).tobytes()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, before = TextEncoder(tokenizer_path, wide), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [encoder.encode(t or "") + end for t in some.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64) // len(end)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])
                before = int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, wide: bool = False, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, its ids."""
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.save(tokenize(docs, tokenizer_path, end_id, wide), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    bases = scratch.save(bases, "bases")
    placed = tokens.join(F.broadcast(bases) if bases.count() <= BROADCAST_PARTITIONS else bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    kind = docs.schema["doc_id"].dataType
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in longs), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    dtype = "<u4" if wide else "<u2"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, pieces = [], [], []
            for i, (at, n, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                stream = np.frombuffer(ids, dtype=dtype).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = stream[start : start + size].tobytes()
                    rows.append((start, size, zlib.crc32(piece), n, sequence, offset))
                    owners.append(i)
                    if with_ids:
                        pieces.append(piece)
                    start += size
            table = np.array(rows, dtype=np.int64).reshape(-1, len(longs))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(table[:, k]) for k in range(len(longs))), *([pa.array(pieces, pa.binary())] if with_ids else [])], [f.name for f in schema])

    return placed.mapInArrow(cut, schema)
