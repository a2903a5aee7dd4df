"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by shape
measures (repetition, symbols, word lengths, casing, punctuation) and a learned
layer; gated attention, learned from document labels alone, weighs the passages;
the weighted mean is scored. The network has about a thousand numbers, is fitted on
a bounded sample and sent to the tasks; documents are scored where they lie.

Defined results: null and empty texts are one empty passage; with labels of one
kind only, every document gets that kind's score; repeated rows get a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.samples import labelled

PASSAGE = 64
#: Most labelled documents of each class that the network is fitted on.
PER_CLASS = 2000
#: Most passages of a document that it is fitted on, evenly spread over the text; all are scored.
FIT_PASSAGES = 256
HIDDEN, GATE, EPOCHS, SEED = 16, 8, 300, 11
MEASURES = 12

_SIGNS = "|%$#&*@^~=+<>{}[]\\_/"


def encode(words: list[str]) -> list[float]:
    """Shape measures of a passage."""
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    text = " ".join(words)
    size = len(text)
    counts = Counter(words)
    signs = sum(map(text.count, _SIGNS))
    ends = [w[-1] for w in words]
    return [
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        signs / size,
        words.count("|") / n,
        sum(e in _SIGNS for e in ends) / n,
        sum(e in ".!?" for e in ends) / n,
        sum(e == "," for e in ends) / n,
        sum(map(str.isdigit, text)) / size if any(d in text for d in "0123456789") else 0.0,
        sum(w[0].isupper() for w in words) / n,
        size / n / 10,
        n / PASSAGE,
    ]


def passages(text: str | None) -> list[list[float]]:
    words = (text or "").split()
    return [encode(words[k : k + PASSAGE]) for k in range(0, max(1, len(words)), PASSAGE)]


def spread(bag: list[list[float]], most: int = FIT_PASSAGES) -> list[list[float]]:
    """At most so many passages of a document, from its beginning to its end."""
    return bag if len(bag) <= most else [bag[k * (len(bag) - 1) // (most - 1)] for k in range(most)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages x; bags begin at starts and lie one after the other."""
        w = self.weights
        f = (x - self.mean) / self.scale
        h = np.tanh(f @ w["encode"] + w["encode_bias"])
        gate_t, gate_s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["sigm"])
        raw = (gate_t * gate_s) @ w["attend"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * attention[:, None], starts, axis=0)
        return {"f": f, "h": h, "t": gate_t, "s": gate_s, "a": attention, "z": z, "p": _sigmoid(z @ w["score"] + w["score_bias"]), "sizes": sizes}

    def scores(self, bags: list[list[list[float]]]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        sizes = np.array([len(b) for b in bags])
        return self.forward(np.array([p for b in bags for p in b]), np.cumsum(sizes) - sizes)["p"]


def train(bags: list[list[list[float]]], labels: np.ndarray) -> Network:
    """Fit by Adam on cross-entropy, classes weighted equally."""
    x = np.array([p for b in bags for p in b])
    sizes = np.array([len(b) for b in bags])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, {"encode": draw(MEASURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "tanh": draw(HIDDEN, GATE), "sigm": draw(HIDDEN, GATE), "attend": draw(GATE), "score": draw(HIDDEN), "score_bias": np.zeros(1)})
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    for turn in range(1, EPOCHS + 1):
        w, y = net.weights, net.forward(x, starts)
        d = share * (y["p"] - labels)
        dz = np.repeat(d, sizes)[:, None] * w["score"]
        da = (dz * y["h"]).sum(axis=1)
        draw_ = y["a"] * (da - np.repeat(np.add.reduceat(y["a"] * da, starts), sizes))
        gate = draw_[:, None] * w["attend"]
        dt, ds = gate * y["s"] * (1 - y["t"] ** 2), gate * y["t"] * y["s"] * (1 - y["s"])
        dh = (dz * y["a"][:, None] + dt @ w["tanh"].T + ds @ w["sigm"].T) * (1 - y["h"] ** 2)
        slopes = {"encode": y["f"].T @ dh, "encode_bias": dh.sum(axis=0), "tanh": y["h"].T @ dt, "sigm": y["h"].T @ ds, "attend": (y["t"] * y["s"]).T @ draw_, "score": y["z"].T @ d, "score_bias": np.array([d.sum()])}
        for k, g in slopes.items():
            g = g + 1e-5 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return net


_BAG = T.ArrayType(T.ArrayType(T.DoubleType()))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "quality", per_class: int = PER_CLASS) -> Network:
    """Train on at most per_class labelled documents of each class; only the measures of at most FIT_PASSAGES passages of each come to the driver."""
    sample = labelled(docs, labels, column, allowed, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [spread(passages(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.list_(pa.list_(pa.float64())))], ["doc_id", "label", "bag"])

    schema = T.StructType([sample.schema["doc_id"], sample.schema["label"], T.StructField("bag", _BAG)])
    rows = sample.mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "label").collect()
    if not rows:
        return train([passages("")], np.array([1.0]))
    return train([r["bag"] for r in rows], np.array([float(r["label"]) for r in rows]))


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """All columns of docs and __score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema, T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                out = sent.value.scores([passages(t) for t in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score and predicted for each row."""
    return scored(docs.select("doc_id", "text"), network).select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    return scored(docs, network).filter("__score >= 0.5").drop("__score")
