"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case and maps homoglyphs of other scripts and digits or signs that
stand for letters to one letter, character by character, so positions stay. The
lexicon is a list of known terms and the stems that labelled documents teach: word
beginnings that toxic documents hold and others don't, each weighted by its log
odds. A match counts if it begins a word and no exception phrase covers it. The
score is logistic in two sums of the matched weights: absolute, and by length.

Defined results: null and empty texts have no matches and get the score of such
texts; with labels of one kind only, known terms keep their prior weights; repeated
rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.minhash import Shingler
from parley.llm.samples import labelled
from parley.llm.scratch import Scratch

#: Most labelled documents of each class that the lexicon and the score are fitted on.
PER_CLASS = 3000
#: A stem is learned at these log odds and has so many letters; its likelihood ratio statistic must exceed what chance
#: reaches among all that are tried: twice the logarithm of their number, and this.
LEAST_ODDS, STEM, ABOVE_CHANCE = 2.5, (4, 10), 3.0
#: Most stems that are learned, by likelihood ratio.
MOST_STEMS = 5000
PRIOR_WEIGHT = 2.0

#: Terms known to insult, with prior weight until labels say otherwise.
KNOWN = ("disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "worthless")
#: Phrases in which a term, known or learned, is harmless.
EXCEPTIONS = ("class clown", "clown fish", "good loser", "trash bag", "trash bin", "trash can", "trash collection")
#: Characters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ѵ": "v", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and signs that stand for letters; l joins i, which 1 may mean either of.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}


def _folding() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    # Full-width and mathematical letters and digits, by their compatibility forms.
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA)]:
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    return {k: SUBSTITUTES.get(v, v) for k, v in table.items()}


_FOLDING = _folding()


def lowered(text: str | None) -> str:
    """Lower case; a character whose lower case has several characters stays."""
    if not text:
        return ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def folded(low: str) -> str:
    return low.translate(_FOLDING)


def _begins(low: str, at: int) -> bool:
    return at == 0 or not low[at - 1].isalnum()


@dataclass
class Lexicon:
    """Weights of folded stems, exception phrases and the score's coefficients (bias, absolute, by length)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    score: tuple[float, float, float] = (-3.0, 3.0, 0.5)
    _machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return (self.weights, self.exceptions, self.score)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.score = state
        self._machine = None

    def _automaton(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._machine.add_word(folded(phrase), (len(phrase), None))
            for stem, weight in self.weights.items():
                self._machine.add_word(stem, (len(stem), weight))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def matches(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count; of those with one start, the longest."""
        machine, low = self._automaton(), lowered(text)
        if not low or not len(machine):
            return []
        found: dict[int, tuple[int, float]] = {}
        harmless: list[tuple[int, int]] = []
        for last, (size, weight) in machine.iter(folded(low)):
            start = last - size + 1
            if _begins(low, start):
                if weight is None:
                    harmless.append((start, last + 1))
                elif start not in found or found[start][0] < last + 1:
                    found[start] = (last + 1, weight)
        return [(a, b, w) for a, (b, w) in sorted(found.items()) if not any(x <= a and b <= y for x, y in harmless)]

    def sums(self, text: str | None) -> tuple[float, float, int]:
        """The logarithms of the matched weight and of the weight per 100 words, and the matches' number."""
        found = self.matches(text)
        total = sum(w for _, _, w in found)
        return math.log1p(total), math.log1p(100 * total / ((text or "").count(" ") + 1)), len(found)

    def probability(self, absolute: float, dense: float) -> float:
        bias, a, d = self.score
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * absolute + d * dense))))


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each label have a word with each beginning, summed in the partition."""
    import re

    word, counts = re.compile(r"[^\W_]+"), (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tokens = {w[: STEM[1]] for w in word.findall(folded(lowered(text))) if len(w) >= STEM[0]}
            counts[label].update({w[:n] for w in tokens for n in range(STEM[0], len(w) + 1)})
    keys = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["stem", "bad", "good"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample with a MinHash of each text: near copies mostly share it."""
    shingles = Shingler()
    for batch in batches:
        sets = [shingles((t or "").encode()) for t in batch.column(1).to_pylist()]
        keys = [int(s[0].view(np.int64)) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "text", "label", "key"])


def _likelihood(bad: float, good: float, all_bad: int, all_good: int) -> float:
    """The G statistic of a 2 x 2 table."""
    total, seen = all_bad + all_good, bad + good
    cells = ((bad, all_bad, seen), (good, all_good, seen), (all_bad - bad, all_bad, total - seen), (all_good - good, all_good, total - seen))
    return 2 * sum(o * math.log(o * total / (row * col)) for o, row, col in cells if o > 0)


def _stems(counted: dict[str, tuple[int, int]], all_bad: int, all_good: int) -> dict[str, float]:
    odds = lambda b, g: math.log((b + 0.5) / (all_bad + 1)) - math.log((g + 0.5) / (all_good + 1))
    least = 2 * math.log(max(2, len(counted))) + ABOVE_CHANCE
    strong = {s for s, (b, g) in counted.items() if odds(b, g) >= LEAST_ODDS and _likelihood(b, g, all_bad, all_good) >= least}
    out = {}
    for stem in sorted(strong, key=len):
        if any(stem[:n] in strong for n in range(STEM[0], len(stem))):
            continue  # a shorter stem says it
        # A longer one that nearly all toxic uses share says it with less risk.
        while longer := [s for s, (b, _) in counted.items() if len(s) == len(stem) + 1 and s.startswith(stem) and b >= 0.98 * counted[stem][0]]:
            stem = longer[0]
        out[stem] = odds(*counted[stem])
    return out


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Learn weights and score from at most per_class labelled documents of each class."""
    sample = labelled(docs, labels, column, allowed, per_class)
    # Copies of a toxic text would make all its rare words look toxic: of those that share a key, the least doc_id's stays.
    keyed = T.StructType([*sample.schema, T.StructField("key", T.LongType())])
    least = sample.mapInArrow(_keyed, keyed).groupBy("label", "key").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    sample = Scratch(docs.sparkSession).save(least.select("x.doc_id", "x.text", "label"), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weights = {folded(w): PRIOR_WEIGHT for w in KNOWN}
    all_bad, all_good = sizes.get(1, 0), sizes.get(0, 0)
    if not all_bad or not all_good:
        return Lexicon(weights)
    counted = sample.mapInArrow(_beginnings, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = F.log((F.col("bad") + 0.5) / (all_bad + 1)) - F.log((F.col("good") + 0.5) / (all_good + 1))
    rows = counted.filter((F.col("bad") > 1) & (rate >= LEAST_ODDS)).orderBy(F.desc("bad"), "good", "stem").limit(MOST_STEMS * 10).collect()
    learned = _stems({r["stem"]: (r["bad"], r["good"]) for r in rows}, all_bad, all_good)
    lexicon = Lexicon(weights | dict(sorted(learned.items(), key=lambda x: -x[1])[:MOST_STEMS]))
    x = np.array([[1.0, r["absolute"], r["dense"], r["label"]] for r in _summed(sample, lexicon, ["label"]).collect()])
    lexicon.score = tuple(_logistic(x[:, :3], x[:, 3], np.where(x[:, 3] == 1, 0.5 / all_bad, 0.5 / all_good)))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _summed(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("absolute", T.DoubleType()), T.StructField("dense", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for batch in batches:
            rows = [lex.sums(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            score = [lex.probability(a, d) for a, d, _ in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(score, pa.float64())], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted and n_matches for each row."""
    return _summed(docs, lexicon, ["doc_id"]).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
