"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance to offend is a logistic function of its words and their beginnings; a document's is the noisy-or of its
sentences' chances and a small leak. Weights are trained from document labels alone, and then point at the sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_for, returning, small_batches

SENTENCE = re.compile(r"[^.!?\n。！？]+[.!?。！？]*")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bounds of the training sample: labelled rows of each label, code points of a row's text; and of the features kept.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS, MAX_FEATURES = 1500, 3000, 20_000, 20_000
#: Words whose features a worker remembers.
KNOWN_WORDS = 400_000


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float

    def score(self, p: Iterable[float]) -> float:
        """Noisy-or of sentence chances and the leak."""
        clean = 1 - self.leak
        for x in p:
            clean *= 1 - x
        return 1 - clean


class Scorer:
    """Sentence and document chances of texts; remembers the features of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def _features(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = tuple(f for f in word_features(word) if f in self.model.weights)
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, chance) of each sentence that holds a feature of the model."""
        out, known, slow, w = [], self.known, self._features, self.model.weights
        for m in SENTENCE.finditer(text):
            hit: set[str] = set()
            for word in WORD.findall(m.group().lower()):
                f = known.get(word)
                if f is None:
                    f = slow(word)
                if f:
                    hit.update(f)
            if hit:
                z = self.model.bias + sum(w[f] for f in sorted(hit))
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its sentences with features. Equal chances of repeated sentences count once, as do all sentences without a feature."""
        found = self.sentences(text)
        plain = 1 / (1 + np.exp(-self.model.bias)) if text.strip() else 0.0
        return min(1.0, max(0.0, float(self.model.score([plain, *sorted({p for _, _, p in found})])))), found


def train(rows: list[tuple[str, int]], *, steps: int = 400, rate: float = 0.05, decay: float = 3.0) -> Model:
    """Fit weights, bias and leak to (text, label) rows by Adam on the noisy-or likelihood; equal rows give an equal model."""
    labels = np.array([y for _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model({}, -30.0, float(labels.mean()) if len(rows) else 0.0)
    n1, n0 = labels.sum(), (1 - labels).sum()
    # a feature needs toxic documents, so those alone give candidates; texts are read again rather than kept as sets
    toxic, clean = Counter(), Counter()
    for text, y in rows:
        if y:
            toxic.update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
    toxic = {f: n for f, n in toxic.items() if n >= max(2, n1 / 100)}
    for text, y in rows:
        if not y:
            clean.update({f for w in set(WORD.findall(text.lower())) for f in word_features(w) if f in toxic})
    lift = {f: (n + 0.5) / (n1 + 1) / ((clean[f] + 0.5) / (n0 + 1)) for f, n in toxic.items()}
    kept = sorted((f for f, x in lift.items() if x >= 3), key=lambda f: (-lift[f] * np.log1p(toxic[f]), f))[:MAX_FEATURES]
    number = {f: i for i, f in enumerate(kept)}
    doc, sent, col = [], [], []
    n = 0
    for d, (text, _) in enumerate(rows):
        bag = set()
        for m in SENTENCE.finditer(text):
            bag.add(tuple(sorted({number[f] for w in set(WORD.findall(m.group().lower())) for f in word_features(w) if f in number})))
        for known in sorted(bag) or [()]:
            doc.append(d)
            sent += [n] * len(known)
            col += known
            n += 1
    doc, sent, col = np.array(doc), np.array(sent, np.int64), np.array(col, np.int64)
    w = np.zeros(len(kept) + 2)  # weights, bias, logit of the leak
    rare = np.array([5 / (5 + toxic[f]) for f in kept])  # little evidence: a smaller start and a stronger pull to zero
    w[:-2], w[-2], w[-1] = np.array([min(3.0, np.log(lift[f])) for f in kept]) * (1 - rare), -5.0, -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(sent, weights=w[col], minlength=n) + w[-2]
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        log_clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(rows)) + np.log1p(-leak)
        whole = np.clip(-np.expm1(log_clean), 1e-9, 1.0)
        push = np.where(labels > 0, -np.exp(log_clean) / whole, 1.0)  # of the loss against -log of (1 - chance)
        g = p * push[doc]
        grad = np.concatenate([np.bincount(col, weights=g[sent], minlength=len(kept)), [g.sum(), leak * push.sum()]]) / len(rows)
        grad[:-2] += decay * rare * w[:-2] / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[-1] = min(w[-1], -2.5)
    return Model({f: float(x) for f, x in zip(kept, w, strict=False) if abs(x) > 0.3}, float(w[-2]), float(1 / (1 + np.exp(-w[-1]))))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample: labelled rows that are not held out, in an order drawn by hashing the key."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    short = docs.select(F.col(key).alias("key"), F.length(text).alias("n")).filter(F.col("n") <= MAX_CHARS).select("key").distinct()
    marked = marked.join(short, "key").withColumn("draw", F.xxhash64("key"))
    picked = [marked.filter(F.col("y") == y).orderBy("draw", "key").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most MAX_TOXIC + MAX_CLEAN rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") <= MAX_CHARS).join(picked, "key")
    rows = rows.groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.max("draw").alias("draw"))
    return [(r["text"], r["y"]) for r in sorted(rows.collect(), key=lambda r: (r["draw"], r["key"]))]


def score_documents(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """Per row: key, held_out, score, predicted, offending (start, end, chance of each sentence above its threshold, as code point offsets).

    Null and empty texts have no sentence: their score is the leak. Every row, repeated or with a null key, gives a row. Only the text
    enters the score; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    sentence = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("toxicity")  # nothing: words are remembered for a task
        scorer = Scorer(shared.value)
        for b in batches:
            scores, offending = [], []
            for t in b.column("text"):
                s, found = scorer.document(t.as_py() or "")
                scores.append(s)
                offending.append([{"start": x, "end": y, "chance": p} for x, y, p in found if p >= sentence_threshold])
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(offending, pa.list_(sentence))],
                ["key", "held_out", "score", "predicted", "offending"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(returning(score), f"key {kind}, held_out boolean, score double, predicted int, offending array<struct<start: int, end: int, chance: double>>")
    return out.withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("toxicity")  # nothing: words are remembered for a task
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.document(t.as_py() or "")[0] < threshold for t in b.column(text)], pa.bool_()))

    return docs.mapInArrow(returning(clean), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Train on the labelled rows that are not held out, and score every row (see ``score_documents``)."""
    return score_documents(docs, train(training_rows(docs, labels, key=key, text=text, label=label)), key=key, text=text, threshold=threshold)
