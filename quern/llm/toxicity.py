"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

From a bounded sample of labelled texts, each n-gram's presence is counted in
toxic and in other documents. The log ratio of the two smoothed shares scales
the feature; n-grams whose ratio is clear of chance are kept, and a logistic
regression weighs them. Scoring adds the weights of the kept n-grams that a
text holds; each counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed
from .quality_rules import labelled_sample

#: n-gram lengths; labelled rows of each class to learn from; kept n-grams; how clear of chance, in standard errors.
LENGTHS, SAMPLE, KEPT, CLEAR = (3, 4, 5, 6), 3_000, 4_096, 4.5
_SLOT_BITS, _CHUNK = 20, 1 << 17


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """First index and texts of runs of about _CHUNK characters; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > _CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def grams(texts: list[str], lengths: Sequence[int] = LENGTHS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the text number and the 64-bit hash of every n-gram of lower-cased texts; white space counts as one blank."""
    joined = "\0" + "\0".join(t.replace("\0", " ").lower() for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    cut = codes == 0
    owner = (np.cumsum(cut) - 1).astype(np.int32)
    last_cut = np.maximum.accumulate(np.where(cut, np.arange(len(codes)), -1))
    h = codes.copy()
    for n in range(2, max(lengths) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in lengths:
            whole = last_cut[n - 1 :] < np.arange(len(h))
            yield owner[: len(h)][whole], mixed(h[whole] + np.uint64(n))


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the kept n-grams
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.slots[(self.keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and index of each kept n-gram that a text holds, each pair once."""
        found = []
        for owner, h in grams(texts):
            maybe = np.flatnonzero(self.slots[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
            k = np.searchsorted(self.keys, h[maybe])
            k[k == len(self.keys)] = 0
            good = self.keys[k] == h[maybe] if len(self.keys) else np.zeros(0, dtype=bool)
            found.append(owner[maybe][good].astype(np.int64) << 32 | k[good])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.keys):
            for first, part in _chunks(texts):
                doc, k = self.hits(part)
                out[first : first + len(part)] += np.bincount(doc, weights=self.weights[k], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _presence(texts: list[str], of: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each text and its distinct n-gram hashes; of: only those in these slots."""
    for first, part in _chunks(texts):
        owners, hashes = zip(*grams(part))
        owner, h = np.concatenate(owners), np.concatenate(hashes)
        if of is not None:
            keep = of[(h >> np.uint64(64 - 22)).astype(np.int64)]
            owner, h = owner[keep], h[keep]
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
        ends = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in range(len(part)):
            yield first + i, np.unique(h[ends[i] : ends[i + 1]])


def _clear(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio, and how many standard errors it is from 0."""
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return ratio, np.abs(ratio) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def train(texts: list[str], label: np.ndarray, odds: float, kept: int = KEPT, l2: float = 2e-4, steps: int = 400) -> Model:
    """odds: toxic documents to one other document among all labelled ones; the sample is weighted to it."""
    n_pos, n_neg = int(label.sum()), int((1 - label).sum())
    empty = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -50.0 if not n_pos else 50.0 if not n_neg else float(np.log(odds)))
    if not n_pos or not n_neg:
        return empty
    counts = np.zeros((2, 1 << 22), dtype=np.int32)
    for i, h in _presence(texts, None):
        counts[label[i], np.unique((h >> np.uint64(42)).astype(np.int64))] += 1
    part = 1 << 18  # the sums of all slots at once would be large
    slots = np.concatenate([_clear(counts[1][i : i + part], counts[0][i : i + part], n_pos, n_neg)[1] >= CLEAR for i in range(0, 1 << 22, part)])
    del counts
    docs, hashes = [], []
    for i, h in _presence(texts, slots):
        docs.append(np.full(len(h), i))
        hashes.append(h)
    keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    doc = np.concatenate(docs)
    pos = np.bincount(inverse, weights=label[doc], minlength=len(keys))
    neg = np.bincount(inverse, weights=1 - label[doc], minlength=len(keys))
    ratio, clear = _clear(pos, neg, n_pos, n_neg)
    best = np.sort(np.argsort(-clear, kind="stable")[:kept])
    best = best[clear[best] >= CLEAR]
    if not len(best):
        return empty
    place = np.full(len(keys), -1)
    place[best] = np.arange(len(best))
    use = place[inverse] >= 0
    doc, f, r = doc[use], place[inverse][use], ratio[best]
    weight = np.where(label == 1, odds / n_pos, 1 / n_neg)
    weight /= weight.sum()
    w, b = np.zeros(len(best)), float(np.log(odds))
    m = np.zeros(len(best) + 1)
    v = np.zeros(len(best) + 1)
    for step in range(1, steps + 1):  # Adam on the weighted log loss
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=(w * r)[f], minlength=len(label)) + b, -50, 50)))
        err = weight * (p - label)
        g = np.append(np.bincount(f, weights=err[doc], minlength=len(best)) * r + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return Model(keys[best], w * r, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = SAMPLE, rows: Column | None = None) -> Model:
    """Learn from at most `each` labelled documents of either class, whole texts; rows: which labelled doc_ids may be used."""
    labels = labels.where(rows) if rows is not None else labels
    totals = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    sample = labelled_sample(labels, label, each)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").toPandas()
    seen = seen.drop_duplicates("doc_id").sort_values("doc_id")
    texts, label = [t or "" for t in seen["text"]], seen["label"].to_numpy(dtype=np.int64)
    del seen
    return train(texts, label, totals.get(1, 0) / max(1, totals.get(0, 0)) or 1.0)


def score_of(model: Model, text: Column, spark: SparkSession) -> Column:
    """The score of a text column (0 to 1); null counts as empty."""
    held = spark.sparkContext.broadcast((model.keys, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*held.value)
        for part in texts:
            yield pd.Series(own.scores(part.tolist()))

    return score(text.cast("string"))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 up) of each whole text, one row per row of docs.

    Null and empty texts hold no n-gram and get the score of the bias alone.
    With labels of a single class the score is that class's for every text.
    Repeated rows score alike; only `text` is an input of the score; other
    columns are not read.
    """
    scored = docs.select(F.col("doc_id").alias("doc_id"), score_of(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores under 0.5."""
    return docs.where(score_of(model, F.col("text"), docs.sparkSession) < 0.5)
