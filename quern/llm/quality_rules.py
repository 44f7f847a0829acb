"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering grows one rule at a time: it adds the threshold test with
the best information gain until the rule covers no good document, then prunes
tests from the end while the rule's worth on held-back rows rises. Rows that a
rule covers leave the training set. The list becomes one ordered Spark
conditional expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_words, windows, word_hashes, written

SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
#: Words in a window that is looked up for repeats, and labelled rows of each class that are learned from.
WINDOW, SAMPLE = 8, 10_000
FEATURES = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "short_share": "n_short / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_short", "n_digits")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics named in _STATS of one whole text; null counts as empty."""
    data, starts, ends = text_words(text)
    n = len(starts)
    if not n:
        return (0, 0, int(_IS_SYMBOL[data].sum()), *[0] * 6)
    hashes = word_hashes(data, starts, ends)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = lead[ends] - lead[starts]
    repeated = 0
    if n > WINDOW:
        w = windows(hashes, WINDOW)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, dtype=np.int64)
            cover[: len(w)] += twice
            cover[WINDOW : WINDOW + len(w)] -= twice
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    digits = int(((data >= 48) & (data <= 57)).sum())
    return (n, int(chars.sum()), int(_IS_SYMBOL[data].sum()), dup, repeated, lines, len(np.unique(hashes)), int((chars <= 3).sum()), digits)


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [text_stats(t) for t in batch["text"]]
        out = pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(_STATS)), columns=list(_STATS))
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document's whole text, one row per row of docs."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _STATS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_stats, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.threshold if self.at_most else x[self.feature] > self.threshold

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c <= self.threshold if self.at_most else c > self.threshold


def _covered(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, tests: int) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < tests and (~bad[inside]).any():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        before, best = math.log2(p / (p + n)), (0.0, None)
        for name in FEATURES:
            v = x[name][inside]
            for cut in np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50), method="lower")):
                for at_most in (True, False):
                    hit = v <= cut if at_most else v > cut
                    p1 = int((hit & bad[inside]).sum())
                    if p1:
                        gain = p1 * (math.log2(p1 / int(hit.sum())) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Test(name, at_most, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _worth(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _covered(rule, x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 12, tests: int = 4, precision: float = 0.8) -> list[list[Test]]:
    """Rules for bad rows, in order. A rule stays if at least `precision` of the held-back rows it covers are bad."""
    out: list[list[Test]] = []
    part = np.arange(len(bad)) % 3 != 0
    while len(out) < rules and (bad & part).any():
        grow = {k: v[part] for k, v in x.items()}
        hold = {k: v[~part] for k, v in x.items()}
        rule = _grow(grow, bad[part], tests)
        while len(rule) > 1 and _worth(rule[:-1], hold, bad[~part]) >= _worth(rule, hold, bad[~part]):
            rule = rule[:-1]
        if not rule or _worth(rule, hold, bad[~part]) < 2 * precision - 1:
            break
        out.append(rule)
        rest = ~_covered(rule, x)
        x, bad, part = {k: v[rest] for k, v in x.items()}, bad[rest], part[rest]
    return out


def labelled_sample(labels: DataFrame, label: str, each: int) -> DataFrame:
    """At most `each` labelled doc_ids of either class, in the order of a hash. A doc_id with two labels takes the lower."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    parts = [one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def quality_verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = SAMPLE) -> DataFrame:
    """Statistics, base_failed and kept of each document, one row per row of docs.

    The list is learned from at most 2 * each labelled documents that pass the
    base rules; with no labels, or none of one class, it is empty and every
    document that passes the base rules is kept. Null and empty texts have zero
    statistics and fail the base rules. Repeated rows are judged alike; a null
    doc_id is judged but never learned from; other columns are not read.
    """
    stats = written(document_stats(docs), "stats")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sample = F.broadcast(labelled_sample(labels, label, each))
    seen = (
        stats.where(~failed).join(sample, "doc_id").select("doc_id", "label", *[F.expr(c).alias(k) for k, c in FEATURES.items()]).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").toPandas()
    )
    x = {k: seen[k].to_numpy(dtype=float) for k in FEATURES}
    verdict = F.lit(True)
    rule_no = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(learn_list(x, seen["label"].to_numpy() == 0)))):
        hit = rule[0].column()
        for t in rule[1:]:
            hit = hit & t.column()
        verdict = F.when(hit, F.lit(False)).otherwise(verdict)
        rule_no = F.when(hit, F.lit(k)).otherwise(rule_no)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict).alias("kept"),
        F.when(~failed, rule_no).alias("rule"),
    )
