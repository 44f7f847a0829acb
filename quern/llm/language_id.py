"""Language identification by words first, backing off to shorter and shorter character n-grams.

From a bounded sample of texts with known language, a log frequency per
language is kept for every word seen twice and for the n-grams inside words.
A known word adds its own log frequencies. An unseen word adds the mean of
its longest n-grams that are known: those of five characters, else four, and
so on down to single characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, word_hashes
from .toxicity import _chunks, mixed

#: Expected number of sampled documents of each language; n-gram lengths, longest first.
SAMPLE, LENGTHS = 600, (5, 4, 3, 2, 1)
_letters = Cache()


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters["all"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters["all"]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts one after another; start, end, owner and hash of each run of letters."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "replace"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = _is_letter()[codes]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in lower[:-1])])
    owner = np.searchsorted(firsts, starts, side="right") - 1
    return codes, starts, ends, owner, word_hashes(codes, starts, ends)


def _inner_grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: number of the word and hash of every n-gram inside a word with a blank at either side."""
    size = ends - starts + 2
    total = int(size.sum())
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(starts)), size)
    at = np.arange(total) - first[owner]
    edge = (at == 0) | (at == size[owner] - 1)
    flat = np.where(edge, 32, codes[np.where(edge, 0, starts[owner] + at - 1)] if len(codes) else 0).astype(np.uint64)
    for n in lengths:
        count = max(0, total - n + 1)
        h = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + count]
        ok = at[:count] + n <= size[owner[:count]]
        if n == 1:
            ok &= ~edge[:count]
        yield n, owner[:count][ok], mixed(h[ok] + np.uint64(n))


def _log_frequency(keys: np.ndarray, lang: np.ndarray, count: np.ndarray, n_langs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    known, inverse = np.unique(keys, return_inverse=True)
    table = np.zeros((len(known), n_langs))
    np.add.at(table, (inverse, lang), count)
    total = table.sum(axis=0)
    seen = table.sum(axis=1) >= least
    logs = np.log((table[seen] + 0.1) / (total + 0.1 * max(1, len(known))))
    return known[seen], logs


@dataclass
class Model:
    langs: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; 'und' and 0 if it has no letter, or no language was learned."""
        sums, some = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        for first, part in _chunks(texts):
            codes, starts, ends, owner, hashes = _words(part)
            if not len(starts):
                continue
            some[first + owner] = True
            if not self.langs:
                continue
            distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            value = self._values(codes, starts[one], ends[one], distinct)
            pair, count = np.unique(owner.astype(np.int64) * len(distinct) + inverse, return_counts=True)
            doc, word = pair // len(distinct), pair % len(distinct)
            for k in range(len(self.langs)):
                sums[first : first + len(part), k] += np.bincount(doc, weights=count * value[word, k], minlength=len(part))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        top = sums.argmax(axis=1)
        share = 1 / np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        return [self.langs[k] if s else "und" for k, s in zip(top, some)], np.where(some, share, 0.0)

    def _values(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log frequency per language of each of these distinct words."""
        value = np.zeros((len(hashes), len(self.langs)))
        known, at = _find(self.words[0], hashes)
        value[known] = self.words[1][at[known]]
        open_ = np.flatnonzero(~known)
        for n in LENGTHS:
            if not len(open_):
                break
            keys, logs = self.grams[n]
            _, owner, h = next(_inner_grams(codes, starts[open_], ends[open_], (n,)))
            hit, at = _find(keys, h)
            owner, at = owner[hit], at[hit]
            found = np.bincount(owner, minlength=len(open_))
            for k in range(len(self.langs)):
                value[open_, k] = np.bincount(owner, weights=logs[at, k], minlength=len(open_)) / np.maximum(found, 1)
            open_ = open_[found == 0]
        return value


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return keys[at] == h, at


def train(texts: list[str], langs: list[str]) -> Model:
    """Learn from texts of known language; words and n-grams need two occurrences."""
    names = sorted(set(langs))
    lang_of = np.array([names.index(x) for x in langs], dtype=np.int64)
    words, grams = [], {n: [] for n in LENGTHS}
    for first, part in _chunks(texts):
        codes, starts, ends, owner, hashes = _words(part)
        lang = lang_of[first + owner]
        words.append((hashes, lang))
        for n, word, h in _inner_grams(codes, starts, ends, LENGTHS):
            keys, count = np.unique(np.stack([h, lang[word].astype(np.uint64)]), axis=1, return_counts=True) if len(h) < 2 else _pair_counts(h, lang[word], len(names))
            grams[n].append((keys[0], keys[1].astype(np.int64), count))
    if not names:
        return Model([], (np.zeros(0, dtype=np.uint64), np.zeros((0, 0))))
    all_words = [np.concatenate(x) for x in zip(*words)]
    model = Model(names, _log_frequency(*all_words, np.ones(len(all_words[0])), len(names), 2))
    for n in LENGTHS:
        model.grams[n] = _log_frequency(*[np.concatenate(x) for x in zip(*grams[n])], len(names), 2)
    return model


def _pair_counts(h: np.ndarray, lang: np.ndarray, n_langs: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    keys, inverse = np.unique(h, return_inverse=True)
    pair, count = np.unique(inverse.astype(np.int64) * n_langs + lang, return_counts=True)
    return (keys[pair // n_langs], pair % n_langs), count


def fit(docs: DataFrame, rows: Column | None = None, each: int = SAMPLE) -> Model:
    """Learn from about `each` documents of every language, drawn by a hash of doc_id; rows: which documents may be used.

    A language with fewer documents gives all of them. Rows with a null lang, text or doc_id are left out.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(rows) if rows is not None else known
    rates = known.groupBy("lang").count().select("lang", (F.lit(float(each)) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    seen = known.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("doc_id", "lang", "text").toPandas()
    seen = seen.sort_values(["doc_id", "lang", "text"])
    return train(seen["text"].tolist(), seen["lang"].tolist())


def predicted_languages(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, and lang_pred and score of each whole text.

    A text that is null or has no letter is 'und' with score 0, and so is every
    text if no language was learned. Repeated rows get the same answer; ties go
    to the language that comes first by name; only `text` is read for it.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*held.value)
        for batch in batches:
            lang, score = own.predict(batch["__text"].tolist())
            yield batch.drop(columns="__text").assign(lang_pred=lang, score=score)

    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string, score double"])
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInPandas(told, schema)
