"""Toxicity by multiple-instance learning: only documents have labels, sentences are scored.

A sentence's probability is a logistic function of the telling words it holds and of
their first letters (inflected and compound forms share a stem), and 0 without any; a
document's is the noisy-or of its sentences, 1 - prod(1 - p), in which those with the
same telling words count once. A document without an offending sentence (a half and
more) scores as its worst one, so that weak sentences never add up: length alone is no sign.
The weights are fitted to document labels by full-batch gradient steps on the likelihood
of that noisy-or, over words screened by how unevenly the two classes use them. What the
sentences got then locates the offending ones.

The model is fitted from a bounded sample of rows (``SAMPLE``), whatever their length: of each
class the labelled training documents first in hash order. Their words are counted, and
their sentences reduced to telling words, on the executors; only these come to the
driver. All documents are scored, whole.

Edge cases: a null or empty text has no sentence and score 0; without labelled
rows of both classes nothing can be told apart and every score is 0; null doc_ids
are never learned from or held out; repeated rows score alike and are learned from once;
of several labels of an id the highest counts; ties of words and of sample rows are broken by
spelling and by hash; an empty table gives no rows. Very long texts are scored sentence by sentence.
Columns other than ``doc_id`` and ``text`` are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import cut, per_batch, per_text

#: At most so many rows (toxic, clean) are learned from.
SAMPLE = (1500, 3000)
FOLDS, WORDS, ROUNDS = 5, 400, 300
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word's beginnings that are features beside the word itself.
HEADS = (3, 4, 5)


def marks_of(sentence: str) -> set[str]:
    """The words of a sentence, lower-cased, and their beginnings (``los*``)."""
    words = set(WORD.findall(sentence.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in HEADS))


@dataclass(frozen=True)
class Model:
    """Words' weights, and what is added to their sum; no weights, no model: every score is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def sentences(self, text: str) -> Iterator[tuple[int, int, float, frozenset]]:
        """Bounds, probability and telling words of each sentence."""
        weights, short = self.weights, HEADS[0]
        starts = {w[:short] for w in weights}
        for m in SENTENCE.finditer(text):
            words = [w for w in set(WORD.findall(m.group().lower())) if w[:short] in starts]
            told = frozenset(w for w in set(words).union(*({w[:k] + "*" for w in words if len(w) > k} for k in HEADS)) if w in weights) if words else frozenset()
            z = self.bias + math.fsum(weights[w] for w in told)
            yield m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if told else 0.0, told

    def score(self, text: str) -> tuple[float, str]:
        """The document's probability, and the bounds of its offending sentences."""
        clean, worst, offending, seen = 0.0, 0.0, [], set()
        for a, b, p, told in self.sentences(text):
            if told and told not in seen:
                seen.add(told)
                worst, clean = max(worst, p), clean + math.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                offending.append(f"{a}:{b}")
        return -math.expm1(clean) if offending else worst, ",".join(offending)


def telling_words(rows: DataFrame, words: int = WORDS) -> list[str]:
    """The marks that the classes of ``rows`` (text, toxic) use most unevenly, by documents."""

    def make() -> Callable:
        return lambda batch: ((mark, y) for t, y in zip(*batch, strict=True) for mark in sorted(set().union(*(marks_of(m.group()) for m in SENTENCE.finditer(t or "")))))

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return []
    n = [F.sum((F.col("toxic") == y).cast("int")).alias(f"n{y}") for y in (0, 1)]
    counted = per_batch(rows.select("text", "toxic"), make, "mark string, toxic int").groupBy("mark").agg(*n).filter("n0 + n1 >= 3")
    both = (F.col("n0") + F.col("n1")) / sum(sizes.values())
    uneven = F.abs(F.col("n1") / sizes[1] - F.col("n0") / sizes[0]) / F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]) + 1e-9)
    return [r["mark"] for r in counted.orderBy(uneven.desc(), "mark").limit(words).collect()]


def fit(rows: DataFrame, words: int = WORDS, rounds: int = ROUNDS) -> Model:
    """Weights from ``rows`` (text, toxic), as ``sample`` has them; the same for the same rows."""
    import numpy as np

    chosen = telling_words(rows, words)
    if not chosen:
        return Model()
    at = {w: i for i, w in enumerate(chosen)}

    def make() -> Callable:
        """Of each document the distinct sets of telling words in its sentences."""

        def told(text: str) -> list[list[int]]:
            sets = {tuple(sorted(at[w] for w in marks_of(m.group()) if w in at)) for m in SENTENCE.finditer(text)}
            return [list(x) for x in sorted(sets - {()})]

        return lambda batch: ((y, told(t or "")) for t, y in zip(*batch, strict=True))

    bags = sorted((r["toxic"], [tuple(x) for x in r["told"]]) for r in per_batch(rows.select("text", "toxic"), make, "toxic int, told array<array<int>>").collect())
    labels, sentence, word, doc = np.array([y for y, _ in bags], float), [], [], []
    for d, (_, told) in enumerate(bags):
        for hits in told:
            word += hits
            sentence += [len(doc)] * len(hits)
            doc.append(d)
    sentence, word, doc = (np.array(v, dtype=np.int64) for v in (sentence, word, doc))
    w = np.zeros(len(chosen) + 1)
    w[-1] = -5.0
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, w[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        slope = p * np.where(labels == 1, -np.exp(clean) / toxic, 1.0)[doc] / len(bags)
        g = np.append(np.bincount(word, slope[sentence], len(chosen)), slope.sum()) + 1e-4 * np.append(w[:-1], 0.0)
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w -= 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Model({c: float(x) for c, x in zip(chosen, w[:-1], strict=True) if abs(x) > 0.05}, float(w[-1]))


def fold_of(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """The bounded sample of training rows, kept as a table: text, toxic. Equal texts of a class count once."""
    marks = labels.filter("toxic is not null and doc_id is not null").filter(fold_of("doc_id") != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    spread, place = F.xxhash64("doc_id"), ["toxic", "doc_id", "h1", "h2"]
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    parts = []
    for toxic, n in zip((1, 0), most, strict=True):
        # twice the ids, as copies and ids without a document fall away; the bound makes the broadcasts safe
        some = marks.filter(F.col("toxic") == toxic).orderBy(spread, "doc_id").limit(2 * n)
        rows = hashed.drop("text").join(F.broadcast(some), "doc_id").groupBy("h1", "h2").agg(F.min(F.struct(spread.alias("h"), "doc_id")).alias("first"), F.max("toxic").alias("toxic"))
        parts.append(rows.orderBy("first", "h1", "h2").limit(n).select("toxic", "first.doc_id", "h1", "h2"))
    keys = cut(parts[0].unionByName(parts[1]))
    return cut(hashed.join(F.broadcast(keys), place[1:]).dropDuplicates(place).select("text", "toxic"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending (bounds in code points of sentences with a probability of a half and more)."""

    def make() -> Callable:
        return lambda batch: ((i, *model.score(t or "")) for i, t in zip(*batch, strict=True))

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, score double, offending string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under a half; a text's score depends on nothing but the text."""

    def make() -> Callable:
        return lambda texts: [model.score(t or "")[0] < 0.5 for t in texts]

    return per_text(docs, make, keep=True)
