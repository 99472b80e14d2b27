"""Toxicity by subword bags: averaged n-gram embeddings under a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its byte n-grams (3 to 5, with word marks), of its beginnings (6 to 10) and of
itself, all hashed into BUCKETS rows, so a misspelling or an inflected form shares most of its vectors with the word. A window of WINDOW words is the average of its
words (a word that repeats inside a window counts once); a linear softmax over the two labels scores it. A text is as toxic as its worst window: a few words must not
vanish in the average of a long text. Training sees labels of whole texts only, so each round trains on the window
that scores highest at present (of texts of either label) and on random windows of clean texts; vectors and softmax
are updated together by Adagrad.

Labels are learned from rows whose crc32(doc_id) mod 5 is not 0, from a bounded sample (SAMPLE_ROWS of each label, those
with the least hashes of doc_id, texts of up to SAMPLE_CHARS characters), which is the same for any partitioning. The model is BUCKETS numbers once vectors and softmax are
multiplied; scoring is a map over all rows, whole texts and every window.

Defined cases: null and empty texts, and texts without words, score 0; without labels every text scores 0; a label of
null is left out, of several labels of a doc_id the highest counts; a null doc_id is not held out; repeated rows score
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, over_texts, remainder, table
from .decontaminate import words

SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
BUCKETS, WIDTH, WINDOW, ROUNDS, RATE, SHRINK, HELD_OUT = 1 << 17, 8, 16, 14, 0.2, 1e-5, 0
#: Words that a worker remembers; the memory starts anew beyond.
CACHE_WORDS = 500_000


def grams(word: bytes) -> list[int]:
    marked = b"<" + word + b">"
    parts = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in (*parts, *[marked[:n] for n in range(6, min(len(marked), 11))], marked)]


class Bag:
    """weight[b] is what bucket b adds to the toxic label's logit: its vector times the softmax's difference."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        self.weight, self.bias = np.zeros(BUCKETS, "f4"), 0.0
        if len(set(labels)) == 2:
            self.train([words(t) for t in texts], np.array(labels), np.random.default_rng(seed))
        self.known: dict[bytes, float] = {}

    def train(self, docs: list[list[bytes]], labels: np.ndarray, draw: np.random.Generator) -> None:
        keep = [k for k, d in enumerate(docs) if d]
        docs, labels = [docs[k] for k in keep], labels[keep]
        place = {w: k for k, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
        rows = [grams(w) for w in place]
        size = np.array([len(r) for r in rows])
        flat, begin = np.concatenate(rows), np.cumsum(size) - size
        docs = [np.array([place[w] for w in d]) for d in docs]
        vectors, out = draw.normal(0, 0.1, (BUCKETS, WIDTH)), draw.normal(0, 0.3, (2, WIDTH))
        bias, seen_v, seen_o, seen_b = np.zeros(2), np.full(BUCKETS, 1e-6), 1e-6, 1e-6
        for step in range(ROUNDS):
            value = np.add.reduceat((vectors @ (out[1] - out[0]))[flat], begin) / size
            bags, target, sizes = [], [], []
            for d, y in zip(docs, labels):
                spots = max(1, len(d) - WINDOW + 1)
                any_ = draw.integers(spots)
                worst = int(window_means(value[d]).argmax()) if step >= 4 else any_
                for at in {worst} if y else {worst, any_}:
                    bags.append(np.unique(d[at : at + WINDOW])), target.append(y)
                    sizes.append(len(d[at : at + WINDOW]))
            share = np.where(np.array(target) == 1, 0.5 / max(1, sum(target)), 0.5 / max(1, len(target) - sum(target))) * len(target)
            order = draw.permutation(len(bags))
            for k in range(0, len(order), 64):
                own = order[k : k + 64]
                word = np.concatenate([bags[j] for j in own])
                bag = np.repeat(np.arange(len(own)), [len(bags[j]) for j in own])
                n = size[word]
                at = np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
                gram, part = flat[at], np.repeat(1 / (n * np.array([sizes[j] for j in own])[bag]), n)
                owner = np.repeat(bag, n)
                mean = np.zeros((len(own), WIDTH))
                np.add.at(mean, owner, vectors[gram] * part[:, None])
                z = mean @ out.T + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), [target[j] for j in own]] -= 1
                p *= share[own][:, None]
                back = (p @ out)[owner] * part[:, None]
                g_out, g_bias = p.T @ mean / len(own), p.mean(0)
                unique, inverse = np.unique(gram, return_inverse=True)
                g = np.zeros((len(unique), WIDTH))
                np.add.at(g, inverse, back)
                g += SHRINK * vectors[unique]
                seen_v[unique] += (g**2).mean(1)
                vectors[unique] -= RATE * g / np.sqrt(seen_v[unique])[:, None]
                seen_o += (g_out**2).mean()
                seen_b += (g_bias**2).mean()
                out -= RATE * g_out / np.sqrt(seen_o)
                bias -= RATE * g_bias / np.sqrt(seen_b)
        self.weight, self.bias = (vectors @ (out[1] - out[0])).astype("f4"), float(bias[1] - bias[0])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = float(self.weight[grams(word)].mean())
        return found

    def score(self, text: str | None) -> float:
        own = words(text)
        if not own or not self.weight.any():
            return 0.0
        z = window_means(np.array([self.word(w) for w in own])).max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def window_means(value: np.ndarray) -> np.ndarray:
    """Averages of all windows; a word that repeats one of the WINDOW - 1 before it adds nothing to the sum."""
    new = np.ones(len(value), bool)
    for k in range(1, min(WINDOW, len(value))):
        new[k:] &= value[k:] != value[:-k]
    value = np.where(new, value, 0.0)
    if len(value) <= WINDOW:
        return value.mean(keepdims=True)
    total = np.concatenate(([0.0], np.cumsum(value, dtype="f8")))
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


def fit(docs: DataFrame, labels: DataFrame) -> Bag:
    known = labels.filter("toxic is not null and doc_id is not null").filter(remainder("doc_id", 5) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # ids are chosen without their texts, then the texts of these few are read: no text is dealt out to meet a label
    few = bounded_sample(rows.select("doc_id").join(known, "doc_id"), "doc_id", SAMPLE_ROWS, per="toxic")
    chosen = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r.toxic) for r in few}), known.select("doc_id", "toxic").schema)
    sample = bounded_sample(rows.join(F.broadcast(chosen), "doc_id"), "doc_id", SAMPLE_ROWS, per="toxic")
    return Bag([r.text for r in sample], [r.toxic for r in sample])


def toxicity(docs: DataFrame, model: Bag) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict:
        score = np.array([shared.value.score(t) for t in texts], "f8")
        return {"score": score, "predicted": (score >= 0.5).astype("i4")}

    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 5) == HELD_OUT, F.lit(False)).alias("held_out"))
    return over_texts(rows, run, "score double, predicted int", ["doc_id", "held_out"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
