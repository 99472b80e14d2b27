"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two second-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples: values that the patterns find and strings drawn at random on one side, words and identifiers made of
words on the other. A run of 20 or more characters of the base64 alphabets that no span of a pattern holds whole is a
secret where the log-likelihood ratio per character is above a threshold. By models of one half of the samples, 98 of 100
random strings of the other half reach it, and it lies at least midway between the two kinds (identifiers of words that
the sample lacks look more random than those it has).

The models are fitted on a bounded sample of documents (SAMPLE_ROWS rows of up to SAMPLE_CHARS characters, by a hash of
doc_id, and SAMPLE_WORDS of their words); scanning is a map over all rows and whole texts.

Defined cases: null is the empty text; a text without spans has an empty list and the digest of the empty string;
repeated rows are scanned alike; positions are code points; a sample without words gives an infinite threshold, so only the
patterns find spans; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, over_texts, table

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_WORDS, DRAWN = 1500, 20_000, 100_000, 3000
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
RUN, WORD = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), re.compile(r"[A-Za-z]{4,}")
#: Any assignment has one of these (in either case); a plain search spares most texts the pattern.
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), "i4")
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
N = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: the whole match."""
    low = text.lower()
    found = []
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Chains:
    """Log-likelihood ratio of second-order Markov chains: random strings against identifiers."""

    def __init__(self, random: list[str], plain: list[str]):
        # the threshold comes from strings that a model of the other half has not seen
        self.ratio = self.learn(random[::2]) - self.learn(plain[::2])
        a, b = self.scores(random[1::2]), self.scores(plain[1::2])
        self.threshold = float(max(np.quantile(a, 0.02), (np.quantile(a, 0.05) + np.quantile(b, 0.999)) / 2)) if len(a) and len(b) else np.inf
        self.ratio = self.learn(random) - self.learn(plain)

    @staticmethod
    def triples(text: str) -> np.ndarray:
        c = CODE[np.frombuffer(text.encode("ascii", "replace"), "u1") & 127]
        return (c[:-2] * N + c[1:-1]) * N + c[2:]

    def learn(self, texts: list[str]) -> np.ndarray:
        """log P(third | first two), smoothed by P(third | second), that by a constant."""
        n = np.bincount(np.concatenate([np.zeros(0, "i4"), *map(self.triples, texts)]), minlength=N**3).reshape(N, N, N).astype("f8")
        two = n.sum(0)
        low = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
        return np.log((n + 8 * low) / (n.sum(2, keepdims=True) + 8)).reshape(-1).astype("f4")

    def score(self, text: str) -> float:
        return float(self.ratio[self.triples(text)].mean())

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.array([self.score(t) for t in texts if len(t) >= 3])


class Covered:
    """Whether a stretch meets one of some spans, found by two searches whatever their number."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[1] for s in spans), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def holds(self, start: int, end: int) -> bool:
        """Whether one of the spans holds all of the stretch."""
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end


def train(texts: list[str], seed: int = 11) -> Chains:
    draw = np.random.default_rng(seed)
    secrets, words = [], []
    for text in texts:
        spans = base_spans(text)
        covered = Covered(spans)
        secrets += [ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b] for a, b, kind in spans]
        words += [m[0] for m in WORD.finditer(text) if not covered.meets(m.start(), m.start() + 1)]
    sets = [np.array(list(ALPHABET[:62])), np.array(list(ALPHABET[:64])), np.array(list("0123456789abcdef"))]
    secrets += ["".join(draw.choice(sets[k % 3], draw.integers(20, 48))) for k in range(DRAWN)]
    words = [words[k] for k in draw.permutation(len(words))[:SAMPLE_WORDS]]
    joints, plain = ["_", "-", "", "/", "_"], list(words)
    for _ in range(DRAWN if words else 0):
        parts, joint = [words[k] for k in draw.integers(len(words), size=draw.integers(2, 6))], joints[draw.integers(len(joints))]
        parts = [p.capitalize() if joint == "" else p for p in parts]
        plain.append(joint.join(parts) + ("" if draw.random() < 0.7 else str(draw.integers(1000))))
    return Chains(secrets, plain)


def spans(text: str, chains: Chains) -> tuple[list, list]:
    """The spans of the patterns, and all spans with those that the models add: runs that no span of a pattern holds whole."""
    base = base_spans(text)
    covered = Covered(base)
    more = [(m.start(), m.end(), "markov") for m in RUN.finditer(text) if not covered.holds(m.start(), m.end()) and chains.score(m[0]) > chains.threshold]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def scan(docs: DataFrame, chains: Chains) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(chains)
    names = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def told(found: list) -> str:
        return ",".join([f"{kind}:{a}:{b}" for a, b, kind in found])

    def run(texts: list[str | None]) -> dict:
        rows = []
        for text in texts:
            base, every = spans(text or "", shared.value)
            n = [sum(s[2] == k for s in every) for k in KINDS]
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
        return dict(zip(names, zip(*rows)))

    return over_texts(docs.select("doc_id", "text"), run, "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string", ["doc_id"])


def fit(docs: DataFrame) -> Chains:
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    return train([r.text for r in bounded_sample(rows, "doc_id", SAMPLE_ROWS)])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
