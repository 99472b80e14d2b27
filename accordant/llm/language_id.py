"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams (1 to 3 characters of the lower-cased text, all of it), weighted by
sqrt(count) x idf and scaled to length 1. Spherical k-means splits each language's training vectors into up to
CENTROIDS clusters; a text gets the language of the centroid with the highest cosine. A text is rejected when that
cosine is below the floor for its length: FLOOR times the least cosine of training texts of that length class.

The model is fitted on a bounded sample (SAMPLE_ROWS whole texts a language, SAMPLE_MOST in all, those with the least
hashes of doc_id, texts of more than SAMPLE_CHARS characters aside), so it is the same for any partitioning. Scoring is a map over all rows.

Defined cases: null text or text without a letter gives `und`, score 0, rejected; with no labelled row at all, every
text gives `und`; a null doc_id is not held out and not learned from; equal cosines go to the language first in order;
repeated rows are scored alike; an empty table gives no rows; further columns are ignored (`keep_known` carries them).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, over_texts, remainder, table

SAMPLE_ROWS, SAMPLE_MOST, SAMPLE_CHARS = 300, 4_000, 25_000
SIZE, CENTROIDS, ROUNDS, FLOOR, HELD_OUT = 1 << 13, 4, 12, 0.5, 1
STEP_CHARS = 500_000
#: Blanks, digits and punctuation of ASCII count as one blank.
PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], "u4")


def add_counts(out: np.ndarray, texts: list[str]) -> None:
    """Adds the n-gram counts of texts to the rows of out; long texts go in parts that overlap by two characters."""
    parts, rows, lapped = [], [], []

    def flush():
        if not parts:
            return
        codes = np.frombuffer("\0\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "u4").copy()
        low = codes < 128
        codes[low] = np.where(codes[low] == 0, 0, PLAIN[codes[low]])
        row = np.repeat(rows, [len(p) + 2 for p in parts])
        c = codes.astype("u8")
        two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
        shift = np.uint64(64 - SIZE.bit_length() + 1)
        ends = codes == 0
        # a gram that ends in the overlap was counted with the part before
        old = np.zeros(len(codes), bool)
        at = np.cumsum([0, *[len(p) + 2 for p in parts[:-1]]])
        for n in (1, 2):
            old[[a + n - 1 for a, lap in zip(at, lapped) if lap >= n]] = True
        for n, h in ((1, c * np.uint64(0x9E3779B97F4A7C15)), (2, two), (3, three)):
            whole = ~ends[: len(h)] & ~old[n - 1 : len(h) + n - 1]
            for k in range(1, n):
                whole &= ~ends[k : len(h) + k]
            h = h ^ (h >> np.uint64(29))
            at = row[: len(h)][whole] * SIZE + ((h[whole] * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype("i8")
            out.reshape(-1)[:] += np.bincount(at, minlength=out.size).astype("f4")
        parts.clear(), rows.clear(), lapped.clear()

    size = 0
    for k, text in enumerate(texts):
        text = text.lower().replace("\0", " ")
        for begin in range(0, max(1, len(text)), STEP_CHARS):
            parts.append(text[max(0, begin - 2) : begin + STEP_CHARS])
            rows.append(k), lapped.append(min(2, begin))
            size += len(parts[-1])
            if size >= STEP_CHARS:
                flush()
                size = 0
    flush()


class Centroids:
    """langs[k] is the language of row k of centers."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 5):
        counts = self.counts(texts)
        self.idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))).astype("f4") + 1
        x = self.weigh(counts)
        draw, centers, self.langs = np.random.default_rng(seed), [], []
        for lang in sorted(set(langs)):
            own = x[[k for k, v in enumerate(langs) if v == lang]]
            k = min(CENTROIDS, len(own))
            mid = own[draw.choice(len(own), k, replace=False)]
            for _ in range(ROUNDS):
                near = (own @ mid.T).argmax(1)
                mid = np.stack([own[near == j].sum(0) if (near == j).any() else mid[j] for j in range(k)])
                mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-9)
            centers.append(mid)
            self.langs += [lang] * k
        self.centers = np.concatenate(centers) if centers else np.zeros((0, SIZE), "f4")
        self.floors = np.zeros(40, "f4")
        if len(x):
            best, kind = (x @ self.centers.T).max(1), self.length_class(counts)
            least = np.array([best[kind == k].min() if (kind == k).any() else np.inf for k in range(40)])
            # a class without training texts takes the lowest floor of all
            self.floors = FLOOR * np.where(np.isfinite(least), least, best.min())

    @staticmethod
    def counts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), SIZE), "f4")
        for k in range(0, len(texts), 128):
            add_counts(out[k : k + 128], texts[k : k + 128])
        return out

    @staticmethod
    def length_class(counts: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(1 + counts.sum(1)).astype(int), 39)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        if not len(self.centers) or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        counts = np.zeros((len(texts), SIZE), "f4")
        add_counts(counts, texts)
        near = self.weigh(counts) @ self.centers.T
        best = near.max(1)
        return [self.langs[k] for k in near.argmax(1)], np.clip(best, 0, 1).astype("f8"), best < self.floors[self.length_class(counts)]


def fit(docs: DataFrame) -> Centroids:
    """Learns from docs(doc_id, text, lang): rows with a language and crc32(doc_id) mod 3 other than HELD_OUT."""
    rows = docs.select("doc_id", "text", "lang").filter((remainder("doc_id", 3) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS))
    sample = bounded_sample(rows, "doc_id", SAMPLE_ROWS, "lang", SAMPLE_MOST)
    return Centroids([r.text for r in sample], [r.lang for r in sample])


def languages(docs: DataFrame, model: Centroids, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' columns `keep` (all, if None) with lang_pred, score and rejected; text is a column, or a field of a kept one (doc/text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None], letters: list[bool | None]) -> dict:
        lang, score, out = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = np.array([k for k, has in enumerate(letters) if has], "i8")
        for k in range(0, len(known), 128):
            own = known[k : k + 128]
            lang[own], score[own], out[own] = shared.value.predict([texts[j] for j in own])
        return {"lang_pred": lang, "score": score, "rejected": out}

    told = docs.withColumn("__letters", F.col(text.replace("/", ".")).rlike(r"\p{L}"))
    return over_texts(told, run, "lang_pred string, score double, rejected boolean", docs.columns if keep is None else keep, texts=(text, "__letters"))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that the model, learned from them, rejects; same columns, whatever their names."""
    row = docs.select(F.struct(*docs.columns).alias("doc"))
    scored = languages(row, fit(docs), ["doc"], "doc/text")
    return scored.filter(~F.col("rejected") & (F.col("lang_pred") != "und")).select("doc.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = languages(docs.select("doc_id", "text"), fit(docs), ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
