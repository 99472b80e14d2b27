"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. The leaf of the tree at place i holds (rank, i) of the pair that begins there, inner nodes
the least of their children; so the root is the lowest rank and, of equal ranks, the leftmost place. A merge changes
three leaves, each in logarithmic time; encoding ends when the root holds no mergeable pair.

The vocabulary is a file in the format of the `tokenizers` library; the executors get it by broadcast (the size of
the vocabulary bounds it, not the input). Words are independent of each other, so every Python worker keeps the words
it met in a cache of bounded size (two generations, so that frequent words stay).

Defined cases: null is the empty text and gives no tokens; a special token's string inside a text becomes its id;
rows are encoded one by one, so repeated rows, ties and further columns have no influence; texts of any length are
encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import over_texts, table

#: Words that a generation of a worker's cache may hold.
CACHE_WORDS = 400_000
NONE = 1 << 62
#: Low bits of a leaf, for the place of its pair: words of up to 2**40 bytes.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
# White space of the normaliser's pattern (str.split would also split at U+001C to U+001F).
BLANKS = r"\t-\r \x85\xa0  -     　"
# Letters of Unicode 16, which the tokenizers library knows and this Python does not.
NEW_LETTERS = (
    r"Ᲊ-ᲊꟋ-ꟍꟚ-Ƛ\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    r"\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    r"\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
WHITE = re.compile(f"[{BLANKS}]+")
ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def category(kind: str) -> str:
    """The code points of a general category as ranges of a character class."""
    at = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
    ends = [k for k in range(len(at)) if k + 1 == len(at) or at[k + 1] != at[k] + 1]
    return "".join(rf"\U{at[a]:08x}-\U{at[b]:08x}" for a, b in zip([0, *[k + 1 for k in ends[:-1]]], ends))


class BPE:
    """Encoder and decoder for a word-end BPE vocabulary (JSON of the tokenizers library)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id and right id -> rank, shifted to make room for a place; rank -> id of the merged symbol
        self.merges = {vocab[a] << 20 | vocab[b]: rank << PLACE_BITS for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, numbers = category("L") + NEW_LETTERS, category("N")
        self.pattern = pattern.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("\\s\\p{L}\\p{N}", BLANKS + letters + numbers)
        self._ready()

    def _ready(self) -> None:
        self.pieces = re.compile(self.pattern).findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "split", "young", "old")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of a text, by merges read off the root of the segment tree."""
        raw = word.encode("utf-8", "surrogatepass")
        first = self.first
        symbols = [first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n, rank_of = len(symbols), self.merges.get
        if n == 1:
            return symbols
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        k, left = size, symbols[0]
        for right in symbols[1:]:
            found = rank_of(left << 20 | right)
            if found is not None:
                tree[k] = found + k - size
            left = right
            k += 1
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = self.merged
        while (root := tree[1]) != NONE:
            i = root & PLACE
            j = after[i]
            symbols[i] = new = merged[root >> PLACE_BITS]
            symbols[j] = -1
            k = after[i] = after[j]
            # the pair at j is gone, those at i and before it have a new symbol
            key = NONE
            if k < n:
                before[k] = i
                found = rank_of(new << 20 | symbols[k])
                if found is not None:
                    key = found + i
            changed = ((i, key), (j, NONE))
            p = before[i]
            if p >= 0:
                found = rank_of(symbols[p] << 20 | new)
                changed = (*changed, (p, NONE if found is None else found + p))
            for place, key in changed:
                k = size + place
                if k == 2 * size or tree[k] == key:
                    continue
                tree[k] = key
                while k > 1:
                    other = tree[k ^ 1]
                    if other < key:
                        key = other
                    k >>= 1
                    if tree[k] == key:
                        break
                    tree[k] = key
        return [s for s in symbols if s >= 0]

    def piece(self, word: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers, from the cache where it has been met."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                ids = self.encode_word(word)
                found = pack("<%dI" % len(ids), *ids)
            self.keep(word, found)
        return found

    def keep(self, text: str, found: bytes) -> None:
        if len(text) <= 64:  # long ones are rare and would make the size of the cache depend on them
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[text] = found

    def chunk(self, text: str) -> bytes:
        """As piece, for a stretch without white space."""
        found = self.young.get(text)
        if found is None:
            words = self.pieces(text)
            if len(words) == 1 and words[0] == text:
                return self.piece(text)
            found = self.old.get(text)
            if found is None:
                found = b"".join([self.piece(w) for w in words])
            self.keep(text, found)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        out: list[bytes] = []
        chunk, met = self.chunk, self.young.get
        for part in self.split(text or ""):
            if part in self.special:
                out.append(pack("<I", self.special[part]))
            else:
                # a capital sigma becomes the same small letter at any place, other than in str.lower
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [met(x) or chunk(x) for x in (WHITE.split(part) if ODD.search(part) else part.split())]
                met = self.young.get
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids, joined by spaces, as the library does for a file that names no decoder."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


def load(path: str) -> BPE:
    with open(path, encoding="utf-8") as f:
        return BPE(json.load(f))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string of every row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(load(path or vocabulary_path()))

    def run(texts: list[str | None]) -> dict:
        ids = [model.value.encode(t) for t in texts]
        return {"n_tokens": [len(x) for x in ids], "ids": [x.astype("int32") for x in ids], "decoded": [model.value.decode(x) for x in ids]}

    return over_texts(docs.select("doc_id", "text"), run, "n_tokens long, ids array<int>, decoded string", ["doc_id"])


def slices(batch: pd.DataFrame, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about so many characters: bounds what one step holds besides the largest text."""
    begun = size = 0
    for k, text in enumerate(batch.text):
        size += len(text or "")
        if size >= chars:
            yield batch.iloc[begun : k + 1]
            begun, size = k + 1, 0
    if begun < len(batch):
        yield batch.iloc[begun:]


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same work as encode_documents, returned as digests."""
    model = docs.sparkSession.sparkContext.broadcast(load(path or vocabulary_path()))

    def run(texts: list[str | None]) -> dict:
        rows = []
        for text in texts:
            ids = model.value.encode(text)
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(model.value.decode(ids).encode()).hexdigest()))
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows)))

    return over_texts(docs.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
