"""Near-duplicate detection by BagMinHash.

A document is a multiset of SHINGLE-word shingles (words: A-Z lower-cased, runs of digits, letters and characters from
U+0080; a text with fewer words is one shingle). The weight of a shingle is its count. Weights are discretised at the
integers, and the levels below a weight are ordered in a hierarchy of dyadic ranges [0,1), [1,2), [2,4), [4,8) ...
Each shingle has one Poisson process per range, with a rate in proportion to its length; a process hands out its points
in rising order, each with one of the SIZE components and a level. A document takes the points whose level is below the
shingle's weight, and component k of the signature is the least point given to k. So two documents agree in a component
with a probability equal to their weighted Jaccard similarity, and a process is left as soon as its next point is above
all components, which needs few points a shingle.

Signatures are cut into BANDS bands of ROWS components. Documents that agree in a band share a bucket, and are compared
exactly (multiset overlap of all shingles, LEAST or more) in a way that stays linear for large groups of copies.

Equal texts are one node, however many they are; a node is numbered by its digest's row, whatever its doc_id is. The nodes
of a bucket are compared as `cells` describes: each with the bucket's leader on the texts, and all others by what they
differ in from it, as a set of tokens (a shingle n times more gives n tokens).

Every pair of one bucket whose classes differ is thus compared or excluded exactly. Bands of 6 x 24 miss a pair at 0.8 with
a probability of 0.0007, at 0.9 below 1e-7. The join can only grow with the square of a family where many pairs outside
the leader's class have a similarity close to 0.8.

Defined cases: null text is the empty text; texts without words are linked only to equal texts; a class's number is its
least doc_id (which may be negative), null if no row of it has one; different texts under one doc_id are different nodes,
so its rows can have different classes; repeated rows get the same class; an empty table gives no rows; further columns
are ignored (`drop_near_copies` carries them).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, ranges
from .cells import labelled, links
from .common import materialize, over_texts, sized, table
from .decontaminate import words
from .exact_dedup import digest

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 24, 6
#: (1 + LEAST) / (1 - LEAST): multisets are similar if their difference times 9 is at most the sum of their sizes.
RATIO = (9, 1)
SIZE = BANDS * ROWS
SLICE_CHARS = 1_000_000
#: Bits of a shingle's hash beside the number of its document in a slice.
HASH_BITS = 44


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and 64-bit hash of each shingle, repeats included, in the order of the texts."""
    docs = [words(t) for t in texts]
    n = np.array([len(d) for d in docs], "i8")
    # digests are big-endian bytes: no Python number is made of each
    codes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(docs))), ">u8").astype("u8")
    begin, count = np.cumsum(n) - n, np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(docs)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    left = np.repeat(begin + n, count) - at
    out = np.zeros(len(at), "u8")
    codes = np.concatenate((codes, np.zeros(SHINGLE, "u8")))
    short = np.flatnonzero(left < SHINGLE)  # of texts with fewer words
    for k in range(SHINGLE):
        word = codes[at + k]
        word[short[left[short] <= k]] = k
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return doc, out


def bags(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, with their counts."""
    keys = np.sort(doc.astype("u8") << np.uint64(HASH_BITS) | hashes >> np.uint64(64 - HASH_BITS))
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    count = np.diff(np.concatenate((first, [len(keys)])))
    return (keys[first] >> np.uint64(HASH_BITS)).astype("i8"), keys[first] & np.uint64((1 << HASH_BITS) - 1), count


def signatures(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures (n x size) of documents given as (doc, element, weight), weights being whole numbers."""
    out = np.full(n * size, np.inf)
    # the processes that a weight touches: range k of the hierarchy begins at 2**(k-1), range 0 at 0
    who, kind = [np.arange(len(doc))], [np.zeros(len(doc), "i8")]
    k = 1
    while len(more := np.flatnonzero(weight > 1 << (k - 1))):
        who.append(more), kind.append(np.full(len(more), k))
        k += 1
    who, kind = np.concatenate(who), np.concatenate(kind)
    low = np.where(kind > 0, 1 << np.maximum(kind - 1, 0), 0)
    rate = np.maximum(low, 1).astype("f8")
    d, top = doc[who], (weight[who] - low) / rate
    seed = mix(element[who] * np.uint64(0x9E3779B97F4A7C15) + kind.astype("u8"))
    x, step = np.zeros(len(who)), 0
    while len(who):
        step += 1
        a = mix(seed + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        b = mix(a + np.uint64(0x632BE59BD9B4E019))
        x = x - np.log(((a >> np.uint64(11)).astype("f8") + 1) / (1 << 53)) / rate
        part = (b & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)
        level = (b >> np.uint64(32)).astype("f8") / (1 << 32)
        good = level < top
        np.minimum.at(out, d[good] * size + part[good].astype("i8"), x[good])
        go = x < out.reshape(n, size).max(1)[d]
        who, d, top, rate, seed, x = who[go], d[go], top[go], rate[go], seed[go], x[go]
    return out.reshape(n, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    bits = signature.view("u8").reshape(len(signature), BANDS, ROWS)
    key = np.zeros(bits.shape[:2], "u8") + np.arange(BANDS, dtype="u8")
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view("i8")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands) of every row; bands is null for texts without words."""

    def run(texts: list[str | None]) -> dict:
        doc, element, weight = bags(*shingles(texts))
        keys = bands(signatures(len(texts), doc, element, weight))
        full = np.isin(np.arange(len(texts)), doc)
        return {"bands": [k if f else None for k, f in zip(keys, full)]}

    return over_texts(docs.select("doc_id", digest().alias("digest"), "text"), run, "bands array<long>", ["doc_id", "digest"], SLICE_CHARS)


def difference(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sizes of the shingle multisets of a[k] and b[k], and their difference as tokens."""
    place = {t: k for k, t in enumerate(dict.fromkeys(b))}  # a leader comes with many of its nodes
    (da, ha), (own, h) = shingles(a), shingles(list(place))
    which = np.array([place[t] for t in b], "i8")
    count = np.bincount(own, minlength=len(place))
    db, at = ranges((np.cumsum(count) - count)[which], np.cumsum(count)[which])
    keys = [d.astype("u8") << np.uint64(HASH_BITS) | x >> np.uint64(64 - HASH_BITS) for d, x in ((da, ha), (db, h[at]))]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    more = np.bincount(at[: len(da)], minlength=len(every)) - np.bincount(at[len(da) :], minlength=len(every))
    key, level = ranges(np.zeros(len(more), "i8"), np.abs(more))
    element = every[key] & np.uint64((1 << HASH_BITS) - 1)
    token = mix(element * np.uint64(0x9E3779B97F4A7C15) + (2 * level + (more[key] > 0)).astype("u8")).view("i8")
    doc = (every[key] >> np.uint64(HASH_BITS)).astype("i8")
    edges = np.searchsorted(doc, np.arange(1, len(a)))
    return np.bincount(da, minlength=len(a)), count[which], np.split(token, edges)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(node, lead, mass) with n, n_lead, diff: numbers of shingles, and the difference as tokens; texts(node, text)."""

    def run(own: list[str], lead: list[str]) -> dict:
        n, n_lead, diff = difference(own, lead)
        return {"n": n, "n_lead": n_lead, "diff": diff}

    one = pairs.join(texts, "node")
    two = one.join(texts.select(F.col("node").alias("lead"), F.col("text").alias("text_lead")), "lead")
    return over_texts(two, run, "n int, n_lead int, diff array<long>", ["node", "lead", "mass"], SLICE_CHARS, ("text", "text_lead"))


def near_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, digest) of docs(doc_id, text), and classes(digest, doc_id, class_id, class_size, keeps) of the distinct texts.

    doc_id is the least of the text's rows. keeps marks one text of each class: that of class_id, or any if no row has a doc_id.
    """
    rows = materialize(signed(docs))
    # numbers are fixed once they are written
    nodes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    places = materialize(places.join(shared, "bucket"))
    members = materialize(places.join(places.groupBy("node").agg(F.sum("size").alias("mass")), "node"))
    some = materialize(members.select("node").distinct().join(nodes.select("node", "digest"), "node"))
    texts = docs.select(digest().alias("digest"), "text").join(sized(some), "digest").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts)
    labels = links(members, lambda pairs: compared(pairs, texts), RATIO)[1]
    known = labelled(nodes.select("digest", "node", "doc_id", "rows"), labels)
    one = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"), F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("keeper"))
    classes = known.join(one, "label").select("digest", "doc_id", "class_id", "class_size", (F.col("node") == F.col("keeper")).alias("keeps"))
    return rows.select("doc_id", "digest"), materialize(classes)


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id (least doc_id of the class), class_size (rows of the class)."""
    rows, classes = near_nodes(docs)
    return rows.join(classes.drop("doc_id"), "digest").select("doc_id", "class_id", "class_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the least doc_id (any text of it if no row has one). Same columns.

    Rows that repeat the doc_id and the text of the document that stays are the same document, and stay.
    """
    rows, classes = near_nodes(docs.select("doc_id", "text"))
    stays = F.col("keeps") & F.col("own").eqNullSafe(F.col("doc_id"))
    gone = rows.select(F.col("doc_id").alias("own"), "digest").join(classes, "digest").filter(~stays).select("own", "digest").distinct()
    gone = sized(materialize(gone))
    return docs.join(gone, (digest() == gone["digest"]) & docs["doc_id"].eqNullSafe(gone["own"]), "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
