"""N-gram Jaccard self-join with set relations: index lists that are skipped by block and position, and answers of a set
that are derived from those of a similar set.

A document's set holds its distinct SHINGLE-word shingles (words: A-Z lower-cased, runs without ASCII white space; a text
with fewer words is one shingle) as 64-bit hashes. Two documents link when PART times the intersection is at least LEAST
times the union, and no link between different sets is lost:

1. Equal sets are one node. A node is listed under few of its tokens: of its q least hashes, in the order from rare to
   frequent, so many that a similar node must share one of them (a prefix of a prefix: similar sets share at least k of
   their q least hashes, so the q - k + 1 rarest of these hold a common one). Tokens of a single node come first and need
   no list; a node with too many of them has no partner and leaves, and the rest is counted once more.
2. The lists are cut into blocks by set size, so wide that a set's partners lie in its own block or in a neighbour. A set
   enters the list of its own block and that of the block below, each only as far as a partner of the sizes found there
   can still reach the overlap with what both have left behind that place; it skips the block otherwise. How far that is
   follows from its size alone (`reach`).
3. A block is compared with one leader, by the sets. Every other pair of the block is answered incrementally from the
   answers of its leader (`cells`): from the differences of both to the leader, without comparing their sets. So a family
   of n copies costs n comparisons and an equi join of what differs, not n^2.

`classes` numbers the nodes that links join; a node's links to its leader stand for the others (`found` counts them).

Defined cases: null text, and text without words, has an empty set and no link, and is its own component; a text of
fewer words is one shingle; repeated rows have equal sets and the same component; a component's number is its least
doc_id, null if no row of it has one (a row with an empty set keeps its own doc_id, null or not); different texts under one doc_id are judged apart, so
that rows of one doc_id can have different components; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import BASE, INVERSE, mix, powers
from .cells import labelled, links
from .common import materialize, over_texts, sized, table

SHINGLE, LEAST, PART = 4, 85, 100
#: Sets are similar if their difference times RATIO[0] is at most the sum of their sizes times RATIO[1].
RATIO = (PART + LEAST, PART - LEAST)
SLICE_CHARS = 1_000_000
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], "u1")
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mix(np.arange(1, 257, dtype="u8") * np.uint64(BASE))


def ceil_div(a, b):
    return -(-a // b)


def edges(most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the blocks: a set of block k has all its partners in the blocks k - 1 to k + 1."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * PART // LEAST + 1)
    return np.array(out, "i8")


EDGES = edges()


def listed(n):
    """q and k: of the q least hashes of a set of n tokens, a partner of at most its size shares k or more."""
    p = n - ceil_div(LEAST * n, PART) + 1
    k = np.maximum(1, p // 3)
    return p + k - 1, k


@lru_cache(1 << 16)
def reach(n: int) -> tuple[int, int, int]:
    """Block of a set of n tokens, and how many of its places enter the lists of that block and of the block below."""
    block = int(np.searchsorted(EDGES, n, "right")) - 1
    q = int(listed(n)[0])

    def places(low: int, high: int) -> int:
        if low > high:
            return 0
        m = np.arange(low, high + 1)
        overlap = ceil_div(LEAST * (n + m), PART + LEAST)
        # of the common tokens, those behind the q least hashes of either set may be missing
        shared = np.minimum(overlap - n + q, overlap - m + listed(m)[0])
        return q - int(max(1, shared.min())) + 1

    least, most, edge = ceil_div(LEAST * n, PART), PART * n // LEAST, int(EDGES[block])
    return block, places(max(least, edge), most), places(least, edge - 1)


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingles of each text, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([1, *[len(r) + 1 for r in raw]])
    data = FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", "u1")]
    blank = BLANK[data]
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # a word's hash is a difference of one running sum over all bytes
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum(BYTES[data] * powers(INVERSE, len(data)), dtype="u8")))
    word = mix((total[end] - total[start]) * powers(BASE, len(data))[start] + (end - start).astype("u8"))
    edge = np.searchsorted(start, begin)
    out = []
    step = np.uint64(BASE)
    every = np.zeros(max(0, len(word) - SHINGLE + 1), "u8")
    for k in range(SHINGLE):
        every = mix(every * step + word[k : k + len(every)])
    for low, high in zip(edge[:-1], edge[1:]):
        if high - low >= SHINGLE:
            out.append(np.unique(every[low : high - SHINGLE + 1]))
        else:
            one = np.full(min(1, high - low), high - low, "u8")
            for k in range(low, high):
                one = mix(one * step + word[k : k + 1])
            out.append(one)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, digest, n, block, own, below, least of every row: its set's digest and size, its `reach`, its q least hashes."""

    def run(texts: list[str | None]) -> dict:
        own = sets(texts)
        n = [len(s) for s in own]
        far = [reach(k) if k else (0, 0, 0) for k in n]
        block, here, below = zip(*far)
        return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in own], "n": n, "block": block, "own": here, "below": below, "least": [s[: listed(k)[0]].view("i8") if k else None for s, k in zip(own, n)]}

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return over_texts(rows, run, "digest binary, n long, block int, own int, below int, least array<long>", ["doc_id", "key"], SLICE_CHARS)


def placed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows(node, token) of tokens that several nodes have, with block, own, below and `place`; nodes(node, q, block, own, below) that no list needs are left out."""
    times = rows.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    shared, node = rows.join(times, "token").join(sized(nodes), "node"), Window.partitionBy("node")
    place = F.col("q") - F.count("*").over(node) + F.row_number().over(node.orderBy("times", "token")) - 1
    first = F.min("place").over(node)
    return shared.withColumn("place", place).withColumn("first", first).filter("first < greatest(own, below)").drop("times", "first", "q")


def index_lists(heads: DataFrame) -> DataFrame:
    """members(bucket, node, mass) of heads(node, block, own, below, least): a bucket is the list of a token and a block."""
    nodes = materialize(heads.select("node", F.size("least").alias("q"), "block", "own", "below"))
    # a posting is two numbers when it is dealt; what belongs to its node comes back to the few that several nodes share
    kept = materialize(placed(heads.select("node", F.explode("least").alias("token")), nodes).select("node", "token"))
    kept = placed(kept, nodes)
    blocks = F.array_compact(F.array(F.when(F.expr("place < own"), F.col("block")), F.when(F.expr("place < below"), F.col("block") - 1)))
    # lists of one hash would only be looked at together
    lists = materialize(kept.select("node", "token", F.explode(blocks).alias("in")).select("node", F.xxhash64("token", "in").alias("bucket")))
    sizes = lists.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    lists = materialize(lists.join(sizes, "bucket"))
    return materialize(lists.join(lists.groupBy("node").agg(F.sum("size").alias("mass")), "node").select("bucket", "node", "mass"))


def set_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, set) of nodes(node, key, digest), made again from the texts of docs."""

    def run(texts: list[str | None]) -> dict:
        own = sets(texts)
        return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in own], "set": [s.view("i8") for s in own]}

    key = F.xxhash64("text")
    texts = docs.join(sized(nodes.select("key").distinct()), key == F.col("key"), "left_semi").select("text")
    made = over_texts(texts, run, "digest binary, set array<long>", [], SLICE_CHARS)
    return made.join(sized(nodes.select("node", "digest")), "digest").groupBy("node").agg(F.first("set").alias("set")).withColumn("n", F.size("set"))


def compared(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(node, lead, mass) with n, n_lead, diff; of(node, n, set)."""
    one = pairs.join(of.select("node", "n", F.col("set").alias("a")), "node")
    two = one.join(of.select(F.col("node").alias("lead"), F.col("n").alias("n_lead"), F.col("set").alias("b")), "lead")
    return two.select("node", "lead", "mass", "n", "n_lead", F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("diff"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, digest, n) of docs(doc_id, text), and nodes(digest, label, found) of the distinct sets: class and links found."""
    rows = materialize(signed(docs).withColumn("row", F.monotonically_increasing_id()))  # numbers are fixed once they are written
    nodes = materialize(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min_by("key", "row").alias("key")))
    heads = rows.join(sized(nodes.select("node")), F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node")
    members = index_lists(heads)
    some = materialize(members.select("node").distinct().join(nodes, "node"))
    of = materialize(set_table(docs.select("text"), some))
    verified, labels = links(members, lambda pairs: compared(pairs, of), RATIO)
    ends = verified.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("found"))
    known = labelled(nodes.select("digest", "node"), labels).join(ends, "node", "left")
    return rows.select("doc_id", "digest", "n"), known.select("digest", "label", F.coalesce("found", F.lit(0)).alias("found"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, component_size (rows), links_found (by its set, other than equal sets)."""
    rows, nodes = classes(docs)
    # numbers of equal sets meet per set before they meet per class
    least = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).join(nodes, "digest")
    whole = least.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("size").alias("component_size"))
    known = materialize(nodes.join(whole, "label").select("digest", "component_id", "component_size", "found"))
    out = rows.join(known, "digest", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 1).otherwise(F.col("component_size")).alias("component_size"), F.coalesce("found", F.lit(0)).alias("links_found"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
