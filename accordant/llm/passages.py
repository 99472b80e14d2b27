"""Substring dedup: passages that repeat, exactly or nearly, in different documents.

Tokens are hashed shingles of five words. For each of HASHES hash functions, compact windows cover the subsequences of
at least WIDTH tokens of a document: the window (l, c, r) stands for all subsequences that begin in l..c and end in
c..r, and c holds the least hash in all of them. The windows are the nodes of the Cartesian tree over the hashes that
are wide enough, found level by level from the root with range-minimum tables, about 2n/WIDTH of them.

Two documents share a near-duplicate passage where windows share the token at c. A window's
key is the hash function with the 13 words around c, so a short phrase that stands in very many documents
makes no large group. Of every key, the window of the least document is compared with all others (a star, never
all pairs):

1. Very frequent keys are settled by broadcast without a shuffle of their windows; of the others, those that stand in
   one document only are dropped by an aggregation.
2. Every document that shares a key with a star document is a pair to verify, in one hash function or in more, and
   however wide the windows are.
3. Verification on the texts: from the common tokens equal runs are chained both ways over changed, inserted and lost
   words; the widest chain that is similar enough counts. A passage is kept if it has WIDTH tokens (50 words) or more and a Jaccard similarity of LEAST or more.
4. Where the star comparison of a key failed for some window, all windows of the key, the star document's too, are
   keyed anew: by every exact run of WIDTH tokens around c, and by the key with the least hashes of the tokens beside it
   (NEAREST on either side, SIDES hash functions each). Equal runs are equal passages by themselves, so no link between
   exact repeats depends on the choice of a star. Near repeats meet again without the documents that share the 13 words
   only, and are compared with the star of the new key.

5. Where the star of a second key failed too, its other windows are split by every token within NEAREST of their key
that the star has not: two windows that share no more than the star does are as unlike as each is to the star. Each token is
a key with a star of its own, and so on, until no key is left that two documents have beside its star. Every round
leaves out the tokens of the stars before, so boilerplate divides no windows twice.

Near repeats are found with a probability, then, which is that of the hash functions and not of the stars: tests measure it with decoys. Windows whose least token stands within SIDE
tokens of the window's edge give no key, as the words beyond the edge need not belong to the passage.

Classes of documents follow from the verified links as connected components. Equal texts are one node throughout. A node
is numbered by 64 bits of its digest, so of n different texts two share a number with a probability of about n^2 / 2^65.

Defined cases: null text is the empty text; texts of fewer than 50 words have no passage and are their own class; a
passage that repeats within one document only is no repeat; a class's number is its least doc_id (which may be negative), null if no
row of it has one; different texts under one doc_id are different nodes, so its rows can have different classes; repeated
rows get the same class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import BASE, INVERSE, mix, powers
from .bpe import slices
from .common import BROADCAST_ROWS, materialize, sized, table
from .components import components
from .decontaminate import words
from .exact_dedup import HOT, TRACKED, digest
from .near_dedup import SHINGLE, shingles

HASHES, LEAST = 6, 0.8
#: Tokens of a passage of 50 words.
WIDTH = 50 - SHINGLE + 1
#: Tokens on either side of c that belong to a key.
SIDE = 4
SLICE_CHARS = 1_500_000
#: Hash functions and tokens of the second key, on either side of the first.
SIDES, NEAREST = 4, 22
#: Rows up to which no key can have too many for one task.
FEW_ROWS = 50_000
#: Unequal tokens up to which the next equal run is looked for first: those of one changed word, then more.
NEAR = (2 * SHINGLE, 32, 256)


def compact_windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of all compact windows of at least `width` values in the stretches [begin, end); ties are split at random places, which keeps the tree flat."""
    # a place, scattered, stands in the low bits of its value, so the least key tells where it is
    bits = max(20, len(values).bit_length())
    low, scatter, back = np.uint64((1 << bits) - 1), np.uint64(BASE), np.uint64(INVERSE)
    key = (values & ~low) | (np.arange(len(values), dtype="u8") * scatter & low)
    wide = end - begin >= width
    l, r = begin[wide], end[wide] - 1
    if not len(l):
        return (np.zeros(0, "i8"),) * 3
    # least[k][i] is the least key in i .. i + 2**k - 1
    least = [key]
    for k in range(1, int((r - l + 1).max()).bit_length()):
        least.append(np.minimum(least[-1][: -(1 << k - 1)], least[-1][1 << k - 1 :]))
    out = []
    while len(l):
        k = np.frexp((r - l + 1).astype("f8"))[1] - 1
        least_of = np.empty(len(l), "u8")
        for level in range(int(k.min()), int(k.max()) + 1):
            own = np.flatnonzero(k == level)
            least_of[own] = np.minimum(least[level][l[own]], least[level][r[own] - (1 << level) + 1])
        c = (least_of * back & low).astype("i8")
        out.append((l, c, r))
        l, r = np.concatenate((l, c + 1)), np.concatenate((c - 1, r))
        wide = r - l + 1 >= width
        l, r = l[wide], r[wide]
    return tuple(np.concatenate(x) for x in zip(*out))


def run_hashes(token: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` tokens, from differences of one running sum."""
    if len(token) < width:
        return np.zeros(0, "u8")
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum(token * powers(INVERSE, len(token)), dtype="u8")))
    return mix((total[width:] - total[:-width]) * powers(BASE, len(token) - width + 1))


def keyed_windows(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Number of the text, number of the hash function, key, c, tokens left and right of c in the window."""
    doc, token = shingles(texts)
    count = np.bincount(doc, minlength=len(texts))
    # texts of fewer than five words have one shingle, and none has WIDTH of them
    end = np.cumsum(count)
    begin = end - count
    if len(token) < WIDTH:
        return (np.zeros(0, "i8"),) * 6
    around = np.concatenate((np.zeros(SIDE, "u8"), run_hashes(token, 2 * SIDE + 1), np.zeros(SIDE, "u8")))
    out = []
    for f in range(HASHES):
        l, c, r = compact_windows(mix(token ^ np.uint64((f + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), begin, end)
        inner = (c - l >= SIDE) & (r - c >= SIDE)
        l, c, r = l[inner], c[inner], r[inner]
        own = doc[c]
        out.append((own, np.full(len(c), f), mix(around[c] + np.uint64(f)).view("i8"), c - begin[own], c - l, r - c))
    return tuple(np.concatenate(x) for x in zip(*out))


def windows(docs: DataFrame) -> DataFrame:
    """(node, key, c) of all windows of docs(node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, SLICE_CHARS):
                own, _, key, c, *_ = keyed_windows(part.text.tolist())
                yield pd.DataFrame({"node": part.node.to_numpy()[own], "key": key, "c": c.astype("i4")})

    return docs.mapInPandas(run, "node long, key long, c int")


def equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens a and b have in common from their begin, looked at in growing blocks."""
    n, k, block = min(len(a), len(b)), 0, 64
    while k < n:
        end = min(n, k + block)
        other = a[k:end] != b[k:end]
        first = int(other.argmax())
        if other[first]:
            return k + first
        k, block = end, 4 * block
    return n


def nearest(a: np.ndarray, b: np.ndarray, room: int) -> tuple[int, int] | None:
    """The places (i, j) of equal tokens a[i] == b[j] with the least i + j, which is `room` at most; of equal ones the least i."""
    # most gaps are a changed word: a small table is faster than arrays, and the smallest serves most
    for near in NEAR:
        near = min(near, room)
        ahead = b[: near + 1].tolist()
        first = dict(zip(reversed(ahead), range(len(ahead) - 1, -1, -1)))
        own = a[: near + 1].tolist()
        least, found = near + 1, None
        if not first.keys().isdisjoint(own):
            for i, t in enumerate(own):
                if i >= least:
                    break
                j = first.get(t)
                if j is not None and i + j < least:
                    least, found = i + j, (i, j)
        if found or room <= near:
            return found
    x, (y, place) = a[: room + 1], np.unique(b[: room + 1], return_index=True)
    if not len(x) or not len(y):
        return None
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    gap = np.where(y[at] == x, np.arange(len(x)) + place[at], room + 1)
    i = int(gap.argmin())
    return (i, int(place[at[i]])) if gap[i] <= room else None


def chain(a: np.ndarray, b: np.ndarray, room: int) -> np.ndarray:
    """Tokens of a, tokens of b and equal ones up to the end of each further equal run, the first row without any."""
    rows, i, j, same = [(0, 0, 0)], 0, 0, 0
    while (step := nearest(a[i:], b[j:], room)) is not None:
        i, j, room = i + step[0], j + step[1], room - sum(step)
        n = equal_run(a[i:], b[j:])
        i, j, same = i + n, j + n, same + n
        rows.append((i, j, same))
    return np.array(rows)


def padded(begin: int, end: int, n: int) -> tuple[int, int]:
    """[begin, end) with WIDTH tokens at least, of n."""
    end = min(n, max(end, begin + WIDTH))
    return max(0, min(begin, end - WIDTH)), end


def aligned(a: np.ndarray, b: np.ndarray, at: int, bt: int, begin: int = 0, end: int | None = None) -> tuple[int, int, tuple[int, int, int, int] | None]:
    """The equal run of a around a[at] == b[bt], and the widest passage around it as tokens [a0, a1) and [b0, b1) if there is one.

    Equal runs are chained over whatever lies between them; a passage ends with equal tokens unless it needs others to have
    WIDTH. [begin, end) is as far as `reach` says that its equal tokens can stand in a.
    """
    end = len(a) if end is None else end
    room = int(min(end - begin, len(b)) * (1 / LEAST - 1) + 1e-6)  # more unequal tokens no passage of these stretches can have
    left, right = equal_run(a[:at][::-1], b[:bt][::-1]), equal_run(a[at:], b[bt:])
    lo, hi = at - left, at + right
    if min(len(a), len(b)) < WIDTH:
        return lo, hi, None
    before = chain(a[begin:lo][::-1], b[: bt - left][::-1], room)
    after = chain(a[hi:end], b[bt + right :], room)
    whole = before[:, None] + (after + (left + right))
    same, most = whole[..., 2], np.maximum(whole, WIDTH)
    fits = same >= LEAST * (most[..., 0] + most[..., 1] - same)
    if not fits.any():
        return lo, hi, None
    x, y = np.unravel_index(np.where(fits, same, 0).argmax(), same.shape)
    spans = padded(lo - int(before[x, 0]), hi + int(after[y, 0]), len(a)), padded(bt - left - int(before[x, 1]), bt + right + int(after[y, 1]), len(b))
    return lo, hi, spans[0] + spans[1]


def heights(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, the running sum of common - LEAST, its largest value from each place on and its least one up to each place."""
    total = np.zeros(len(common) + 1)
    np.cumsum(common - LEAST, out=total[1:])
    return total, np.maximum.accumulate(total[::-1])[::-1], np.minimum.accumulate(total)


def promising(common: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """Whether some stretch of WIDTH tokens or more around each place has a share of LEAST or more of common tokens.

    No passage around the place can exist without one. With P as in `heights` (known, if they are), a stretch [l, r) is rich
    enough if P[r] >= P[l]: the best r for every l is a running maximum from the right, the best l for a place a running
    minimum from the left.
    """
    n = len(common)
    if n < WIDTH:
        return np.zeros(len(at), bool)
    total, right, left = known or heights(common)
    wide = right[WIDTH:] - total[: n - WIDTH + 1]  # the best stretch of WIDTH or more from each l
    # places of the last WIDTH beginnings up to the place
    best = np.full(n + WIDTH, -1.0)
    best[WIDTH - 1 : n] = wide
    best = np.lib.stride_tricks.sliding_window_view(best, WIDTH)[at].max(1)
    far = np.where(at >= WIDTH, right[at + 1] - left[np.maximum(at - WIDTH, 0)], -1.0)
    return np.maximum(best, far) >= -1e-9


def reach(common: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the part around each place that a stretch with a share of LEAST or more of common tokens can lie in.

    With P as in `heights` (known, if they are), a stretch [l, r) around the place has P[r] >= P[l]. So r is no further than the last place
    where P is at least the least P before the place, and l no further than the first where it is at most the largest after it.
    """
    total, right, left = known or heights(common)
    begin = len(total) - np.searchsorted(left[::-1], right[at + 1] + 1e-9, "right")
    end = len(total) - 1 - np.searchsorted(right[::-1], left[at] - 1e-9, "left")
    return begin, end


def passages_of(x: np.ndarray, y: np.ndarray, common: np.ndarray, anchors: np.ndarray) -> dict[tuple[int, int, int, int], list[int]]:
    """The passages (a0, a1, b0, b1) that hold anchors (c in the high, d in the low 32 bits) of two token arrays, with c of these anchors."""
    spots = np.sort(anchors)
    c, d = spots >> 32, spots & 0xFFFFFFFF
    inside = (c < len(x)) & (d < len(y))
    c, d = c[inside], d[inside]
    equal = x[c] == y[d]
    if not equal.any():
        return {}
    known = heights(common)
    good = np.zeros(len(c), bool)
    good[equal] = promising(common, c[equal], known)
    if not good.any():
        return {}
    found: dict[tuple[int, int, int, int], list[int]] = {}
    failed: list[tuple[int, int, int]] = []  # stretches of a and their shift
    begin, end = reach(common, c, known)
    for c, d, good, begin, end in zip(c.tolist(), d.tolist(), good.tolist(), begin.tolist(), end.tolist()):
        for (a0, a1, b0, b1), places in found.items():
            if a0 <= c < a1 and b0 <= d < b1:
                places.append(c)
                break
        else:
            if good and not any(lo <= c < hi and c - d == shift for lo, hi, shift in failed):
                lo, hi, passage = aligned(x, y, c, d, begin, end)
                if passage:
                    found.setdefault(passage, []).append(c)
                else:
                    failed.append((lo, hi, c - d))
    return found


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs(a, b, anchors: c in the high, d in the low 32 bits) the passages found: (a, b, a0, a1, b0, b1, places: c of the anchors in it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y, ordered = None, np.zeros(0, "u8"), np.zeros(0, "u8")
        for batch in batches:
            for part in slices(batch, SLICE_CHARS):
                doc, token = shingles(part.text.tolist())
                edges = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = []
                for k, (a, b, anchors, other) in enumerate(part[["a", "b", "anchors", "text_b"]].itertuples(index=False)):
                    if b != last:  # rows come sorted by b from the join
                        last, y = b, shingles([other])[1]
                        ordered = np.sort(y)
                    x = token[edges[k] : edges[k + 1]]
                    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
                    common = ordered[at] == x
                    found = passages_of(x, y, common, np.asarray(anchors, "i8"))
                    rows += [(a, b, *passage, places) for passage, places in found.items()]
                yield pd.DataFrame(rows, columns=["a", "b", "a0", "a1", "b0", "b1", "places"])

    dealt = texts.repartition("node")  # one exchange serves both joins
    one = pairs.join(dealt.withColumnRenamed("node", "a"), "a")
    two = one.join(dealt.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "anchors", "text", "text_b").mapInPandas(run, "a long, b long, a0 int, a1 int, b0 int, b1 int, places array<int>")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """texts that pairs(a, b), a written table, needs if it has few rows: the others are not dealt. All of them if it has many."""
    if pairs.limit(BROADCAST_ROWS // 2 + 1).count() > BROADCAST_ROWS // 2:
        return texts
    return texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")


def covered(found: DataFrame) -> DataFrame:
    """(node, star, c) of the windows in found passages."""
    return found.select(F.col("a").alias("node"), F.col("b").alias("star"), F.explode("places").alias("c"))


def without(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """rows, a written table, that are not in known. Few rows are broadcast to known first, so that it is not dealt whole for them."""
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = known.join(F.broadcast(rows.select(*on)), on, "left_semi")
    return rows.join(known, on, "left_anti")


def second_keys(token: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places: the key around each place with the least hashes of the NEAREST tokens on either side of it."""
    around, keys, places = run_hashes(token, 2 * SIDE + 1), [], []
    c = c[(c >= SIDE) & (c < len(token) - SIDE)]
    for side, first in ((0, c + SIDE + 1), (1, c - SIDE - NEAREST)):
        fits = (first >= 0) & (first + NEAREST <= len(token))
        near = token[first[fits][:, None] + np.arange(NEAREST)]
        for f in range(SIDES):
            least = mix(near ^ np.uint64((f + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)).min(1, initial=np.iinfo("u8").max)
            keys.append(mix(around[c[fits] - SIDE] + mix(least + np.uint64(2 * f + side))))
            places.append(c[fits])
    return np.concatenate(keys), np.concatenate(places)


def keyed_anew(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, key, at, exact) for places of left(node, places): every exact run of WIDTH tokens that holds a place (at its begin), and the second keys of the places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, SLICE_CHARS):
                doc, token = shingles(part.text.tolist())
                edges = np.searchsorted(doc, np.arange(len(part) + 1))
                parts = []
                for k, places in enumerate(part.places):
                    own = token[edges[k] : edges[k + 1]]
                    c = np.unique(np.asarray(places, "i8"))
                    total = run_hashes(own, WIDTH)
                    inside = np.zeros(len(total) + 1, "i8")
                    np.add.at(inside, np.clip(c - WIDTH + 1, 0, len(total)), 1)
                    np.add.at(inside, np.clip(c + 1, 0, len(total)), -1)
                    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                    key, at = second_keys(own, c)
                    parts.append((np.concatenate((total[start], key)), np.concatenate((start, at)), np.arange(len(start) + len(at)) < len(start)))
                size = [len(p[0]) for p in parts]
                key, at, exact = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"node": np.repeat(part.node.to_numpy(), size), "key": key.view("i8"), "at": at.astype("i4"), "exact": exact})

    return left.join(texts, "node").select("node", "places", "text").mapInPandas(run, "node long, key long, at int, exact boolean")


def surroundings(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, c, near) for places of left(node, places): the distinct tokens within NEAREST on either side of the key around c."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, SLICE_CHARS):
                doc, token = shingles(part.text.tolist())
                edges = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = []
                for k, (node, places) in enumerate(zip(part.node.tolist(), part.places)):
                    own = token[edges[k] : edges[k + 1]].view("i8")
                    for c in np.asarray(places).tolist():
                        sides = own[max(0, c - SIDE - NEAREST) : max(0, c - SIDE)], own[c + SIDE + 1 : c + SIDE + 1 + NEAREST]
                        rows.append((node, c, np.unique(np.concatenate(sides))))
                yield pd.DataFrame(rows, columns=["node", "c", "near"])

    return left.join(texts, "node").select("node", "places", "text").mapInPandas(run, "node long, c int, near array<long>")


def closer(rows: DataFrame, found: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Passages beside found(a, b, a0, a1, b0, b1, places) of windows rows(node, c, star, d) whose star they failed with, as step 5 says; tried(node, star, c, d) are known.

    Windows with one star, at one place of it, are a group, whatever number of keys they share with it.
    """
    more, groups = found.limit(0), None
    rows = materialize(rows.select(F.xxhash64("star", "d").alias("group"), "node", "c", "star", "d").distinct())
    while True:
        open_ = without(rows.filter("node <> star"), covered(found.unionByName(more)), ["node", "star", "c"]).select("group").distinct()
        # the star's other places go on, too
        others = rows.filter("node <> star or c <> d")
        several = others.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("group")
        rows = materialize(others.join(open_.join(several, "group"), "group", "left_semi"))
        if not rows.limit(1).count():
            return more
        if groups is None:
            spots = rows.select("node", "c").unionByName(rows.select(F.col("star").alias("node"), F.col("d").alias("c"))).distinct()
            near = materialize(surroundings(materialize(spots.groupBy("node").agg(F.collect_set("c").alias("places"))), texts))
            own, on, of = near.repartition("node", "c"), ["node", "c"], ["star", "d"]  # one exchange serves both joins
        else:
            own, on, of = groups.withColumnRenamed("group", "above").repartition("above", "node", "c"), ["above", "node", "c"], ["above", "star", "d"]
        stars = own.withColumnsRenamed({"node": "star", "c": "d", "near": "star_near"})
        groups = materialize(rows.join(own, on).join(stars, of).select("group", "node", "c", F.array_except("near", "star_near").alias("near")))
        split = groups.select("group", "node", "c", F.explode("near").alias("token")).select(F.xxhash64("group", "token").alias("key"), F.col("group").alias("above"), "node", "c")
        met = starred(materialize(split), "c")
        rows = materialize(met.select(F.xxhash64("above", "star", "d").alias("group"), "above", "node", "c", "star", "d").distinct())
        fresh = materialize(without(rows.filter("node <> star"), tried, ["node", "star", "c", "d"]).select("node", "star", "c", "d").distinct())
        if not fresh.limit(1).count():
            continue
        tried = tried.unionByName(fresh)
        pairs = materialize(anchored(fresh))
        more = more.unionByName(materialize(verify(pairs, texts_of(pairs, texts))))


def starred(rows: DataFrame, place: str) -> DataFrame:
    """rows(node, key, ...), a written table, of keys that stand in several documents, the star's too, each with star and d: the least node and its place.

    In a table of more than FEW_ROWS, keys with 1/HOT of all rows or more, HOT at most, are found by a sketch, counted, and joined by broadcast, so none of
    their rows is shuffled. The rows of the others are dealt by key.
    """
    ends = F.min("node").alias("star"), F.max("node").alias("last")

    def dealt(rows: DataFrame) -> DataFrame:
        # One exchange serves the aggregation and the join, as the count names every column. Ends are plain numbers, so they
        # are hashed and not sorted; the place is looked for in rows of shared keys only.
        rows = rows.repartition("key")
        shared = rows.groupBy("key").agg(*ends, F.expr(f"count({', '.join(rows.columns)})").alias("n")).filter("n > 1 and star <> last")
        met = rows.join(shared.select("key", "star").hint("shuffle_hash"), "key")
        return met.withColumn("d", F.min(F.when(F.col("node") == F.col("star"), F.col(place))).over(Window.partitionBy("key")))

    if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return dealt(rows)
    named = rows.agg(F.expr(f"approx_top_k(key, {2 * HOT}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    named = materialize(named.select(F.explode("top.item").alias("key"), "n"))
    first = F.min(F.struct("node", place))
    hot = rows.join(F.broadcast(named), "key").groupBy("key").agg(*ends, first[place].alias("d"), F.count("*").alias("size"), F.first("n").alias("n"))
    hot = materialize(hot.filter(F.col("size") * HOT >= F.col("n")).drop("size", "n"))
    if not hot.limit(1).count():
        return dealt(rows)
    settled = rows.join(F.broadcast(hot.filter("star <> last").select("key", "star", "d")), "key")
    return dealt(rows.join(F.broadcast(hot), "key", "left_anti")).unionByName(settled)


def anchored(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, anchors) of rows(node, star, c, d)."""
    anchor = F.shiftleft(F.col("c").cast("long"), 32) + F.col("d")
    return rows.groupBy(F.col("node").alias("a"), F.col("star").alias("b")).agg(F.collect_set(anchor).alias("anchors"))


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows(doc_id, digest), nodes(digest, node, least, rows), spans(node, begin, end) in words, links(a, b) for docs(doc_id, text)."""
    rows = materialize(docs.select("doc_id", digest().alias("digest")))
    nodes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).withColumn("node", F.xxhash64("digest")))
    repeated = materialize(rows.join(nodes.filter("rows > 1").select("digest", "least"), "digest").groupBy("doc_id", "digest", "least").agg(F.count("*").alias("times")))
    own = F.col("doc_id").eqNullSafe(F.col("least"))
    copies = sized(materialize(repeated.filter(~own).select(F.col("doc_id").alias("copy_id"), F.col("digest").alias("copy"))))
    # a digest is a column below the join, so it is made once a text
    texts = docs.select("doc_id", "text", digest().alias("digest")).join(copies, (F.col("digest") == F.col("copy")) & F.col("doc_id").eqNullSafe(F.col("copy_id")), "left_anti").select(F.xxhash64("digest").alias("node"), "text")
    every = materialize(windows(texts).filter("key is not null and node is not null").select("key", "node", "c"))
    # all windows of shared keys, those of the star document too
    met = materialize(starred(every, "c"))
    others = met.filter("node <> star")
    pairs = materialize(anchored(others))
    some = materialize(met.select(F.explode(F.array("node", "star")).alias("node")).distinct())
    some = texts.join(sized(some), "node", "left_semi")
    # a node has one row here, unless whole rows are repeated: only then texts are dealt to be reduced
    twice = repeated.filter(own & (F.col("times") > 1)).limit(1).count()
    some = materialize(some.groupBy("node").agg(F.first("text").alias("text")) if twice else some)
    found = materialize(verify(pairs, some))
    # keys with a window that no passage verified with their star covers: all their places are keyed anew
    open_ = materialize(without(others, covered(found), ["node", "star", "c"]).select("key").distinct())
    left = materialize(met.join(sized(open_), "key", "left_semi").select("node", "c").distinct().groupBy("node").agg(F.collect_set("c").alias("places")))
    anew = materialize(starred(materialize(keyed_anew(left, some).filter("key is not null and node is not null")), "at"))
    same = anew.filter("exact and node <> star").select("node", "star", F.col("at").alias("start"), "d")
    # linked pairs are known, failed ones at these places: at others they are tried again
    tried = materialize(others.select("node", "star", "c", "d").distinct())
    linked = found.select(F.col("a").alias("node"), F.col("b").alias("star")).distinct()
    second = anew.filter("not exact").select("node", "star", F.col("at").alias("c"), "d")
    more = materialize(second.filter("node <> star").select("node", "star", "c", "d").distinct().join(linked, ["node", "star"], "left_anti").join(tried, ["node", "star", "c", "d"], "left_anti"))
    pairs = materialize(anchored(more))
    found = found.unionByName(materialize(verify(pairs, texts_of(pairs, some))))
    found = found.unionByName(closer(second, found, some, tried.unionByName(more)))
    links = found.select("a", "b").unionByName(same.select(F.col("node").alias("a"), F.col("star").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = F.lit(SHINGLE - 1)
    span = lambda df, node, a, b: df.select(F.col(node).alias("node"), F.col(a).alias("begin"), (F.col(b) + last).alias("end"))
    spans = span(found, "a", "a0", "a1").unionByName(span(found, "b", "b0", "b1"))
    spans = spans.unionByName(span(same.withColumn("stop", F.col("start") + WIDTH), "node", "start", "stop")).unionByName(span(same.withColumn("stop", F.col("d") + WIDTH), "star", "d", "stop"))
    return rows, nodes, spans.distinct(), materialize(links)


def joined_spans(spans: DataFrame) -> DataFrame:
    """(node, spans string, n_dup_words): the union of a document's spans, in order of their begin; a span that touches the ones before it continues them."""
    before = Window.partitionBy("node").orderBy("begin", "end")
    rows = spans.distinct().withColumn("reached", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("begin") <= F.col("reached"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("node", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    whole = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("s"), F.sum(F.col("end") - F.col("begin")).alias("n_dup_words"))
    return whole.select("node", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["begin"], x["end"])), ",").alias("spans"), "n_dup_words")


def passage_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id, n_links, duplicated, n_dup_words, spans.

    class_id is the least doc_id among documents linked by repeated passages. n_links counts the verified links of the
    row's text to other texts, plus the other rows with the same text if that has 50 words. spans are begin:end in
    words of the text (end exclusive) of passages that stand in another document, too.
    """
    docs = docs.select("doc_id", "text")
    ids, nodes, spans, links = repeated_passages(docs)
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    twice = materialize(nodes.filter("rows > 1").select("digest", "least"))
    count = F.size(F.split(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " "))
    # of equal texts the one of the least id is counted; others are told by their ids, before digests are made
    firsts = sized(materialize(twice.select("least").distinct()))
    firsts = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select(digest().alias("digest"), "text")
    sizes = firsts.join(sized(twice.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.max(count).alias("n_words"))
    known = nodes.join(labels, "node", "left").join(degree, "node", "left").join(joined_spans(spans), "node", "left").join(sizes, "digest", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = known.join(least, "label").select("digest", "class_id", "rows", "n_words", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("n_dup_words", F.lit(0)).alias("n_dup_words"), F.coalesce("spans", F.lit("")).alias("spans"))
    rows = ids.join(materialize(known), "digest")
    whole = (F.col("rows") > 1) & F.coalesce(F.col("n_words") >= WIDTH + SHINGLE - 1, F.lit(False))
    n_links = F.col("degree") + F.when(whole, F.col("rows") - 1).otherwise(0)
    own = F.when((F.col("rows") > 1) & ~whole & (F.col("degree") == 0), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select(
        "doc_id", own.alias("class_id"), n_links.alias("n_links"), (n_links > 0).alias("duplicated"),
        F.when(whole, F.col("n_words").cast("long")).otherwise(F.col("n_dup_words")).alias("n_dup_words"),
        F.when(whole, F.concat(F.lit("0:"), F.col("n_words").cast("string"))).otherwise(F.col("spans")).alias("spans"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_classes(table(spark, sf_dir, "documents"))
