"""Benchmark decontamination with suffix arrays of the training texts.

Every shard of the training side (a slice of a partition, bounded in characters) gets a suffix array over words: its
places in the order of all the words that follow, by prefix doubling. Every test suffix is looked up there by binary
search. The places that share WINDOW words with it (all words, for a shorter item) are hits, and the longest verbatim
match of a hit place is that with the test suffix before or after it in the merged order. The longest match of each
document is reported with its item and both places.

Words: A-Z lower-cased, then runs of digits, a-z and characters from U+0080. Words that no test item has cannot be
part of a match; they end a suffix, and stretches between them that are shorter than the shortest window are left out
of the suffix array. That loses no match and makes the arrays small. A match counts if it holds a window, so shorter
common stretches are not reported.

The test side is read in blocks of at most BLOCK_BYTES of text, one broadcast each. With one block, documents are mapped
and nothing is shuffled; with several, the documents are written to the shared folder once and every block gives rows
for its hits only, so that workers hold one block at a time. What a shard holds grows with its hits, and with the distinct sets of items that share a
window, not with hits times items.

Defined cases: null texts have no words; an item without words has no window; an item with fewer than WINDOW words is
one window; an item_id that repeats counts once; a null item_id is the empty string; of matches of equal length the one
with the least item_id (as text), then item word, then document word is reported, and null and zeros without a match; repeated
document rows are judged alike; without items no document is contaminated; an empty table gives no rows; further columns are ignored
(`drop_contaminated` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .arrays import Running, common_run, ranges
from .common import materialize, over_texts, table

WINDOW = 10
#: Most bytes of test text in one broadcast.
BLOCK_BYTES = 16 << 20
SHARD_CHARS = 1_000_000
#: Bytes of words to themselves (A-Z to a-z), others to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Suffixes:
    """Texts as word codes with a 0 after each, and their suffix array: `places` in suffix order, with `keys` of their first WINDOW words.

    Stretches of known words with fewer than `least` words are left out.
    """

    def __init__(self, texts: list[list[int]], least: int = 1):
        sizes = np.array([len(t) for t in texts], "i8")
        self.begin = np.cumsum([0, *(sizes + 1)])
        self.codes = np.zeros(self.begin[-1] + WINDOW, ">u4")
        for at, t in zip(self.begin, texts):
            self.codes[at : at + len(t)] = t
        known = np.concatenate(([0], (self.codes != 0).view("i1"), [0]))
        first, last = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = last - first >= max(1, least)
        run, at = ranges(first[long], last[long])
        #: Words from a place to the end of its stretch.
        self.left = np.zeros(len(self.codes) + 1, "i8")
        self.left[at] = last[long][run] - at
        order, self.keys = self.order(at)
        self.places = at[order]

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = self.left[at]
        wide = self.codes[at[:, None] + np.arange(WINDOW)]
        wide[np.arange(WINDOW) >= left[:, None]] = 0
        keys = as_keys(wide)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = ranked[1:] != ranked[:-1]
        number = np.full(len(self.codes) + 1, -1, "i8")
        number[at] = np.arange(len(at))
        rank, step, classes = np.zeros(len(at), "i8"), WINDOW, -1
        # a rank by `step` words and the rank of the place `step` words on give the rank by twice as many
        while len(at):
            rank[order] = np.concatenate(([0], np.cumsum(new)))
            if rank.max() in (classes, len(at) - 1) or step >= left.max():
                break
            classes = rank.max()
            then = np.where(left > step, rank[number[np.minimum(at + step, len(self.codes))]] + 1, 0)
            order = np.lexsort((then, rank))
            new = (rank[order][1:] != rank[order][:-1]) | (then[order][1:] != then[order][:-1])
            step *= 2
        return order, ranked

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1


def as_keys(codes: np.ndarray) -> np.ndarray:
    """Rows of WINDOW big-endian codes as byte strings, which sort as the codes do."""
    return np.ascontiguousarray(codes).view(f"S{4 * WINDOW}").reshape(-1)


class Test:
    """The test suffixes of some items, and their windows: (size, key), the number of a set of items, and the least place."""

    def __init__(self, items: list[tuple[str, str | None]]):
        items = sorted(items, key=lambda x: x[0])
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)] for _, t in items]
        self.array = array = Suffixes(texts)
        self.running = Running(array.codes)
        at, item = array.places, array.text_of(array.places)
        sizes = np.diff(array.begin) - 1
        size = np.minimum(sizes[item], WINDOW)
        whole = (array.left[at] >= WINDOW) | (sizes[item] < WINDOW) & (at == array.begin[item])
        self.shortest = int(size[whole].min()) if whole.any() else 0
        #: By size: keys in order, number of the set of items, least place.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sets: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        for n in np.unique(size[whole]):
            own = np.flatnonzero(whole & (size == n))
            keys, first = np.unique(array.keys[own], return_index=True)
            # suffixes of one window are neighbours in suffix order
            parts = np.split(own, first[1:])
            sets = []
            for part in parts:
                members = np.unique(item[part]).astype("i4")
                number = numbers.setdefault(members.tobytes(), len(self.sets))
                if number == len(self.sets):
                    self.sets.append(members)
                sets.append(number)
            self.windows[int(n)] = keys, np.array(sets, "i8"), np.array([at[part].min() for part in parts], "i8")
        #: Words that a suffix has in common with the next one in order.
        a, b = at[:-1], at[1:]
        self.common = common_run(self.running, a, self.running, b, np.minimum(array.left[a], array.left[b]))

    def least_place(self, k: int, n: int) -> int:
        """The least place among suffixes that have n words in common with the k-th one in order."""
        low = high = k
        while low and self.common[low - 1] >= n:
            low -= 1
        while high < len(self.common) and self.common[high] >= n:
            high += 1
        return int(self.array.places[low : high + 1].min())

    def find(self, shard: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of a window of n words, and where in shard.places it stands: all of them."""
        upper = keys = self.windows[n][0]
        if n < WINDOW:
            wide = keys.view(">u4").reshape(-1, WINDOW).copy()
            wide[:, n:] = 0xFFFFFFFF
            upper = as_keys(wide)
        return ranges(np.searchsorted(shard.keys, keys, "left"), np.searchsorted(shard.keys, upper, "right"))

    def insert(self, shard: Suffixes, running: Running) -> np.ndarray:
        """For every test suffix in order the number of shard suffixes below it, by binary search."""
        array, low = self.array, np.searchsorted(shard.keys, self.array.keys, "left")
        high = np.searchsorted(shard.keys, self.array.keys, "right")
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) // 2
            i, j = shard.places[mid], array.places[go]
            n = common_run(running, i, self.running, j, np.minimum(shard.left[i], array.left[j]))
            below = np.where(shard.left[i] > n, shard.codes[i + n], 0) < np.where(array.left[j] > n, array.codes[j + n], 0)
            low[go] = np.where(below, mid + 1, low[go])
            high[go] = np.where(below, high[go], mid)
        return low

    def longest(self, shard: Suffixes, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the k-th shard suffixes the words of the longest match with a test suffix, and the number of one that has it."""
        running, array = Running(shard.codes), self.array
        above = np.searchsorted(self.insert(shard, running), k, "right")
        place, out = shard.places[k], []
        for near in (above - 1, above):
            near = np.clip(near, 0, len(array.places) - 1)
            other = array.places[near]
            out.append((common_run(running, place, self.running, other, np.minimum(shard.left[place], array.left[other])), near))
        (a, first), (b, second) = out
        return np.maximum(a, b), np.where(a >= b, first, second)


NOTHING = (0, None, 0, 0)


def scan(texts: list[str | None], test: Test) -> list[tuple]:
    """For each text: number of words, marks (one byte a word, 1 if hit; empty if none is), ids of the items found, length, item, item word and text word of the longest match."""
    docs = [words(t) for t in texts]
    out = [(len(d), b"", [], *NOTHING) for d in docs]
    if not test.windows:
        return out
    code = test.vocabulary.get
    shard = Suffixes([[code(w, 0) for w in d] for d in docs], test.shortest)
    edges = np.zeros(shard.begin[-1] + 1, "i8")
    found = []  # text, place, set of items, words of the match, place of the item or, below 0, -1 - number of a test suffix
    for size, (_, sets, places) in test.windows.items():
        window, k = test.find(shard, size)
        if not len(k):
            continue
        at = shard.places[k]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        n, item = np.full(len(k), size), places[window]
        if size == WINDOW:
            n, near = test.longest(shard, k)
            item = -1 - near
        found.append(np.stack([shard.text_of(at), at, sets[window], n, item]))
    if not found:
        return out
    doc, at, sets, n, item = np.concatenate(found, 1)
    hit = np.cumsum(edges[:-1]) > 0
    order = np.lexsort((-n, doc))
    doc, at, sets, n, item = (x[order] for x in (doc, at, sets, n, item))
    begin = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    known: dict[tuple[int, int], int] = {}
    for low, high in zip(begin[:-1], begin[1:]):
        d, top = int(doc[low]), int(n[low])
        start, best = int(shard.begin[d]), []
        for k in range(low, high):
            if n[k] < top:
                break
            place = int(item[k])
            if place < 0 and (place := known.get((int(item[k]), top))) is None:
                place = known[int(item[k]), top] = test.least_place(-1 - int(item[k]), top)
            best.append((place, int(at[k])))
        place, where = min(best)
        number = int(test.array.text_of(np.array([place]))[0])
        items = np.unique(np.concatenate([test.sets[s] for s in np.unique(sets[low:high])]))
        out[d] = (len(docs[d]), hit[start : start + len(docs[d])].tobytes(), [test.ids[i] for i in items], top, test.ids[number], place - int(test.array.begin[number]), where - start)
    return out


def blocks(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """items(item_id, text) in blocks of about BLOCK_BYTES at most; the only rows that come to the driver."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size * 2 // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in block.collect()]


FOUND = ["n_words", "marks", "item_ids", "longest_match", "longest_item", "longest_item_word", "longest_word"]
KINDS = "n_words: bigint, marks: binary, item_ids: array<string>, longest_match: bigint, longest_item: string, longest_item_word: bigint, longest_word: bigint"


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs' columns in the struct `doc`, and the columns FOUND in the struct `found`.

    With several blocks of items the documents are written once; each further block gives rows for its hits only, which
    meet by a document's number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")

    def looked(rows: DataFrame, block: list, keep: list[str]) -> DataFrame:
        test = spark.sparkContext.broadcast(Test(block))
        return over_texts(rows, lambda texts: {"found": [dict(zip(FOUND, r)) for r in scan(texts, test.value)]}, f"found struct<{KINDS}>", keep, SHARD_CHARS)

    every = blocks(items)
    first, second = next(every), next(every, None)
    if second is None:
        return looked(rows, first, ["doc"])
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()))  # numbers are fixed once they are written
    out = [materialize(looked(rows.select("place", "text"), first, ["place"]))]
    for block in (second, *every):
        out.append(materialize(looked(rows.select("place", "text"), block, ["place"]).filter(F.size("found.item_ids") > 0)))
    schema = StructType.fromDDL(f"place long, found struct<{KINDS}>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [reduce(joined, [tuple(f.values()) for f in each]) for each in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([dict(zip(FOUND, m)) for m in met], to_arrow_type(schema["found"].dataType))], ["place", "found"])

    # one row a block and document at most
    met = reduce(DataFrame.unionByName, out).groupBy("place").agg(F.collect_list("found").alias("found")).mapInArrow(merged, schema)
    return rows.select("place", "doc").join(met, "place").select("doc", "found")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with n_words, marks, item_ids (sorted), longest_match, longest_item, longest_item_word, longest_word; these replace columns of docs of the same name."""
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in FOUND]
    return found(docs, items).select(*own, "found.*")


def joined(a: tuple, b: tuple) -> tuple:
    """What two blocks of items found in one text."""
    marks = a[1] or b[1]
    if a[1] and b[1]:
        marks = (np.frombuffer(a[1], "u1") | np.frombuffer(b[1], "u1")).tobytes()
    return a[0], marks, sorted([*a[2], *b[2]]), *min(a[3:], b[3:], key=lambda x: (-x[0], x[1] or "", *x[2:]))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those in which a window of an item occurs; same columns, whatever their names."""
    return found(docs, items).filter(F.size("found.item_ids") == 0).select("doc.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.length(F.translate(F.hex("marks"), "0", ""))
    return found_.select(
        "doc_id", "n_words", hits.cast("long").alias("n_hit"), F.size(F.array_distinct("item_ids")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("item_ids")), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
        "longest_match", "longest_item", "longest_item_word", "longest_word",
    )


def _letters(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows on one diagonal one after the other are one match.
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(_letters("text"))} as w from documents),
b as (select row_number() over () as item, coalesce(cast(item_id as varchar), '') as item_id, w, least({WINDOW}, len(w)) as n
      from (select item_id, {_WORDS.format(_letters("text"))} as w from benchmark) where len(w) > 0),
test as (select item, item_id, n, i as spot, array_to_string(w[i : i + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
train as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as k
          from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from b) where len(w) >= n)),
hit as (select r, i, train.n, item, item_id, spot from train join test on train.n = test.n and train.k = test.k),
marks as (select r, count(distinct i + j) as n_hit from (select r, i, unnest(range(0, n)) as j from hit) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by r),
runs as (select *, i - row_number() over (partition by r, item, i - spot order by i) as run from hit),
found as (select r, item_id, min(spot) - 1 as item_word, min(i) - 1 as word, count(*) + max(n) - 1 as length from runs group by r, item, item_id, i - spot, run),
longest as (select * from found qualify row_number() over (partition by r order by length desc, item_id, item_word, word) = 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(length, 0) as longest_match, item_id as longest_item, coalesce(item_word, 0) as longest_item_word, coalesce(word, 0) as longest_word
from d left join marks using (r) left join items using (r) left join longest using (r)
"""
