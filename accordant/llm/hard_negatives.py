"""Hard-negative mining over an inverted multi-index, with exact results.

Vectors are cut in two halves, each with a codebook of up to CENTERS centres; the pair of nearest centres is a vector's
cell. An anchor's score of a vector of a cell is at most the sum over the halves of
(anchor . centre + |anchor| x radius), and at least that with the radius taken off. For an anchor a heap visits the cells in falling order of that
sum (the multi-sequence order of the two sorted lists of half bounds), scores the rows of a cell by their whole integer vectors,
and stops when what it looks for is certified: no cell that is left can reach it.

1. Positives: the first POSITIVES other rows of the anchor's label by (score, least vec_id). Certified when the last of them lies above the
   bound of the next cell.
2. Negatives of each positive p: the first NEGATIVES rows of other labels whose score lies within LOW to HIGH per cent of p's. A window is certified when
   the bound falls below its lower edge or below the last row found in it; cells that lie above all windows by their lower bound are not scored.

The codebooks are fitted on a bounded sample (SAMPLE_ROWS rows, those with the least hashes of vec_id); every row is indexed.
The index is a table, dealt by ranges of (cell, vec_id), so that a cell, or copies of one vector, of any size spread
over tasks. Each Arrow batch of it is a part of the index with its own radii. A task keeps what it has found while it
reads on, so later batches are certified sooner, and gives its best rows an anchor at the end; these meet by anchor. Anchors go out in blocks of at most ANCHORS rows, one
broadcast each, and each block passes over the index twice.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; rows that repeat
vec_id, label and vector count once; rows that share an anchor's vec_id are not among its partners, and rows of one anchor's vec_id with
different vectors are anchors each; shorter vectors are continued by zeros; scaled components are held within +-LARGEST; fewer rows than asked for
give all there are; an empty table, or one without anchors, gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_sample, materialize, table

CENTERS, SAMPLE_ROWS, ROUNDS = 16, 4096, 10
ANCHORS, ROWS_A_PART = 16_384, 65_536
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SCALE, LARGEST = 256, 1 << 24
INDEX = "vec_id long, label int, cell int, vector array<int>"
#: Share of a bound that is added against rounding.
SLACK = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (scaled whole numbers) of the rows(vec_id, label, vector) that take part."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vector", lambda x: F.least(F.greatest(F.floor(SCALE * x.cast("double")).cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))).cast("int"))
    known = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("vector")).distinct()


def kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    draw = np.random.default_rng(seed)
    mid = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, mid)
        mid = np.stack([x[near == j].mean(0) if (near == j).any() else mid[j] for j in range(len(mid))])
    return mid


def nearest(x: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return ((mid**2).sum(1) - 2 * x @ mid.T).argmin(1)


class Codebooks:
    """Centres of both halves of vectors of `size` components."""

    def __init__(self, sample: list[list[int]], size: int):
        self.size, self.half = size, size // 2
        x = padded(sample, size)
        self.centers = [kmeans(x[:, s], CENTERS) for s in self.halves()] if len(x) else []

    def halves(self) -> tuple[slice, slice]:
        return slice(0, self.half), slice(self.half, self.size)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(x[:, s], mid) for s, mid in zip(self.halves(), self.centers))
        return a * CENTERS + b


def padded(vectors: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Part:
    """Some rows of the index: the rows of each cell, and centres and radii of the half cells that occur."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, x: np.ndarray, books: Codebooks):
        order = np.lexsort((ids, cells))
        self.ids, self.labels, self.x, cells = ids[order], labels[order], x[order], cells[order]
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        last = np.append(first[1:], len(cells))
        self.halves, numbers = [], []
        for part, mid, half in zip(books.halves(), books.centers, (cells // CENTERS, cells % CENTERS)):
            there, number = np.unique(half, return_inverse=True)
            away = np.sqrt(((self.x[:, part] - mid[half]) ** 2).sum(1))
            radius = np.zeros(len(there))
            np.maximum.at(radius, number, away)
            self.halves.append((part, mid[there], radius))
            numbers.append(number[first].tolist())
        self.rows = {key: (int(a), int(b)) for key, a, b in zip(zip(*numbers), first, last)}
        self.most = float(np.abs(self.x).max(initial=0))

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, float, tuple[int, int]]]:
        """Upper bound, lower bound and rows of the cells in falling order of the upper bound."""
        lists = []
        for part, mid, radius in self.halves:
            own = anchor[part]
            size = np.sqrt((own**2).sum())
            mean, reach = mid @ own, size * radius
            slack = SLACK * (1 + np.abs(mean) + reach)
            order = np.argsort(-(mean + reach + slack))
            lists.append((order.tolist(), (mean + reach + slack)[order].tolist(), (mean - reach - slack)[order].tolist()))
        (one, high_one, low_one), (two, high_two, low_two) = lists
        heap = [(-high_one[0] - high_two[0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (rows := self.rows.get((one[i], two[j]))) is not None:
                yield -bound, low_one[i] + low_two[j], rows
            # each pair of places has one predecessor: along the row, and down the first column
            if j + 1 < len(two):
                heapq.heappush(heap, (-high_one[i] - high_two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-high_one[i + 1] - high_two[0], i + 1, 0))

    def scores(self, anchor: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
        x = self.x[rows[0] : rows[1]]
        if self.most * float(np.abs(anchor).max(initial=0)) * len(anchor) < 2**53:
            return (x @ anchor).astype("i8")  # every partial sum is a whole number that a double holds
        return x.astype("i8") @ anchor.astype("i8")


def kept(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, most: int) -> None:
    """Adds rows to best, which holds the first `most` of (-score, id)."""
    if len(scores) > 4 * most:
        near = np.argpartition(-scores, most - 1)[:most]
        near = np.flatnonzero(scores >= scores[near].min())  # with all ties
        if len(near) > most:
            near = near[np.lexsort((ids[near], -scores[near]))[:most]]
        scores, ids = scores[near], ids[near]
    for row in zip((-scores).tolist(), ids.tolist()):
        if len(best) < most or row < best[-1]:
            insort(best, row)
            del best[most:]


class Anchors:
    """A block of anchors."""

    def __init__(self, rows: list, size: int):
        self.ids, self.labels = [r.vec_id for r in rows], [r.label for r in rows]
        self.x = padded([r.vector for r in rows], size)


def positives(part: Part, anchors: Anchors, found: list[list]) -> None:
    for k, (own, label, best) in enumerate(zip(anchors.ids, anchors.labels, found)):
        x = anchors.x[k]
        for bound, _, (a, b) in part.visit(x):
            if len(best) == POSITIVES and -best[-1][0] > bound:
                break
            fits = np.flatnonzero((part.labels[a:b] == label) & (part.ids[a:b] != own))
            if len(fits):
                kept(best, part.scores(x, (a, b))[fits], part.ids[a:b][fits], POSITIVES)


def window(score: int) -> tuple[int, int]:
    """Least and greatest score of the negatives of a positive; none if the first is above the second."""
    return -(-LOW * score // 100), HIGH * score // 100


def negatives(part: Part, anchors: Anchors, found: list[dict[int, list]]) -> None:
    """found[k][positive score] holds the first rows in its window."""
    for k, (own, label, best) in enumerate(zip(anchors.ids, anchors.labels, found)):
        open_ = [(*window(score), rows) for score, rows in best.items() if window(score)[0] <= window(score)[1]]
        x, top = anchors.x[k], max((w[1] for w in open_), default=0)
        for bound, least, (a, b) in part.visit(x):
            open_ = [w for w in open_ if w[0] <= bound and not (len(w[2]) == NEGATIVES and -w[2][-1][0] > bound)]
            if not open_:
                break
            if least > top:
                continue
            fits = np.flatnonzero((part.labels[a:b] != label) & (part.ids[a:b] != own))
            scores, ids = part.scores(x, (a, b))[fits], part.ids[a:b][fits]
            for low, high, rows in open_:
                floor = max(low, -rows[-1][0]) if len(rows) == NEGATIVES else low
                inside = np.flatnonzero((scores <= high) & (scores >= floor))
                if len(inside):
                    kept(rows, scores[inside], ids[inside], NEGATIVES)


def searched(index: DataFrame, shared, books, start: Callable[[], list], search: Callable, rows_of: Callable[[list], list[tuple]], fields: str) -> DataFrame:
    """What a block of anchors finds in the index, by task."""
    schema = StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = start()
        for batch in batches:
            if batch.num_rows:
                ids, labels, cells = (batch.column(k).to_numpy() for k in range(3))
                x = batch.column(3).flatten().to_numpy().reshape(len(ids), books.value.size).astype("f8")
                search(Part(ids, labels, cells, x, books.value), shared.value, found)
        columns = list(zip(*rows_of(found))) or [[]] * len(schema)
        kinds = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return index.mapInArrow(run, schema)


def first_rows(rows: DataFrame, per: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group by score and id, with rank."""
    order = Window.partitionBy(*per).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mined(index: DataFrame, books, rows: list) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of one block of anchors."""
    spark = index.sparkSession
    anchors = Anchors(rows, books.value.size)
    shared, n = spark.sparkContext.broadcast(anchors), len(rows)
    near = searched(index, shared, books, lambda: [[] for _ in range(n)], positives, lambda found: [(k, -s, i) for k, best in enumerate(found) for s, i in best], "anchor int, score long, id long")
    ahead = first_rows(near, ["anchor"], POSITIVES).select("anchor", "score", "id").collect()  # POSITIVES rows an anchor of the block
    looked = [{} for _ in range(n)]
    for r in ahead:
        looked[r.anchor].setdefault(r.score, [])
    windows = spark.sparkContext.broadcast([list(w) for w in looked])
    far = searched(
        index, shared, books, lambda: [{score: [] for score in w} for w in windows.value], negatives,
        lambda found: [(k, score, -s, i) for k, w in enumerate(found) for score, best in w.items() for s, i in best], "anchor int, positive_score long, score long, id long",
    )
    pairs = spark.createDataFrame([(r.anchor, anchors.ids[r.anchor], r.id, r.score) for r in ahead], "anchor int, anchor_id long, positive_id long, positive_score long")
    hard = first_rows(far, ["anchor", "positive_score"], NEGATIVES).join(F.broadcast(pairs), ["anchor", "positive_score"])
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """Hard negatives of the rows(vec_id, label, vector) that `anchor`, a condition on vec_id, picks."""
    spark = rows.sparkSession
    known = materialize(usable(rows))
    size, n = known.agg(F.max(F.size("vector")), F.count("*")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    books = spark.sparkContext.broadcast(Codebooks([r.vector for r in bounded_sample(known, "vec_id", SAMPLE_ROWS)], size))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column(2).to_pylist(), size)
            whole = pa.array(x.astype("i4").tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(books.value.cells(x).astype("i4")), whole], ["vec_id", "label", "cell", "vector"])

    parts = max(2 * spark.sparkContext.defaultParallelism, n // ROWS_A_PART)
    index = known.mapInArrow(celled, INDEX).repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    index, anchors = materialize(index), known.filter(anchor)
    blocks = -(-anchors.count() * 5 // (4 * ANCHORS))  # blocks by hash stay below ANCHORS
    found = []
    for k in range(blocks):
        block = anchors if blocks == 1 else anchors.filter(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == k)
        rows_ = block.collect()
        if rows_:
            found.append(materialize(mined(index, books, rows_)))
    return reduce(DataFrame.unionByName, found) if found else empty


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "vector"), F.col("vec_id") % 50 == 0)


SQL = f"""
with e as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score from e a join e r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id and not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
