"""Helpers that the operators of this folder share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from accordant.sources.stage import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Writes a table into the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.
materialize = staged


#: Rows of a few numbers or digests that a join may broadcast (about 100 MB in memory at most); of more, Spark picks the join.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """df, marked as the side of a join that is broadcast if a count shows that it is small."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def remainder(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def bounded_sample(df: DataFrame, key: str, rows: int, per: str | None = None, most: int = 12_000) -> list:
    """The rows with the least hashes of `key`, `rows` of each value of `per`, whatever the partitioning.

    `most` bounds the whole sample: of that many values the most frequent ones count, and each has `most` / values rows
    if that is fewer than `rows`. Two passes serve all values: counts, then rows below a hash that leaves a few more
    than asked for, cut to `rows` in every task before they meet. They come ordered by value and hash.
    """
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 40))
    marked = df.withColumn("__per", F.col(per).cast("string") if per else F.lit("")).filter("__per is not null").withColumn("__spread", spread)
    counts = marked.groupBy("__per").count().orderBy(F.col("count").desc(), "__per").limit(most).collect()
    if not counts:
        return []
    rows = max(1, min(rows, most // len(counts)))
    margin = rows + 8 * rows**0.5 + 8  # the number below a hash varies by about the root of it
    sizes = {r["__per"]: r["count"] for r in counts}
    tops = {value: int((1 << 40) * min(1.0, margin / n)) for value, n in sizes.items()}
    least = Window.partitionBy("__per").orderBy("__spread", *[F.col(c) for c in df.columns])
    out: list = []
    while tops:
        top = F.element_at(F.from_json(F.lit(json.dumps(tops)), "map<string,long>"), F.col("__per"))
        kept = marked.filter(F.col("__spread") < top).withColumn("__n", F.row_number().over(least)).filter(F.col("__n") <= rows)
        found = kept.drop("__spread").collect()
        # a key with very many rows can leave too few others below the hash: then twice as far, for that value only
        short = {v for v, t in tops.items() if t < 1 << 40 and sum(r["__per"] == v for r in found) < min(rows, sizes[v])}
        out += [r for r in found if r["__per"] not in short]
        tops = {v: min(1 << 40, 2 * tops[v]) for v in short}
    return sorted(out, key=lambda r: (r["__per"], r["__n"]))


def at_path(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column of the batch, or a field of a struct in it by names with / between them."""
    name, *inside = path.split("/")
    out = batch.column(name)
    for name in inside:
        out = out.field(name)
    return out


def slices(batch: pa.RecordBatch, chars: int, texts: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters in their texts: bounds what one step holds besides the largest text. Lengths are taken in Arrow, so no text is made a Python string for them."""
    begun = size = 0
    columns = [c for c in (at_path(batch, t) for t in texts) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    for k, each in enumerate(zip(*[pc.utf8_length(c).to_pylist() for c in columns])):
        size += sum(n or 0 for n in each)
        if size >= chars:
            yield batch.slice(begun, k + 1 - begun)
            begun, size = k + 1, 0
    if begun < batch.num_rows:
        yield batch.slice(begun)


def over_texts(docs: DataFrame, run: Callable[..., dict], fields: str, keep: list[str] | None = None, chars: int = 2_000_000, texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs' columns `keep` (all of them if None), and beside them the `fields` that run makes of a slice of the texts.

    run takes one list a column of `texts` and gives one sequence a field. A text that is also kept (a column, or a field
    of a struct: doc/text) is sent once and read where it is kept. The kept columns stay in Arrow from end to end:
    no value of theirs passes through Python or numpy, so a number beside a null keeps all its digits. They travel in one
    struct, so their names cannot clash with those of the texts; a kept column of a field's name gives way to the field.
    """
    kept = docs.columns if keep is None else keep
    made = StructType.fromDDL(fields)
    inside = {t: f"__row/{t}" if t.split("/")[0] in kept else t for t in texts}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), *[F.col(f"`{t}`") for t in texts if inside[t] == t])
    paths = tuple(inside.values())
    kinds = {f.name: to_arrow_type(f.dataType) for f in made}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars, paths):
                got = run(*[at_path(part, t).to_pylist() for t in paths])
                yield pa.RecordBatch.from_arrays([part.column("__row"), *[pa.array(got[n], kind) for n, kind in kinds.items()]], ["__row", *kinds])

    out = rows.mapInArrow(mapped, StructType([StructField("__row", rows.schema["__row"].dataType), *made]))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in kept if c not in kinds], *kinds)
