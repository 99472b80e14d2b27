"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Every text becomes a SHA-256 digest; null counts as the empty text.
2. A frequent-items sketch (Spark's `approx_top_k`, a mergeable form of the Misra-Gries summary) names every digest
   that can hold `1/HOT` or more of all rows. Its memory is bounded by TRACKED counters a task.
3. The named digests are counted exactly; those that truly hold such a share are the winners. There can be no more
   than HOT of them, which bounds the broadcast at about 100 KB.
4. Rows of winners are settled map-side by that broadcast. The others are shuffled by digest; no group among them
   holds more than 1/HOT of the rows.

Defined cases: null text is the empty text; a null doc_id is a document that loses to any numbered one; rows that
repeat a doc_id and a text are one document, so all of them are marked alike (`drop_exact_copies` still leaves one
row); an empty table gives no rows; further columns are ignored by `exact_copies` and carried by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: A digest with 1/HOT of all rows or more is settled by broadcast.
HOT = 1000
#: Counters of the sketch. Its error is below 3.5/16384 of the rows here, so no digest with 1/HOT can be missed.
TRACKED = 10_000


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests of rows(doc_id, digest): HOT rows at most."""
    named = rows.agg(F.expr(f"approx_top_k(hex(digest), {2 * HOT}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    named = named.select(F.explode("top.item").alias("item"), "n").select(F.unhex("item").alias("digest"), "n")
    counted = rows.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("n").alias("n"))
    return counted.filter((F.col("group_size") > 1) & (F.col("group_size") * HOT >= F.col("n"))).drop("n")


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select("doc_id", digest().alias("digest")))
    hot = F.broadcast(materialize(winners(rows)))
    group = Window.partitionBy("digest")
    rest = rows.join(hot, "digest", "left_anti").withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count("*").over(group)})
    out = rows.join(hot, "digest").unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of equal texts one row stays, with the largest doc_id. All columns are kept."""
    keyed = docs.withColumn("__digest", digest())
    rows = keyed.select("doc_id", F.col("__digest").alias("digest"))
    hot = materialize(winners(rows)).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__hot"))
    # copies of frequent texts go before the shuffle; what is left of them is about one row each
    left = keyed.join(F.broadcast(hot), "__digest", "left").filter(F.col("__hot").isNull() | F.col("doc_id").eqNullSafe(F.col("__keep")))
    first = F.row_number().over(Window.partitionBy("__digest").orderBy(F.col("doc_id").desc_nulls_last()))
    return left.withColumn("__row", first).filter("__row = 1").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
