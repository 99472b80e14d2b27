"""Cleaning of landed text: blanks, numbers per column, recodes, splits, first rows, empty columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.sources.stage import sized, staged

#: Texts that mean "no value".
BLANKS = ("", "-", "--", "—", "–", "NA", "N/A", "None", "null")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c).isin(*BLANKS), None).otherwise(c)


def number(c: Column) -> Column:
    """A text as a number, without thousands separators; null if it is none."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Text columns become numbers where every value that is not blank is one; ids stay text."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in exclude]
    df = df.withColumns({c: blank_to_null(F.col(c)) for c in text})
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & number(F.col(c)).isNull()).alias(c) for c in text], *[F.count(c).alias(f"{c}__n") for c in text]).first() if text else {}
    return df.withColumns({c: number(F.col(c)) for c in text if bad[c] == 0 and bad[f"{c}__n"]})


def split_pair(c: Column, sep: str = "/") -> tuple[Column, Column]:
    """Two numbers of a text such as 12/20; a missing part is null."""
    parts = F.split(c, sep, 2)
    return F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """Whole values by a map, others as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), c), c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A capture; null where the pattern doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def pad_id(c: Column, width: int = 4) -> Column:
    """A number as text with leading zeros; longer ones stay whole."""
    text = c.cast("double").cast("bigint").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def strip_characters(c: Column, characters: str = ",%@-") -> Column:
    """Without any of the characters, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.translate(c, characters, "")), F.lit(""))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null, once, where data comes in: Spark sorts NaN above all and averages it to NaN."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def display_name(first: str, last: str) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def renamed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Headers by a map, others as they are."""
    return df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})


def header_map(mapping: list[tuple[str, str | None, str, str]], data_src: str, variant: str | None = None) -> dict[str, str]:
    """Header -> metric of rows (data_src, variant, header, metric): a row of the variant goes before one without.

    A variant is a kind of group (the same header means a team's total or one entity's), or a single group.
    """
    own = {h: m for src, v, h, m in mapping if src == data_src and v is None}
    return own | {h: m for src, v, h, m in mapping if src == data_src and v is not None and v == variant}


def mapped_metrics(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """rows(*keys, data_src, variant, header, value) with the metric that mapping(data_src, variant, header, metric) names.

    Mapping rows of the row's variant go before those without one; headers that no row names stay as they are. The
    mapping may be as large as it likes: it is two equi joins, which Spark broadcasts by size.
    """
    own = mapping.filter("variant is not null").select("data_src", "variant", "header", F.col("metric").alias("own_metric"))
    base = mapping.filter("variant is null").select("data_src", "header", F.col("metric").alias("base_metric"))
    found = rows.join(own, ["data_src", "variant", "header"], "left").join(base, ["data_src", "header"], "left")
    return found.select(*keys, "data_src", F.coalesce("own_metric", "base_metric", "header").alias("metric"), "value")


def merged_groups(df: DataFrame, groups: dict[str, str], keys: list[str], order: list[str]) -> DataFrame:
    """Sub-groups as one group each, with the first row of every key by `order` (least struct, no sort)."""
    df = df.withColumn("pos", recode(F.col("pos"), groups))
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in rest]))
    return df.groupBy(*keys).agg(least.alias("f")).select(*keys, *[F.col(f"f.__{c}").alias(c) for c in rest])


def preferred_first(df: DataFrame, first: list[str]) -> DataFrame:
    """Preferred columns in their order, then the rest."""
    have = [c for c in first if c in df.columns]
    return df.select(*have, *[c for c in df.columns if c not in have])


def display_rounded(df: DataFrame, digits: int = 1) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def positive_points(df: DataFrame, points: str = "site_pts", exempt: tuple[str, ...] = ()) -> DataFrame:
    """Rows with points above 0; those of exempt groups all stay."""
    keep = F.nanvl(F.col(points).cast("double"), F.lit(None)) > 0
    return df.filter(keep | F.col("pos").isin(*exempt) if exempt else keep)


def null_for_groups(df: DataFrame, metric: str, groups: list[str]) -> DataFrame:
    """A metric that certain groups cannot have."""
    return df.withColumn(metric, F.when(~F.col("pos").isin(*groups), F.col(metric)))


def keyed_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames in order as one, of equal keys the row of the last frame."""
    rows = None
    for n, df in enumerate(frames):
        df = df.withColumn("__n", F.lit(n))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "__n")]
    last = F.max_by(F.struct(*rest), F.struct("__n", F.struct(*rest)))
    return rows.groupBy(*keys).agg(last.alias("f")).select(*keys, "f.*")


def with_unseen(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of df, and those of more whose key df has not."""
    return df.distinct().unionByName(more.distinct().join(df.select(*keys).distinct(), keys, "left_anti"))


def numbered_headers(names: list[str], second: dict[str, str]) -> list[str]:
    """Headers told apart by occurrence: a repeated name takes its second meaning."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else second.get(n, f"{n}_{seen[n]}"))
    return out


def first_rows(df: DataFrame, keys: list[str], order: list[str], null_key: str) -> DataFrame:
    """The first row of every key by `order`; rows whose null_key is null all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | F.col(null_key).isNull()).drop("__n")


def drop_empty_rows(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.dropna("all", subset=metrics)


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that hold no value at all."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c] or c in keep])


def drop_constant_text(df: DataFrame) -> DataFrame:
    """Without text columns of at most one value."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    n = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in text]).first() if text else {}
    return df.drop(*[c for c in text if n[c] is not False])


def column_kinds(cells: DataFrame, frame: list[str]) -> DataFrame:
    """(frame..., column, is_number, kept) of cells(frame..., column, value): the decisions of numeric_columns, drop_empty_columns and
    drop_constant_text for all frames at once, from one aggregation.

    A column is a number if it has values and all are numbers; it is dropped if it has no value, or is text of one value.
    """
    v = blank_to_null(F.col("value"))
    found = cells.groupBy(*frame, "column").agg(F.count(v).alias("n"), F.count_if(v.isNotNull() & number(v).isNull()).alias("bad"), (F.min(v) < F.max(v)).alias("varies"))
    is_number = (F.col("n") > 0) & (F.col("bad") == 0)
    return found.select(*frame, "column", is_number.alias("is_number"), ((F.col("n") > 0) & (is_number | F.coalesce("varies", F.lit(False)))).alias("kept"))


def typed_cells(cells: DataFrame, frame: list[str]) -> DataFrame:
    """cells(frame..., column, value, ...) of the kept columns that are not blank, with `number` in columns of numbers and `text` in the others."""
    kinds = column_kinds(cells, frame).filter("kept").drop("kept")
    v = blank_to_null(F.col("value"))
    out = cells.join(sized(staged(kinds, "kinds")), [*frame, "column"]).withColumns({"number": F.when(F.col("is_number"), number(v)), "text": F.when(~F.col("is_number"), v)})
    return out.filter("number is not null or text is not null").drop("value", "is_number")


def split_total(total: str, a: str, b: str) -> tuple[Column, Column]:
    """A combined total divided by the shares of a and b; yardages of 0 give all to b, none at all gives null."""
    both = F.nullif(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), F.lit(0.0))
    known = F.coalesce(a, b).isNotNull()
    share = F.coalesce(F.coalesce(a, F.lit(0.0)) / both, F.lit(0.0))
    return F.when(known, F.col(total) * share), F.when(known, F.col(total) * (1 - share))


def split_or_rename(df: DataFrame, total: str, sides: dict[str, str]) -> DataFrame:
    """df with its combined total under the names of sides (yardage column -> metric): split if it has both yardages, renamed if it has one."""
    have = [y for y in sides if y in df.columns]
    if total not in df.columns or not have:
        return df
    if len(have) == 1:
        return df.withColumnRenamed(total, sides[have[0]])
    return df.withColumns(dict(zip((sides[y] for y in have), split_total(total, *have)))).drop(total)


def to_budget(value: str, teams: int, budget: float = 200.0, pool: float = 1000.0) -> Column:
    return F.col(value) * budget / (pool / teams)


def drop_footers(df: DataFrame, cells: str, pattern: str) -> DataFrame:
    """Without rows of which every cell matches."""
    return df.filter(~F.forall(cells, lambda c: c.rlike(pattern)))


def matching_columns(df: DataFrame, pattern: str) -> DataFrame:
    import re

    return df.select(*[c for c in df.columns if re.search(pattern, c)])
