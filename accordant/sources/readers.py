"""Landed files and payloads to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with everything as text; NA and empty are null."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, nullValue="NA", emptyValue="")


def typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def code_map(df: DataFrame, payload: str, codes: dict[str, str]) -> DataFrame:
    """Metrics of a JSON object of code -> number, by a map of codes."""
    parsed = df.withColumn("__m", F.from_json(payload, "map<string,double>"))
    return parsed.withColumns({name: F.element_at("__m", code) for code, name in codes.items()}).drop("__m")


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns a_b, at any depth."""

    def walk(field: T.StructField, path: str, name: str) -> list[Column]:
        if isinstance(field.dataType, T.StructType):
            return [c for f in field.dataType for c in walk(f, f"{path}.`{f.name}`", f"{name}_{f.name}")]
        return [F.col(path).alias(name)]

    return df.select(*[c for f in df.schema for c in walk(f, f"`{f.name}`", f.name)])


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, place, link) of link targets that match, the first of repeats."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))
    return pages.select("page_id", F.posexplode(found).alias("place", "link"))


def script_value(pages: DataFrame, pattern: str, kind: str) -> DataFrame:
    """The value that a script of the page assigns or passes, parsed as `kind`."""
    return pages.select("page_id", F.nullif(F.regexp_extract("html", pattern, 1), F.lit("")).try_cast(kind).alias("value"))


def script_json(pages: DataFrame, variable: str, schema: str) -> DataFrame:
    """JSON that a script assigns to a variable: (page_id, value)."""
    return pages.select("page_id", F.from_json(F.regexp_extract("html", rf"(?s)\b{variable}\s*=\s*(\{{.*?\}});", 1), schema).alias("value")).filter("value is not null")


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell, self.span = [], [], None, 1
        self.plain: set[int] = set()  # rows with a td

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.close_cell()
            if tag == "td":
                self.plain.add(id(self.open[-1][-1]))
            span = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], int(span) if span.isdigit() else 1

    def close_cell(self):
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1] += [" ".join("".join(self.cell).split())] * self.span
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


#: A tag without anything that needs the parser: attributes are plain, or quoted without angle brackets.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/]+))?)*)[ \t\n]*>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z-]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>=`/]+)))?""")
CELL_TAGS = {"td", "th", "tr", "table"}
#: Elements whose content the parser reads in its own way.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext", "noscript", "svg", "math"}


def _plain_cells(html: str) -> tuple[list, set[int]] | None:
    """`tables` and `plain` of _Cells for a page of plain tags, by one split instead of a parser; None for pages with anything else."""
    parts = TAG.split(html)
    if 4 * html.count("<") != len(parts) - 1 or "&" in html:
        return None
    tables, opened, cell, span, plain = [], [], None, 1, set()
    for slash, name, attrs, text in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4]):
        name = name.lower()
        if slash and attrs or name in RAW:
            return None
        if name in CELL_TAGS:
            begins = not slash and name in ("td", "th") and opened and opened[-1]
            if slash or begins:
                if cell is not None and opened and opened[-1]:
                    opened[-1][-1].extend([" ".join(cell.split())] * span)
                cell = None
            if begins:
                cell, span = "", 1
                if name == "td":
                    plain.add(id(opened[-1][-1]))
                if attrs:
                    wide = {k.lower(): v or w or x for k, v, w, x in ATTRIBUTE.findall(attrs)}.get("colspan") or "1"
                    span = int(wide) if wide.isdigit() else 1
            elif name == "tr":
                if not slash and opened:
                    opened[-1].append([])
            elif name == "table":
                if not slash:
                    tables.append([])
                    opened.append(tables[-1])
                elif opened:
                    opened.pop()
        if cell is not None and text:
            cell += text
    if cell is not None and opened and opened[-1]:
        opened[-1][-1].extend([" ".join(cell.split())] * span)
    return tables, plain


def _cells(html: str) -> tuple[list, set[int]]:
    """The tables of a page, and which of their rows have a td."""
    plain = _plain_cells(html)
    if plain is None:
        parser = _Cells()
        parser.feed(html)
        parser.close_cell()
        plain = parser.tables, parser.plain
    return plain


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells, heads) of every table row; a colspan repeats its cell, short rows are padded, heads tells rows of header cells only."""
    schema = "page_id long, table_no int, row_no int, cells array<string>, heads boolean"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(*[c.to_pylist() for c in batch.columns]):
                found, plain = _cells(html or "")
                for t, table in enumerate(found):
                    width = max(map(len, table), default=0)
                    rows += [(page, t, k, r + [""] * (width - len(r)), bool(r) and id(r) not in plain) for k, r in enumerate(table)]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["page_id", "table_no", "row_no", "cells", "heads"])

    return pages.select(F.col("page_id").cast("long"), "html").filter(F.col("html").rlike("(?i)<table")).mapInArrow(run, schema)


def joined_headers(first: Column, second: Column) -> Column:
    """Two header rows as one: names joined by a blank, white space collapsed."""
    return F.zip_with(first, second, lambda a, b: F.trim(F.regexp_replace(F.concat_ws(" ", a, b), r"\s+", " ")))


def map_of_objects(df: DataFrame, payload: str, value_schema: str) -> DataFrame:
    """JSON map id -> object as rows (id, fields); entries that are no objects drop out."""
    rows = df.select(F.explode(F.from_json(payload, f"map<string,struct<{value_schema}>>")).alias("id", "o"))
    return rows.filter("o is not null").select("id", "o.*")


def roster_rows(rosters: DataFrame) -> DataFrame:
    """One row per (roster, player) of rosters(roster_id, owner_id, players, starters, reserve arrays)."""
    starters = F.filter(F.coalesce("starters", F.array()), lambda s: s.isNotNull() & (s != "0"))
    return rosters.select("roster_id", "owner_id", F.explode("players").alias("player"), starters.alias("s"), F.coalesce("reserve", F.array()).alias("r")).select(
        "roster_id", "owner_id", "player", F.array_contains("s", F.col("player")).alias("is_starter"), F.array_contains("r", F.col("player")).alias("is_reserve")
    )


def draft_slots(drafts: DataFrame) -> DataFrame:
    """One row per slot 1..teams of drafts(draft_id, teams, order map<user,slot>); slots can be unassigned."""
    slots = drafts.select("draft_id", F.explode(F.sequence(F.lit(1), F.col("teams"))).alias("slot"))
    taken = drafts.select("draft_id", F.explode("order").alias("user_id", "slot"))
    return slots.join(taken, ["draft_id", "slot"], "left")


def covered(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lines whose source covers their group: catalogue(data_src, positions array)."""
    pairs = catalogue.select("data_src", F.explode("positions").alias("pos"))
    return lines.join(F.broadcast(pairs), ["data_src", "pos"], "left_semi")


def until_short_page(rows: DataFrame, size: int, least: float) -> DataFrame:
    """Pages of a paged source up to the first that is short or whose least points are not above `least`."""
    from pyspark.sql import Window

    pages = rows.groupBy("source", "page").agg(((F.count("*") < size) | (F.min("points") <= least)).cast("int").alias("stop"))
    before = F.coalesce(F.max("stop").over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(pages.withColumn("done", before).filter("done = 0").select("source", "page"), ["source", "page"])
