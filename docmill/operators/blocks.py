"""Typed blocks from pages of text, and running headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.functions import text as T


def page_lines(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, line_no, line) of rows with keys, page and text; line numbers run within a page."""
    return pages.select(*keys, "page", F.posexplode(T.lines(F.coalesce(F.col("text"), F.lit("")))).alias("line_no", "line"))


def split_pages(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, text): a form feed begins a page; pages count from 1."""
    return docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\f", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def classify(lines: DataFrame) -> DataFrame:
    """Adds s (the stripped line) and kind."""
    return lines.withColumn("s", T.strip(F.col("line"))).withColumn("kind", T.line_kind(F.col("line"), F.col("s")))


#: Lines of one tile, the most that one group of the scan below holds.
TILE = 4096
_JOIN = ("paragraph", "table")
_SOLID = ("heading", "table", "step", "paragraph")


def placed(lines: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """Classified lines with what depends on the lines before them in their document: ``island``, the number of the run
    of lines that a line is in; ``section``, the last heading before or at it; ``seen``, how many lines of each kind of
    block came up to it (separator rows count for none). Adds row, a table line's cells, too.

    The lines of a document needn't meet in one task: each tile of neighbouring lines of a page is scanned by itself, as
    if nothing came before, and tells its first and last kind, its counts and its last heading. Only these few values, a
    row a tile, are put in order by document; what comes out is joined back to the tiles, which lie as they did. Rows
    with a null key, page or line number go.
    """
    row = F.when(F.col("kind") == "table", T.cells(F.col("line")))
    rows = lines.withColumn("row", row).withColumn("_tile", F.floor(F.col("line_no") / tile))
    # found before the scan's shuffle, so that what a tile tells needs no text there
    rows = rows.withColumn("_solid", F.when((F.col("kind") != "table") | ~T.is_separator(F.col("row")), F.col("kind"))).withColumn("_head", F.when(F.col("kind") == "heading", T.heading(F.col("s"))))
    own = [key, "page", "_tile"]
    w = W.partitionBy(*own).orderBy("line_no")
    fresh = F.when(F.lag("kind").over(w).isNull(), 0).when((F.lag("kind").over(w) == F.col("kind")) & F.col("kind").isin(*_JOIN), 0).otherwise(1)
    rows = rows.withColumn("_fresh", fresh)
    rows = rows.withColumn("_island", F.sum("_fresh").over(w)).withColumn("_section", F.last("_head", ignorenulls=True).over(w))
    rows = rows.withColumn("_seen", F.struct(*(F.count(F.when(F.col("_solid") == k, 1)).over(w).alias(k) for k in _SOLID)))
    told = rows.groupBy(*own).agg(
        F.min_by("kind", "line_no").alias("first"), F.max_by("kind", "line_no").alias("final"), F.sum("_fresh").alias("islands"),
        F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("line_no"))).alias("head"), *(F.count(F.when(F.col("_solid") == k, 1)).alias(k) for k in _SOLID),
    )
    order = W.partitionBy(key).orderBy("page", "_tile")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    goes_on = (F.lag("page").over(order) == F.col("page")) & (F.lag("final").over(order) == F.col("first")) & F.col("first").isin(*_JOIN)
    told = told.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    carry = told.select(
        *own, (F.coalesce(F.sum(F.col("islands") + F.col("begins")).over(before), F.lit(0)) + F.col("begins")).alias("_islands"), F.last("head", ignorenulls=True).over(before).alias("_carried"),
        F.struct(*(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in _SOLID)).alias("_earlier"),
    )
    rows = rows.join(carry, own)
    seen = F.struct(*((F.col("_seen")[k] + F.col("_earlier")[k]).alias(k) for k in _SOLID))
    return rows.select(*lines.columns, "row", (F.col("_island") + F.col("_islands")).alias("island"), F.coalesce("_section", "_carried").alias("section"), seen.alias("seen"))


def blocks(lines: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """(key, block_no, kind, text, page, rows, island, section, seen) from classified lines.

    Neighbouring paragraph lines join by a space and neighbouring table rows by a line feed; a page's end
    ends both. Separator rows vanish, and a table of nothing else makes no block. island rises with the blocks of a
    document, section is the last heading before or at a block, seen counts as in ``placed``. block_no counts a document's blocks
    in one window, which Spark leaves out where the column isn't used; island is an order too, and needs none.
    """
    solid = placed(lines, key, tile).where(~F.col("kind").isin("blank", "navigation"))
    grouped = solid.groupBy(key, "island", "kind", "page").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "s", "row"))).alias("own"), F.min_by("section", "line_no").alias("section"), F.min_by("seen", "line_no").alias("seen")
    )
    rows = F.when(F.col("kind") == "table", F.filter(F.transform("own", lambda x: x["row"]), lambda r: ~T.is_separator(r)))
    joined = F.array_join(F.transform("own", lambda x: x["s"]), " ")
    text = (
        F.when(F.col("kind") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n"))
        .when(F.col("kind") == "heading", T.heading(joined))
        .otherwise(T.strip(joined))
    )
    made = grouped.withColumn("rows", rows).where("kind <> 'table' or size(rows) > 0").withColumn("text", text)
    number = F.row_number().over(W.partitionBy(key).orderBy("island")) - 1
    return made.select(key, number.alias("block_no"), "kind", "text", "page", "rows", "island", "section", "seen")


def titles(blocks: DataFrame, key: str) -> DataFrame:
    """(key, title): the first heading, else the key."""
    first = F.min_by(F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("island")))
    return blocks.groupBy(key).agg(F.coalesce(first, F.col(key).cast("string")).alias("title"))


def line_titles(lines: DataFrame, key: str) -> DataFrame:
    """``titles`` of the blocks of classified lines, which it doesn't make: a heading is a line of its own, so each task
    keeps a document's first one, and no text but that is shuffled. Columns come before the groups, as whole lines
    would be sorted by document otherwise."""
    kind = F.col("kind")
    solid = ~kind.isin("blank", "navigation") & ((kind != "table") | ~T.is_separator(T.cells(F.col("line"))))
    head = F.when(kind == "heading", F.struct("page", "line_no", T.heading(F.col("s")).alias("text")))
    rows = lines.select(key, "page", "line_no", solid.alias("solid"), head.alias("head")).where(F.col(key).isNotNull() & F.col("page").isNotNull() & F.col("line_no").isNotNull())
    own = rows.groupBy(key).agg(F.min("head").alias("first"), F.bool_or("solid").alias("any"))
    return own.where("any").select(key, F.coalesce(F.col("first")["text"], F.col(key).cast("string")).alias("title"))


def edge_lines(lines: DataFrame, document: str) -> DataFrame:
    """The first non-blank line of each page and, if there are more, the last: (document, page, line_no, edge, form)."""
    solid = lines.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    by_page = solid.groupBy(document, "page").agg(F.min_by("s", "line_no").alias("head"), F.max_by("s", "line_no").alias("foot"), F.min("line_no").alias("h"), F.max("line_no").alias("f"))
    both = F.array(F.struct(F.lit("header").alias("edge"), F.col("head").alias("s"), F.col("h").alias("line_no")), F.struct(F.lit("footer").alias("edge"), F.col("foot").alias("s"), F.col("f").alias("line_no")))
    got = by_page.select(document, "page", "h", "f", F.explode(both).alias("x")).where("x.edge = 'header' or f > h")
    return got.select(document, "page", F.col("x.line_no").alias("line_no"), F.col("x.edge").alias("edge"), T.normalized(F.col("x.s")).alias("form"))


def running_forms(lines: DataFrame, document: str) -> DataFrame:
    """(document, form): forms that stand first or last on at least max(4, pages / 10) pages."""
    edges = edge_lines(lines, document)
    pages = lines.groupBy(document).agg(F.count_distinct("page").alias("pages"))
    counted = edges.groupBy(document, "edge", "form").agg(F.count("*").alias("n")).join(pages, document)
    return counted.where(F.col("n") >= F.greatest(F.lit(4), F.floor(F.col("pages") / 10))).select(document, "form").distinct()


def drop_running(lines: DataFrame, document: str) -> DataFrame:
    """The lines without first and last ones of a running form."""
    bad = edge_lines(lines, document).join(running_forms(lines, document), [document, "form"]).select(document, "page", "line_no").distinct()
    return lines.join(bad, [document, "page", "line_no"], "left_anti")
