"""Text as blocks: headings, lists, pipe tables, breaks and paragraphs of a document's canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import lines


def kind_of(content: Column) -> Column:
    return (
        F.when(F.trim(content) == "", "blank").when(content.rlike(r"^#{1,6} "), "heading").when(content.rlike(r"^---\s*\z"), "break").when(content.rlike(r"^\s*(?:[-*+]|\d+[.)]) "), "item")
        .when(content.rlike(r"^\|.*\|\s*\z"), "row").otherwise("para")
    )


def blocks(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, block, kind, first, last, content): lines of a kind that follow one another form a block, but headings,
    breaks and items each are one. Line by line with windows within a document, in no Python."""
    up = Window.partitionBy(by).orderBy("line")
    rows = lines(docs, by, text).withColumn("kind", kind_of(F.col("content")))
    new = F.coalesce((F.lag("kind").over(up) != F.col("kind")) | F.col("kind").isin("heading", "break", "item"), F.lit(True))
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(up)).filter("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy(by, "block", "kind").agg(F.min("line").alias("first"), F.max("line").alias("last"), body.alias("content"))


def pipe_cells(row: Column) -> Column:
    """The cells of a pipe row; \\| is a bar of the text."""
    body = F.regexp_replace(F.regexp_replace(F.trim(row), r"^\|", ""), r"(?<!\\)\|\z", "")
    return F.transform(F.split(body, r"(?<!\\)\|", -1), lambda c: F.regexp_replace(F.trim(c), r"\\\|", "|"))


def table_cells(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, block, row, col, content, owner): cells of pipe tables; ^^ belongs to the cell above, whose row is owner."""
    tables = rows.filter("kind = 'row'").select(by, "block", F.posexplode(F.split("content", "\n")).alias("row", "line"))
    cells = tables.select(by, "block", "row", F.posexplode(pipe_cells(F.col("line"))).alias("col", "content"))
    up = Window.partitionBy(by, "block", "col").orderBy("row")
    return cells.withColumn("owner", F.last(F.when(F.col("content") != "^^", F.col("row")), ignorenulls=True).over(up))


def list_levels(rows: DataFrame) -> DataFrame:
    """Items with level (two spaces each), whether numbered, and their text."""
    items = rows.filter("kind = 'item'")
    return items.select("*", (F.floor(F.length(F.regexp_extract("content", r"^(\s*)", 1)) / 2)).cast("int").alias("level"), F.col("content").rlike(r"^\s*\d").alias("numbered"), F.regexp_replace("content", r"^\s*(?:[-*+]|\d+[.)]) ", "").alias("item"))
