"""Windows over texts and tables, and runs of equal cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a reading, and rows of a table window, at most.
MAX_BYTES, MAX_ROWS = 60_000, 500


class WindowError(ValueError):
    """A window that isn't there."""


def lines(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, line, content): a text's lines from 1. A line end at the very end starts no line of its own."""
    return docs.select(by, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", ""), "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def line_window(docs: DataFrame, first: int, last: int, by: str = "doc_id", text: str = "text") -> DataFrame:
    if not 1 <= first <= last:
        raise WindowError(f"lines {first}:{last}")
    return lines(docs, by, text).filter(F.col("line").between(first, last))


def headings(rows: DataFrame) -> DataFrame:
    """The rows of lines() that are headings of level 1 to 6, with level and title."""
    level = F.length(F.regexp_extract("content", r"^(#{1,6}) ", 1))
    return rows.withColumn("level", level).filter("level > 0").withColumn("title", F.trim(F.regexp_replace("content", r"^#{1,6} ", "")))


def sections(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Headings with end: the line before the next heading of the same or a higher level, or the text's last line.

    The next such heading is the least of the next lines of each level up to its own, so no pairs are made.
    """
    heads = headings(rows)
    last = rows.groupBy(by).agg(F.max("line").alias("last_"))
    down = Window.partitionBy(by).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.first(F.when(F.col("level") <= k, F.col("line")), ignorenulls=True).over(down).alias(f"n{k}") for k in range(1, 7)]
    own = F.coalesce(*[F.when(F.col("level") == k, F.col(f"n{k}")) for k in range(1, 7)])
    return heads.select("*", *nexts).join(last, by).withColumn("end", F.coalesce(own - 1, F.col("last_"))).drop("last_", *[f"n{k}" for k in range(1, 7)])


def section_window(docs: DataFrame, title: str, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, line, content) of the section with that heading; documents where it stands twice have one row with line 0
    and content 'ambiguous'."""
    rows = lines(docs, by, text)
    found = sections(rows, by).filter(F.col("title") == title).groupBy(by).agg(F.count("*").alias("n"), F.min("line").alias("from_"), F.min("end").alias("to_"))
    twice = found.filter("n > 1").select(by, F.lit(0).alias("line"), F.lit("ambiguous").alias("content"))
    return rows.join(found.filter("n = 1"), by).filter("line between from_ and to_").select(by, "line", "content").unionByName(twice)


def slides(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """lines() with slide: how many lines --- stand above, from 1; the separators themselves go."""
    up = Window.partitionBy(by).orderBy("line")
    rows = lines(docs, by, text).withColumn("sep_", (F.trim("content") == "---").cast("int"))
    return rows.withColumn("slide", F.sum("sep_").over(up) + 1).filter("sep_ = 0").drop("sep_")


def clip(docs: DataFrame, limit: int = MAX_BYTES, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, last_line, next_line): lines that fit into limit bytes, the line ends included; where they don't all fit
    the cut is after the last blank line of the last quarter, if there is one. next_line is null if all fit."""
    up = Window.partitionBy(by).orderBy("line")
    rows = lines(docs, by, text).withColumn("used_", F.sum(F.octet_length("content") + 1).over(up))
    over = rows.groupBy(by).agg(F.min(F.when(F.col("used_") > limit, F.col("line"))).alias("over_"), F.max("line").alias("last_"))
    blank = F.max(F.when((F.trim("content") == "") & (F.col("line") < F.col("over_")) & (F.col("line") - 1 >= F.floor((F.col("over_") - 1) * 3 / 4)), F.col("line")))
    cut = rows.join(over, by).groupBy(by, "over_", "last_").agg(blank.alias("blank_"))
    last = F.when(F.col("over_").isNull(), F.col("last_")).otherwise(F.coalesce("blank_", F.greatest(F.col("over_") - 1, F.lit(1))))
    return cut.select(by, last.alias("last_line"), F.when(last < F.col("last_"), last + 1).alias("next_line"))


def outline(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    return headings(lines(docs, by, text)).select(by, "line", "level", "title")


def row_window(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows by position, blank ones too; over MAX_ROWS or none is an error."""
    if not 1 <= first <= last or last - first + 1 > MAX_ROWS:
        raise WindowError(f"rows {first}:{last}")
    want = df.sparkSession.range(first, last + 1).withColumnRenamed("id", "pos")
    return F.broadcast(want).join(df.filter(F.col("pos").between(first, last)), "pos", "left")


def pipe_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, content): | a | b | with escapes."""
    from tessera.functions.values import escape_cell

    return df.select("pos", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(escape_cell(F.col(c).cast("string")), F.lit("")) for c in columns]), F.lit(" |")).alias("content"))


#: Positions that one task numbers at once where a value may stand anywhere in a table.
BLOCK = 1 << 16


def islands(df: DataFrame, by: Sequence[str], pos: str, value: Sequence[str], block: int | None = None) -> DataFrame:
    """(by, value, first, last): runs of consecutive positions with equal values. With block, rows are numbered within so
    many positions, from how many stand before them, so that a value of many rows is many tasks."""
    keys = [*by, *value]
    if block is None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    else:
        df = df.withColumn("block_", F.floor(F.col(pos) / block))
        before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
        counts = df.groupBy(*keys, "block_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(before, F.lit(0))).drop("n_")
        counts = counts.withColumnsRenamed({c: f"k{i}_" for i, c in enumerate([*keys, "block_"])})
        on = [F.col(c).eqNullSafe(F.col(f"k{i}_")) for i, c in enumerate([*keys, "block_"])]
        df = df.join(counts, on, "left").select(*df.columns, "before_")
        rank = F.row_number().over(Window.partitionBy(*keys, "block_").orderBy(pos)) + F.col("before_")
    return df.withColumn("run_", F.col(pos) - rank).groupBy(*keys, "run_").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("run_")


def inverted_index(df: DataFrame, column: str, by: Sequence[str] = (), pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """(by, column, rows): each value with its row ranges as a:b, c, ... Ranges are joined by blocks, then blocks in order."""
    runs = islands(df.select(*by, column, pos), by, pos, [column], block)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws(":", "first", "last"))
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "t"))), lambda x: x["t"]), ", ")
    parts = runs.select(*by, column, F.floor(F.col("first") / block).alias("block_"), "first", "last", text.alias("t")).groupBy(*by, column, "block_").agg(joined("first", "last").alias("t"))
    return parts.groupBy(*by, column).agg(joined("block_").alias("rows"))


def rectangles(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """cells (by, row, col, value) -> (by, c0, r0, c1, r1, value): runs along rows, then equal runs of consecutive rows."""
    runs = islands(cells, [*by, "row"], "col", ["value"]).withColumnsRenamed({"first": "c0", "last": "c1"})
    return islands(runs, [*by, "c0", "c1"], "row", ["value"]).withColumnsRenamed({"first": "r0", "last": "r1"})


def merged_spans(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first, last): spans that overlap or touch as one, by a running maximum."""
    before = Window.partitionBy(*by).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("first", "last")
    new = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int")
    return spans.withColumn("new_", new).withColumn("run_", F.sum("new_").over(order)).groupBy(*by, "run_").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run_")


def priorities(rules: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rules.withColumn("priority", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
