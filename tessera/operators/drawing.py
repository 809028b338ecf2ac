"""Objects on slides and sheets: nested frames, connectors, inherited properties, slide order, style records; surveys and scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import overlay
from tessera.sources.shared import stored

# A table's categories, the first that fits counts.
CATEGORIES = ("nested", "row-cc", "grid", "other", "multipara", "merged", "plain")
#: Connection sites of a box, by index: the middle of its top, left, bottom and right side.
SITES = ((0.5, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 0.5))


def frames(shapes: DataFrame, by: Sequence[str] = ("doc_id", "slide")) -> DataFrame:
    """shapes (by, id, parent: null at the top, x, y, w, h, cx, cy, cw, ch: a group's own frame for what it holds) -> (by, id,
    depth, x, y, w, h) on the slide. One join a level of nesting; a shape in a circle of groups or in none has no place."""
    base = [*by, "id", "x", "y", "w", "h", "cx", "cy", "cw", "ch"]
    front = stored(shapes.filter("parent is null").select(*base, F.lit(0).alias("depth")), "frames")
    out = front
    while not front.isEmpty():
        up = front.select(*by, F.col("id").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "w", "h", "cx", "cy", "cw", "ch")], "depth")
        both = shapes.join(up, [*by, "parent"])
        sx, sy = (F.coalesce(F.try_divide(F.col(f"p_{a}"), F.col(f"p_c{a}")), F.lit(1.0)) for a in ("w", "h"))
        placed = [(F.col("p_x") + (F.col("x") - F.col("p_cx")) * sx).alias("x"), (F.col("p_y") + (F.col("y") - F.col("p_cy")) * sy).alias("y"), (F.col("w") * sx).alias("w"), (F.col("h") * sy).alias("h")]
        front = stored(both.select(*by, "id", *placed, "cx", "cy", "cw", "ch", (F.col("depth") + 1).alias("depth")), "frames")
        out = out.unionByName(front)
    return out.select(*by, "id", "depth", "x", "y", "w", "h")


def snapped(place: Column, grid: int) -> Column:
    """The nearest line of a grid, the higher of two as near."""
    return F.floor((place + F.lit(grid / 2)) / grid) * grid


def resized(box: Column, w: Column, h: Column) -> Column:
    """A box struct<x, y, w, h> at another size about its own centre."""
    return F.struct((box["x"] + (box["w"] - w) / 2).alias("x"), (box["y"] + (box["h"] - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def connector_ends(ends: DataFrame, placed: DataFrame, by: Sequence[str] = ("doc_id", "slide")) -> DataFrame:
    """ends (by, line, which, target, site), placed (by, id, x, y, w, h) -> (by, line, which, x, y, error): the point of the
    object's site; no such object, or no such site, is an error."""
    boxes = placed.select(*by, F.col("id").alias("target"), "x", "y", "w", "h", F.lit(True).alias("there_"))
    sites = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SITES])
    at = F.get(sites, F.when(F.col("site").between(0, len(SITES) - 1), F.col("site")))
    both = ends.join(boxes, [*by, "target"], "left")
    error = F.when(F.col("there_").isNull(), "no object").when(at.isNull(), "no site")
    return both.select(*by, "line", "which", (F.col("x") + F.col("w") * at["a"]).alias("px"), (F.col("y") + F.col("h") * at["b"]).alias("py"), error.alias("error"))


def inherited(shapes: DataFrame, layouts: DataFrame, masters: DataFrame) -> DataFrame:
    """shapes (..., layout, type, idx, props), layouts (layout, master, type, idx, props), masters (master, type, props) ->
    shapes with props as they show: a shape's own, else its layout slot's, else those of the master's slot of that type."""
    slot = layouts.groupBy("layout", "type", "idx").agg(F.first("master").alias("m_"), F.first("props").alias("l_"))
    top = masters.groupBy(F.col("master").alias("m_"), "type").agg(F.first("props").alias("t_"))
    home = layouts.groupBy("layout").agg(F.first("master").alias("h_"))
    empty = F.create_map().cast("map<string,string>")
    both = shapes.join(slot, ["layout", "type", "idx"], "left").join(home, "layout", "left").withColumn("m_", F.coalesce("m_", "h_")).join(top, ["m_", "type"], "left")
    whole = overlay(overlay(F.coalesce("t_", empty), F.coalesce("l_", empty)), F.coalesce("props", empty))
    return both.withColumn("props", whole).select(*shapes.columns)


def reordered(slides: DataFrame, moves: DataFrame, links: DataFrame, by: str = "doc_id") -> DataFrame:
    """slides (by, id, pos from 1), moves (by, op: add, delete or move; id, to) with one move for each of a deck's slides at most,
    links (by, target) -> (by, id, pos, error). What goes goes first; then moved and added slides take the places they name
    (those that stay keep their order); a deleted slide that a link refers to stays, with an error."""
    held = links.select(by, F.col("target").alias("id")).distinct().withColumn("held_", F.lit(True))
    own = slides.join(moves.select(by, "id", "op", "to"), [by, "id"], "full_outer").join(held, [by, "id"], "left")
    refused = (F.col("op") == "delete") & F.col("held_").isNotNull()
    stays = own.filter(~F.coalesce((F.col("op") == "delete") & F.col("held_").isNull(), F.lit(False)))
    stays = stays.withColumn("error", F.when(refused, "a link refers to it").when((F.col("op") == "move") & F.col("pos").isNull(), "no such slide"))
    named = F.col("op").isin("add", "move") & F.col("error").isNull()
    stays = stays.filter("pos is not null or op = 'add'").withColumn("to_", F.when(named, F.col("to")))
    # places that nobody names are dealt to the rest in their order
    n = F.count("*").over(Window.partitionBy(by))
    rest = stays.withColumn("n_", n).withColumn("k_", F.row_number().over(Window.partitionBy(by, F.col("to_").isNull()).orderBy("pos", "id")))
    taken = rest.filter("to_ is not null").groupBy(by).agg(F.collect_set("to_").alias("taken_"))
    free = F.filter(F.sequence(F.lit(1), F.col("n_").cast("int")), lambda p: ~F.array_contains(F.coalesce("taken_", F.array().cast("array<int>")), p))
    both = rest.join(taken, by, "left")
    return both.select(by, "id", F.when(F.col("to_").isNotNull(), F.col("to_")).otherwise(F.get(free, F.col("k_") - 1)).alias("pos"), "error")


def style_records(cells: DataFrame, style: str = "style") -> tuple[DataFrame, DataFrame]:
    """cells with style_id, and (style_id, key): one record for each different style, from 0 in order of its text. Equal
    records are one, by a partial aggregate; a workbook has 64,000 of them at most, so their numbering is one small task."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(style)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    own = cells.withColumn("key_", F.coalesce(text, F.lit("")))
    records = own.groupBy("key_").count().withColumn("style_id", (F.row_number().over(Window.orderBy("key_")) - 1).cast("int")).select("style_id", F.col("key_").alias("key"))
    return own.join(records.withColumnRenamed("key", "key_"), "key_").drop("key_"), records


def series_shifted(series: DataFrame, sheet: str, cols: tuple[int, int], at: int, n: int) -> DataFrame:
    """series (chart, seq, formula: a reference with its sheet) with the formulas after n rows come in (or -n go)."""
    from tessera.functions.lazy import arrow_udf
    from tessera.functions.refs import shifted

    @arrow_udf("string")
    def moved(f: pd.Series) -> pd.Series:
        return f.map(lambda x: None if x is None else shifted(x, False, sheet, cols, at, n))

    return series.withColumn("formula", moved("formula"))


def objects_of(anchors: DataFrame, by: str = "sheet") -> DataFrame:
    """anchors (by, id, kind, c0, r0, c1, r1, name) -> (by, ord, id, kind, name, anchor): objects in reading order."""
    from tessera.functions.a1 import print_range

    order = F.row_number().over(Window.partitionBy(by).orderBy("r0", "c0", "id"))
    return anchors.select(by, order.alias("ord"), "id", "kind", "name", print_range(F.struct("c0", "r0", "c1", "r1")).alias("anchor"))


def category(flags: Column) -> Column:
    """The first category that one of a table's flags names (a flag may say more after a colon); plain without any."""
    names = F.transform(flags, lambda f: F.split_part(f, F.lit(":"), F.lit(1)))
    return F.coalesce(*[F.when(F.array_contains(names, c), F.lit(c)) for c in CATEGORIES], F.lit("plain"))


def table_survey(tables: DataFrame, by: str = "corpus", doc: str = "doc_id") -> DataFrame:
    """tables (by, doc, flags: array) -> (by or * for all, category, tables, docs, share): tables by their category, documents
    with one such table at least, and the share of tables, one aggregate over grouping sets."""
    rows = tables.select(by, doc, category(F.col("flags")).alias("category"))
    n = rows.groupingSets([[by, "category"], ["category"]], by, "category").agg(F.count("*").alias("tables"), F.count_distinct(doc).alias("docs"), F.grouping(by).alias("g_"))
    n = n.select(F.when(F.col("g_") == 1, "*").otherwise(F.col(by)).alias(by), "category", "tables", "docs")
    return n.withColumn("share", F.col("tables") / F.sum("tables").over(Window.partitionBy(by)))


def mean_of(parts: Sequence[Column]) -> Column:
    """The geometric mean of those that aren't null; 0 if one is 0 or less."""
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    logs = F.aggregate(F.transform(there, lambda x: F.log(x)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(there) == 0, None).when(F.array_min(there) <= 0, 0.0).otherwise(F.exp(logs / F.size(there)))


def layout_scores(words: DataFrame, glyphs: DataFrame, by: str = "file") -> DataFrame:
    """words (by, matched, same_page, starts, starts_there, off: a word's offset as a share of the page's diagonal), glyphs
    (by, native, rendered, matched) -> (by, t, p, l, w, layout): glyphs in both, words on their page, lines that start with the
    same word, and how near words are (2 % of the diagonal is far), with the geometric mean of the four."""
    m = F.col("matched")
    both, one, other = (F.count_if(m & c) for c in (F.col("starts") & F.col("starts_there"), F.col("starts") & ~F.col("starts_there"), ~F.col("starts") & F.col("starts_there")))
    near = F.avg(F.when(m & F.col("same_page"), 1 - F.least(F.lit(1.0), F.col("off") / 0.02)))
    w = words.groupBy(by).agg(F.try_divide(F.count_if(m & F.col("same_page")), F.count_if(m)).alias("p"), F.try_divide(2 * both, 2 * both + one + other).alias("l"), near.alias("w"))
    g = glyphs.select(by, F.try_divide(2 * F.col("matched"), F.col("native") + F.col("rendered")).alias("t"), (F.col("native") > 0).alias("some"))
    zero = lambda c: F.coalesce(F.col(c), F.when(F.col("some"), 0.0)).alias(c)
    rows = g.join(w, by, "left").select(by, "t", zero("p"), zero("l"), zero("w"), "some")
    return rows.select(by, "t", "p", "l", "w", F.when(F.col("some"), mean_of([F.col(c) for c in ("t", "p", "l", "w")])).alias("layout"))

