"""Text as models and back: canonical documents, tags, styles lifted to where they are shared, structures, slides, looks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import units
from tessera.functions.a1 import parse_range
from tessera.functions.once import once
from tessera.operators.blocks import blocks, pipe_cells
from tessera.operators.windows import lines

# The tags of documents and slides, an object's look, its effects and arrowheads, and a text's keys.
TAGS = ("keep", "bkeep", "comment", "ins", "del", "math", "u", "br", "sheet", "table", "data", "merge", "shape", "line", "picture", "group", "slot", "layout")
LOOK = ("kind", "adj", "fill", "border", "start", "end", "effects")
EFFECTS = ("shadow", "inner-shadow", "glow", "soft-edges", "reflection", "blur", "fill-overlay", "custom")
ARROWS = ("triangle", "stealth", "diamond", "oval", "arrow")
TEXT_KEYS = ("font", "size", "color")


def canonical_block(kind: Column, content: Column) -> Column:
    """A block's canonical lines: no spaces at line ends, one space after marks, pipe rows with single spaces."""
    trimmed = F.regexp_replace(content, r"[ \t]+(?=\n|\z)", "")
    cell = lambda c: F.regexp_replace(c, r"\|", r"\\|")
    rows = F.array_join(F.transform(F.split(trimmed, "\n"), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(pipe_cells(r), cell), " | "), F.lit(" |"))), "\n")
    item = F.concat(F.regexp_extract(trimmed, r"^(\s*)", 1), F.when(trimmed.rlike(r"^\s*\d"), F.regexp_extract(trimmed, r"^\s*(\d+)[.)]", 1)).otherwise(""), F.when(trimmed.rlike(r"^\s*\d"), ". ").otherwise("- "), F.regexp_replace(trimmed, r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    return F.when(kind == "heading", F.regexp_replace(trimmed, r"^(#{1,6})\s+", "$1 ")).when(kind == "item", item).when(kind == "row", rows).when(kind == "break", "---").otherwise(trimmed)


def serialized(parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """blocks() back as (by, text): blocks apart by a blank line, items of a list by a line end, one line end at the end."""
    before = F.lag("kind").over(Window.partitionBy(by).orderBy("block"))
    gap = F.when(before.isNull(), "").when((before == "item") & (F.col("kind") == "item"), "\n").otherwise("\n\n")
    rows = parts.select(by, "block", F.concat(gap, canonical_block(F.col("kind"), F.col("content"))).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(by).agg(F.concat(joined, F.lit("\n")).alias("text"))


def canonical(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, text): each document in its canonical form, which is its own. Documents without blocks are empty."""
    out = serialized(blocks(docs, by, text), by)
    return docs.select(by).join(out, by, "left").withColumn("text", F.coalesce("text", F.lit("")))


def attr_map(text: Column) -> Column:
    """A tag's attributes as a map; of a repeated key the first counts. Empty for what isn't attributes."""
    pairs = F.coalesce(units.attributes(text), F.array().cast("array<struct<key:string,value:string>>"))

    def first(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["key"])
        return F.map_from_entries(F.filter(p, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    return once(pairs, first)


def tags(docs: DataFrame, by: str = "doc_id", text: str = "text", names: Sequence[str] = TAGS) -> DataFrame:
    """(by, line, seq, name, form, attrs: map): the tags of a closed set, form open, close or empty. Other text in angle
    brackets is text."""
    shape = rf"<(/?)({'|'.join(names)})((?:\s+[A-Za-z-]+=\"[^\"<]*\")*)\s*(/?)>"
    found = lines(docs, by, text).select(by, "line", F.posexplode(F.regexp_extract_all("content", F.lit(f"({shape})"), F.lit(1))).alias("seq", "tag"))
    part = lambda k: F.regexp_extract("tag", shape, k)
    form = F.when(part(1) == "/", "close").when(part(4) == "/", "empty").otherwise("open")
    return found.select(by, "line", "seq", part(2).alias("name"), form.alias("form"), attr_map(part(3)).alias("attrs"))


def shared(rows: DataFrame, by: Sequence[str], style: str = "style") -> DataFrame:
    """(by, key, value): properties that all rows of a group have, with one value. A partial aggregate by key, no lists."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n_"))
    keys = rows.select(*by, F.explode(style).alias("key", "value"))
    each = keys.groupBy(*by, "key").agg(F.count("*").alias("m_"), F.min("value").alias("value"), F.max("value").alias("top_"))
    return each.join(n, [*by]).filter("m_ = n_ and value = top_").select(*by, "key", "value")


def lifted(cells: DataFrame, by: str = "doc_id") -> DataFrame:
    """cells (by, row, col, style: map) -> (by, level, row, col, key, value): each property at the highest of table, row and
    cell whose cells all share it (row and col null above them). spread() gives the cells back.

    A row's cells, which a sheet bounds, are one list; tables are partial aggregates of rows by key. Styles aren't shuffled key by key.
    """
    kinds = cells.schema
    value = kinds["style"].dataType.valueType.simpleString()
    entries = F.coalesce(F.map_entries("style"), F.array().cast(f"array<struct<key:{kinds['style'].dataType.keyType.simpleString()},value:{value}>>"))
    packed = cells.groupBy(by, "row").agg(F.collect_list(F.struct("col", entries.alias("e"))).alias("cells_"))

    def counted(pairs: Column) -> Column:
        def of(key: Column) -> Column:
            values = F.transform(F.filter(pairs, lambda x: x["key"] == key), lambda x: x["value"])
            return once(values, lambda v: F.struct(key.alias("key"), F.size(v).cast("long").alias("m"), F.array_min(v).alias("low"), F.array_max(v).alias("top")))

        return F.transform(F.array_distinct(F.transform(pairs, lambda x: x["key"])), of)

    rows = packed.withColumn("n_", F.size("cells_").cast("long")).withColumn("keys_", once(F.flatten(F.transform("cells_", lambda c: c["e"])), counted))
    one = F.struct(F.lit(None).alias("key"), F.col("n_").alias("m"), F.lit(None).alias("low"), F.lit(None).alias("top"))
    keys = rows.select(by, "row", F.explode(F.concat("keys_", F.array(one))).alias("k")).groupBy(by, "k.key").agg(F.sum("k.m").alias("m"), F.min("k.low").alias("low"), F.max("k.top").alias("top"), F.min(F.struct("row")).alias("row"))
    own = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "m", "low", "top")))
    whole = keys.groupBy(by).agg(F.max(F.when(F.col("key").isNull(), F.col("m"))).alias("all_"), F.min("row").alias("first_"), own.alias("own_"))
    alike = lambda own, n: F.transform(F.filter(own, lambda k: (k["m"] == n) & (k["low"] == k["top"])), lambda k: F.struct(k["key"].alias("key"), k["low"].alias("value")))
    whole = whole.select(by, "first_", alike(F.col("own_"), F.col("all_")).alias("table_"))
    none = F.expr("filter(array(struct(get(keys_, 0).key as key, get(keys_, 0).low as value)), x -> false)")
    both = rows.join(whole, by, "left").withColumn("table_", F.coalesce("table_", none))
    shares = F.when(F.col(by).isNotNull() & F.col("row").isNotNull(), alike(F.col("keys_"), F.col("n_"))).otherwise(none)
    both = both.withColumn("above_", F.transform("table_", lambda x: x["key"])).withColumn("row_", F.filter(shares, lambda x: ~F.array_contains(F.col("above_"), x["key"])))
    above = F.concat("above_", F.transform("row_", lambda x: x["key"]))
    out = lambda level, row, col, x: F.struct(F.lit(level).alias("level"), row.cast(kinds["row"].dataType).alias("row"), col.cast(kinds["col"].dataType).alias("col"), x["key"].alias("key"), x["value"].alias("value"))
    null = F.lit(None)
    top = F.transform(F.when(F.col("row").eqNullSafe(F.col("first_.row")) & F.col("first_").isNotNull(), F.col("table_")).otherwise(none), lambda x: out("table", null, null, x))
    middle = F.transform("row_", lambda x: out("row", F.col("row"), null, x))
    cell = once(above, lambda a: F.flatten(F.transform("cells_", lambda c: F.transform(F.filter(c["e"], lambda x: ~F.array_contains(a, x["key"])), lambda x: out("cell", F.col("row"), c["col"], x)))))
    return both.select(by, F.explode(F.concat(top, middle, cell)).alias("x")).select(by, "x.*")


def spread_maps(lifted_: DataFrame, places: DataFrame, by: str = "doc_id") -> DataFrame:
    """lifted() back as (by, row, col, style: map) on places (by, row, col): a cell's own value, else its row's, else the
    table's. Rows are packed before they meet and opened only where they lie then; places without any property go."""
    kind = lambda x: F.collect_list(F.when(F.col("level") == x, F.struct("col", F.lit(("cell", "row", "table").index(x)).alias("rank"), "key", "value")))
    own = lifted_.filter("level <> 'table'").groupBy(by, "row").agg(kind("cell").alias("cells_"), kind("row").alias("row_"))
    table = lifted_.filter("level = 'table'").groupBy(by).agg(kind("table").alias("table_"))
    at = places.groupBy(by, "row").agg(F.collect_set(F.struct("col")).alias("cols_"))
    both = at.join(own, [by, "row"], "left").join(table, by, "left")
    none = F.expr("filter(coalesce(cells_, row_, table_), x -> false)")
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["rank"].alias("rank"), x["key"].alias("key"), x["value"].alias("value")))
    both = both.filter("coalesce(cells_, row_, table_) is not null").withColumn("base_", bare(F.concat(F.coalesce("row_", none), F.coalesce("table_", none))))
    there = F.transform("cols_", lambda c: F.struct(c["col"].alias("col"), F.lit(True).alias("there"), F.col("base_").alias("e")))
    set_ = F.transform(F.coalesce("cells_", none), lambda x: F.struct(x["col"].alias("col"), F.lit(False).alias("there"), bare(F.array(x)).alias("e")))
    # a null place has no cell's own value: nulls don't meet
    rows = both.select(by, "row", F.explode(F.concat(there, F.filter(set_, lambda x: x["col"].isNotNull()))).alias("x"))
    cells = rows.groupBy(by, "row", F.col("x.col").alias("col")).agg(F.bool_or("x.there").alias("there_"), F.flatten(F.collect_list("x.e")).alias("e_"))
    first = lambda e: F.transform(F.array_distinct(F.transform(e, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.array_min(F.transform(F.filter(e, lambda x: x["key"] == k), lambda x: F.struct(x["rank"].alias("rank"), x["value"].alias("value"))))["value"].alias("value")))
    return cells.filter(F.col("there_") & (F.size("e_") > 0)).select(by, "row", "col", F.map_from_entries(once(F.col("e_"), first)).alias("style"))


def spread(lifted_: DataFrame, places: DataFrame, by: str = "doc_id") -> DataFrame:
    """spread_maps() as (by, row, col, key, value)."""
    return spread_maps(lifted_, places, by).select(by, "row", "col", F.explode("style").alias("key", "value"))


def folded(spans: DataFrame, by: Sequence[str], keys: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """spans (by, ..., keys) -> (by, keys): each text property that all of an object's text shares, for its tag; else null."""
    same = [F.when((F.count(k) == F.count("*")) & (F.min(k) == F.max(k)), F.min(k)).alias(k) for k in keys]
    return spans.groupBy(*by).agg(*same)


def against_default(styles: DataFrame, by: str = "doc_id") -> DataFrame:
    """styles (by, name, props: map, is_default) -> (by, name, key, value): the default style's line is complete, any other
    holds what differs from it; a property that the default has and a style lacks is none."""
    base = styles.filter("is_default").select(by, F.explode("props").alias("key", "b_"))
    named = styles.filter(~F.col("is_default"))
    own = named.select(by, "name", F.explode("props").alias("key", "value"))
    want = named.select(by, "name").join(base, by)
    both = want.join(own, [by, "name", "key"], "full_outer")
    differs = both.withColumn("value", F.coalesce("value", F.lit("none"))).filter(~F.col("value").eqNullSafe(F.coalesce("b_", F.lit("none"))))
    whole = styles.filter("is_default").select(by, "name", F.explode("props").alias("key", "value"))
    return whole.unionByName(differs.select(by, "name", "key", "value"))


def resolved(blocks_: DataFrame, styles: DataFrame, by: str = "doc_id") -> DataFrame:
    """blocks (by, block, style, level, keys: array), styles (by, id, name, level, can: array) -> (by, block, style_id, error):
    a name's style, in any case; without a name that of the heading's level, else the document's first of level 0. Errors: an
    unknown name, no style of a level, and keys that the style can't hold (the first one)."""
    named = styles.groupBy(by, F.lower("name").alias("k_")).agg(F.min_by(F.struct("id", "can"), "id").alias("a_"))
    levelled = styles.groupBy(by, F.coalesce("level", F.lit(0)).alias("l_")).agg(F.min_by(F.struct("id", "can"), "id").alias("b_"))
    both = blocks_.withColumn("k_", F.lower("style")).withColumn("l_", F.coalesce("level", F.lit(0))).join(named, [by, "k_"], "left").join(levelled, [by, "l_"], "left")
    got = F.when(F.col("style").isNotNull(), F.col("a_")).otherwise(F.col("b_"))
    cannot = F.get(F.array_sort(F.array_except("keys", got["can"])), 0)
    error = F.when(got.isNull(), F.when(F.col("style").isNotNull(), F.concat(F.lit("unknown style "), F.col("style"))).otherwise(F.concat(F.lit("no style of level "), F.col("l_").cast("string")))).when(cannot.isNotNull(), F.concat(F.lit("can't hold "), cannot))
    return both.select(by, "block", got["id"].alias("style_id"), error.alias("error"))


def parsed_structure(rows: DataFrame, by: str = "book") -> DataFrame:
    """rows (by, line, content), a structure's lines -> (by, sheet, name, r: range, ord, column, type, format, formula), a row
    for each column of each table. The sheet and table of a line are those opened last above it."""
    up = Window.partitionBy(by).orderBy("line")
    mark = lambda tag, key: F.when(F.col("content").startswith(f"<{tag} "), F.try_element_at(attr_map(F.regexp_extract("content", rf"^<{tag} (.*)>$", 1)), F.lit(key)))
    held = rows
    for name, tag, key in (("sheet", "sheet", "name"), ("name", "table", "name"), ("box", "table", "range")):
        held = held.withColumn(name, F.last(mark(tag, key), ignorenulls=True).over(up))
    inside = F.sum(F.when(F.col("content").startswith("<table "), 1).when(F.col("content") == "</table>", -1).otherwise(0)).over(up)
    since = F.max(F.when(F.col("content").startswith("<table "), F.col("line"))).over(up)
    body = held.withColumn("in_", inside).withColumn("ord", (F.col("line") - since - 3).cast("int")).filter("in_ = 1 and ord >= 0")
    cells = pipe_cells(F.col("content"))
    field = lambda k, name: F.nullif(F.get(cells, F.lit(k)), F.lit("")).alias(name)
    return body.select(by, "sheet", "name", parse_range(F.col("box")).alias("r"), "ord", field(0, "column"), field(1, "type"), field(2, "format"), field(3, "formula"))


def presentation(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, slide, ord, kind, attrs, text): a slide's head (its first # line), its objects (one tag a line: shape, line,
    picture, group, slot) with the paragraphs after each as its text, and paragraphs that belong to none (kind body)."""
    from tessera.operators.views import slide_window

    rows = slide_window(docs, 1, 1 << 30, by, text)
    shape = r"^<(shape|line|picture|group|slot)((?:\s+[A-Za-z-]+=\"[^\"<]*\")*)\s*/?>\s*\z"
    tag = F.regexp_extract("content", shape, 1)
    up = Window.partitionBy(by, "slide").orderBy("line")
    rows = rows.filter(F.trim("content") != "").withColumn("tag", tag).withColumn("head", (F.col("content").startswith("# ")).cast("int"))
    rows = rows.withColumn("first", F.sum("head").over(up)).withColumn("head", (F.col("head") == 1) & (F.col("first") == 1))
    new = F.col("head") | (F.col("tag") != "") | F.coalesce(F.lag("head").over(up), F.lit(True))
    rows = rows.withColumn("ord", F.sum(new.cast("int")).over(up))
    paras = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "", F.struct("line", F.regexp_replace("content", r"^# ", "").alias("c"))))), lambda x: x["c"]), "\n")
    kind = F.when(F.bool_or("head"), "head").otherwise(F.coalesce(F.max(F.nullif(F.col("tag"), F.lit(""))), F.lit("body")))
    attrs = F.max(F.when(F.col("tag") != "", F.regexp_extract("content", shape, 2)))
    return rows.groupBy(by, "slide", "ord").agg(kind.alias("kind"), attr_map(F.coalesce(attrs, F.lit(""))).alias("attrs"), paras.alias("text"))


def presentation_text(model: DataFrame, by: str = "doc_id") -> DataFrame:
    """presentation() back as (by, text): slides apart by ---, attributes in order of their names."""
    from tessera.operators.views import attr

    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), attr(F.coalesce(e["value"], F.lit(""))), F.lit('"')))
    tag = F.concat(F.lit("<"), F.col("kind"), F.array_join(pairs, ""), F.lit("/>"), F.when(F.col("text") != "", F.concat(F.lit("\n"), F.col("text"))).otherwise(""))
    piece = F.when(F.col("kind") == "head", F.concat(F.lit("# "), F.col("text"))).when(F.col("kind") == "body", F.col("text")).otherwise(tag)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))), lambda x: x["p"]), "\n")
    slides = model.groupBy(by, "slide").agg(whole.alias("p"))
    return slides.groupBy(by).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", "p"))), lambda x: x["p"]), "\n---\n"), F.lit("\n")).alias("text"))


def look(attrs: Column) -> Column:
    """An object's look from its attributes, in canonical order: what is left out is null."""
    return F.struct(*[F.try_element_at(attrs, F.lit(k)).alias(k) for k in LOOK])


def look_errors(objects: DataFrame, presets: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """objects (by, tag, attrs: map), presets (kind) -> (by, key, error): a kind that is no preset, adjustments that aren't
    name:number pairs, arrowheads of anything but a line or of no known form, and effects that aren't known or stand twice."""
    own = objects.select(*by, "tag", look(F.col("attrs")).alias("l")).select(*by, "tag", "l.*")
    known = presets.select(F.col("kind").alias("p_")).distinct()
    both = own.join(known, F.col("kind") == F.col("p_"), "left")
    effects = F.split("effects", r"\s+")
    bad = F.size(F.array_except(effects, F.array(*map(F.lit, EFFECTS)))) > 0
    arrow = lambda k: F.when(F.col(k).isNotNull() & (F.col("tag") != "line"), "not a line").when(~F.col(k).isin(*ARROWS, "none"), "unknown")
    tests = {
        "kind": F.when(F.col("kind").isNotNull() & F.col("p_").isNull(), "no preset"),
        "adj": F.when(~F.col("adj").rlike(r"^[A-Za-z]\w*:-?\d+(?: [A-Za-z]\w*:-?\d+)*\z"), "form"),
        "start": arrow("start"), "end": arrow("end"),
        "effects": F.when(bad, "unknown").when(F.size(F.array_distinct(effects)) < F.size(effects), "repeated"),
    }
    rows = both.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), e.alias("error")) for k, e in tests.items()])).alias("x"))
    return rows.select(*by, "x.*").filter("error is not null")
