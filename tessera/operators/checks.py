"""Checks before a write: formats, new rows, texts, conditional formats, shifts, and rules of packages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import a1
from tessera.functions.a1 import MAX_ROW
from tessera.functions.values import format_kind

# New rows of one list of operations at most (a setting), kinds of conditional formats, their operators.
MAX_NEW_ROWS = 50
RULES = ("cellIs", "expression", "dataBar")
COMPARES = ("lessThan", "lessThanOrEqual", "equal", "notEqual", "greaterThanOrEqual", "greaterThan", "between", "notBetween")


def format_errors(columns: DataFrame, known: DataFrame) -> DataFrame:
    """columns (id, type, format), known (format) -> (id, error): a format must be one of the workbook's (unknown), and fit
    the type (unfit): text takes @, dates a date format, numbers a number format, mixed ones General."""
    there = known.select(F.col("format").alias("f_")).distinct()
    kind = format_kind(F.col("format"))
    want = F.when(F.col("type") == "text", "Text").when(F.col("type") == "date", "Date").when(F.col("type") == "number", "Number").when(F.col("type") == "mixed", "General")
    fits = (kind == want) | ((F.col("type") == "number") & (kind == "General"))
    both = columns.join(there, F.col("format") == F.col("f_"), "left")
    return both.select("id", F.when(F.col("f_").isNull(), "unknown").when(~fits, "unfit").alias("error")).filter("error is not null")


def rows_over_budget(ops: DataFrame, by: Sequence[str] = ("batch",), most: int = MAX_NEW_ROWS) -> DataFrame:
    """ops (by, op, n: new rows) -> (by, rows): lists of operations that add more than most rows in all."""
    adds = F.sum(F.when(F.col("op").isin("append_rows", "insert_rows", "add_table"), F.col("n")).otherwise(0))
    return ops.groupBy(*by).agg(adds.alias("rows")).filter(F.col("rows") > most)


def text_diagnostics(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, line, col, code): what a document's text can't be read with: a tag that isn't closed or closes nothing, a heading
    deeper than six, a fence left open, a control character. Lines and columns from 1, several diagnostics a text."""
    from tessera.operators.windows import lines

    rows = lines(docs, by, text)
    at = lambda p: F.regexp_instr("content", F.lit(p))
    tests = [
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "control"),
        (r"^#{7,} ", "heading"),
    ]
    found = [rows.filter(at(p) > 0).select(by, "line", at(p).cast("int").alias("col"), F.lit(code).alias("code")) for p, code in tests]
    fences = rows.filter(F.col("content").rlike(r"^(?:```|~~~)")).groupBy(by).agg(F.count("*").alias("n"), F.max("line").alias("line"))
    found.append(fences.filter("n % 2 = 1").select(by, "line", F.lit(1).alias("col"), F.lit("fence").alias("code")))
    tag = r"<(/?)([a-z][a-z0-9-]*)(?:\s[^<>]*)?(/?)>"
    marks = rows.select(by, "line", F.posexplode(F.regexp_extract_all("content", F.lit(f"({tag})"), F.lit(1))).alias("seq", "tag"))
    parts = [F.regexp_extract("tag", tag, k) for k in (1, 2, 3)]
    marks = marks.filter(parts[2] == "").select(by, "line", "seq", parts[1].alias("name"), F.when(parts[0] == "/", -1).otherwise(1).alias("step"))
    # a name's depth after each of its marks; below zero it closes nothing, above zero at the end it is open
    depth = F.sum("step").over(Window.partitionBy(by, "name").orderBy("line", "seq"))
    level = marks.withColumn("depth", depth)
    low = F.min("depth").over(Window.partitionBy(by, "name").orderBy("line", "seq").rowsBetween(Window.unboundedPreceding, -1))
    closes = level.withColumn("low", F.least(F.coalesce(low, F.lit(0)), F.lit(0))).filter("step = -1 and depth < low")
    found.append(closes.select(by, "line", (F.col("seq") * 0 + 1).cast("int").alias("col"), F.lit("closes nothing").alias("code")))
    ends = level.groupBy(by, "name").agg(F.max_by("depth", F.struct("line", "seq")).alias("end"), F.least(F.min("depth"), F.lit(0)).alias("low"), F.max(F.when(F.col("step") == 1, F.col("line"))).alias("line"))
    found.append(ends.filter("end > low").select(by, "line", F.lit(1).alias("col"), F.lit("not closed").alias("code")))
    return reduce(DataFrame.unionByName, found)


def rule_errors(rules: DataFrame) -> DataFrame:
    """rules (id, kind, operator, formulas: array, priority, stop) -> (id, error) of conditional formats that can't be kept:
    an unknown kind or operator, too few or too many formulas, a repeated or missing priority."""
    want = F.when(F.col("kind") == "dataBar", 0).when(F.col("kind") == "expression", 1).when(F.col("operator").isin("between", "notBetween"), 2).otherwise(1)
    again = F.count("*").over(Window.partitionBy("priority")) > 1
    error = F.when(~F.col("kind").isin(*RULES), "kind").when((F.col("kind") == "cellIs") & ~F.coalesce(F.col("operator").isin(*COMPARES), F.lit(False)), "operator").when(F.size("formulas") != want, "formulas").when(F.col("priority").isNull() | (F.col("priority") < 1) | again, "priority")
    return rules.select("id", error.alias("error")).filter("error is not null")


def shift_errors(items: DataFrame, cells: DataFrame, sheet: str, cols: tuple[int, int], at: int, n: int) -> DataFrame:
    """items (id, sheet, what, c0, r0, c1, r1), cells (sheet, row, col) -> (id, why): what n rows that come in (or -n that go)
    at a row of those columns would tear: a merge, table, filter or the like that is split, an array formula that is split or
    resized, a data table that moves at all, and a cell pushed past the sheet's end (id null)."""
    own = items.filter(F.col("sheet") == sheet).withColumn("r", F.struct("c0", "r0", "c1", "r1"))
    moved, to = a1.shift_insert(F.col("r"), cols, at, n) if n >= 0 else a1.shift_delete(F.col("r"), cols, at, at - n - 1)
    own = own.withColumn("moved", moved).withColumn("to", to)
    height = lambda r: F.col(f"{r}.r1") - F.col(f"{r}.r0")
    why = F.when(F.col("moved") == "split", "torn").when((F.col("what") == "array") & (F.col("moved") == "to") & (height("to") != height("r")), "resized").when((F.col("what") == "data table") & (F.col("moved") != "same"), "moved")
    out = own.select("id", why.alias("why")).filter("why is not null")
    if n <= 0:
        return out
    past = cells.filter((F.col("sheet") == sheet) & (F.col("row") >= max(at, MAX_ROW - n + 1)) & F.col("col").between(*cols))
    return out.unionByName(past.select(F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.lit("past the end").alias("why")).limit(1))


def pivots_to_refresh(pivots: DataFrame, changed: DataFrame) -> DataFrame:
    """pivots (id, sheet, c0, r0, c1, r1: their source), changed (sheet, row, col) -> pivots with refresh: whether the source
    changed, so that the application computes them anew when it opens the book. Nothing is computed here."""
    from tessera.operators.matching import touched

    hit = touched(pivots, changed).select(F.col("id").alias("i_"))
    return pivots.join(hit, F.col("id") == F.col("i_"), "left").withColumn("refresh", F.col("i_").isNotNull()).drop("i_")


def kept_items(current: DataFrame, wanted: DataFrame, keys: Sequence[str], xml: str = "xml", most: int = 1024) -> DataFrame:
    """Items of a sheet (kind, keys, xml) as declared: current's bytes where an item is unchanged, wanted's where it is new or
    changed; items that wanted lacks go. Kinds with more than most items stay as they are (a placeholder)."""
    big = current.groupBy("kind").count().filter(F.col("count") > most).select("kind")
    fields = [c for c in wanted.columns if c not in ("kind", *keys)]
    old = current.select("kind", *keys, F.struct(*fields).alias("f_"), F.col(xml).alias("x_"))
    new = wanted.join(big, "kind", "left_anti").withColumn("g_", F.struct(*fields))
    both = new.join(old, ["kind", *keys], "left")
    state = F.when(F.col("f_").isNull(), "added").when(F.col("f_").eqNullSafe(F.col("g_")), "same").otherwise("changed")
    out = both.select("kind", *keys, *fields, F.when(state == "same", F.col("x_")).alias(xml), state.alias("state"))
    stays = current.join(big, "kind", "left_semi").select("kind", *keys, *fields, xml, F.lit("same").alias("state"))
    gone = current.join(big, "kind", "left_anti").join(wanted, ["kind", *keys], "left_anti").select("kind", *keys, *fields, F.lit(None).cast("string").alias(xml), F.lit("dropped").alias("state"))
    return out.unionByName(stays).unionByName(gone)


def dropped_parts(parts: DataFrame, edges: DataFrame, root: str, part: str) -> DataFrame:
    """parts (name), edges (src, dst) -> (name): what goes with an object's part: what it reaches and nothing else does."""
    from tessera.operators.lookups import reachable

    spark = parts.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    with_it = reachable(spark, edges, one(part)).select("node")
    without = reachable(spark, edges.filter(F.col("dst") != part), one(root)).select("node")
    return parts.join(with_it.join(without, "node", "left_anti"), F.col("name") == F.col("node"), "left_semi")


def package_errors(parts: DataFrame, rels: DataFrame, types: DataFrame, by: str = "path") -> DataFrame:
    """parts (by, name), rels (by, part, id, target, external), types (by, name: part or null, ext: extension or null) ->
    (by, what, error): a part without a content type, a type for no part, a repeated part in any case, a relation without
    its part or target, a repeated relation id."""
    from tessera.operators.sheets import broken_links

    ext = F.lower(F.regexp_extract("name", r"\.([^./]*)\z", 1))
    named = types.filter("name is not null").select(by, F.col("name").alias("n_")).distinct()
    kinds = types.filter("ext is not null").select(by, F.lower("ext").alias("e_")).distinct()
    own = parts.filter(F.col("name") != "[Content_Types].xml").withColumn("x_", ext)
    typed = own.join(named.withColumn("name", F.col("n_")).drop("n_"), [by, "name"], "left_anti").join(kinds.withColumnRenamed("e_", "x_"), [by, "x_"], "left_anti")
    out = [typed.select(by, F.col("name").alias("what"), F.lit("no content type").alias("error"))]
    out.append(named.withColumnRenamed("n_", "name").join(parts.select(by, "name"), [by, "name"], "left_anti").select(by, F.col("name").alias("what"), F.lit("type without part").alias("error")))
    out.append(parts.groupBy(by, F.lower("name").alias("what")).count().filter("count > 1").select(by, "what", F.lit("repeated part").alias("error")))
    out.append(broken_links(rels, parts, by).select(by, F.concat_ws("#", "part", "id").alias("what"), "error"))
    out.append(rels.select(by, F.col("part").alias("name")).distinct().join(parts.select(by, "name"), [by, "name"], "left_anti").select(by, F.col("name").alias("what"), F.lit("relations without part").alias("error")))
    return reduce(DataFrame.unionByName, out)

