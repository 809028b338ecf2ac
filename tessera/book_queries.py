"""Queries over books, stores, texts as models and drawings, registered with those of tessera.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import checks, drawing, grammar, recalc, store, views
from tessera.queries import query, read
from tessera.sources import props
from tessera.sources.shared import stored

# Formulas of single cells: a row of a sheet for each order, A its price, B its customer, C to H formulas


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formulas, cells, changed): the prices of every seventh order have gone up by 100 since the values were kept."""
    o = read(spark, d, "orders").select(F.concat(F.lit("s"), F.floor(F.col("o_orderkey") / 100_000).cast("string")).alias("sheet"), (F.col("o_orderkey") % 100_000 + 1).cast("int").alias("row"), "o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_custkey").cast("double").alias("b"))
    r = F.col("row").cast("string")
    text = lambda t: F.concat(*[x for k, part in enumerate(t.split("#")) for x in ([r] if k else []) + [F.lit(part)]])
    texts = {3: "=A#*2+B#", 4: "=SUM(A#:C#)", 5: "=IF(D#>100000,D#/10,C#)", 6: "=MIN(B#,A#)", 7: "=NOW()+A#", 8: "=G#+1"}
    made = F.array(*[F.struct(F.lit(c).alias("col"), text(t).alias("formula")) for c, t in texts.items()])
    formulas = o.select("sheet", "row", "o_orderkey", F.explode(made).alias("f")).select((F.col("o_orderkey") * 10 + F.col("f.col")).alias("id"), "sheet", "row", "f.col", "f.formula")
    c = F.col("p") * 2 + F.col("b")
    total = F.col("p") + F.col("b") + c
    now = F.when(F.col("o_orderkey") % 7 == 0, F.col("p") + 100).otherwise(F.col("p"))
    values = {1: now, 2: F.col("b"), 3: c, 4: total, 5: F.when(total > 100000, total / 10).otherwise(c), 6: F.least("b", "p"), 7: F.lit(1.0), 8: F.lit(2.0)}
    kept = F.array(*[F.struct(F.lit(k).alias("col"), v.alias("num")) for k, v in values.items()])
    cells = o.select("sheet", "row", F.explode(kept).alias("v")).select("sheet", "row", "v.col", "v.num", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("err"))
    changed = o.filter("o_orderkey % 7 = 0").select("sheet", "row", F.lit(1).alias("col"))
    return stored(formulas, "formulas"), cells, changed


GRID = "SELECT o_orderkey AS k, o_totalprice + 100 AS p, o_totalprice AS q, CAST(o_custkey AS DOUBLE) AS b FROM orders WHERE o_orderkey % 7 = 0"
SUMS = f"SELECT *, p * 2 + b AS c, q * 2 + b AS c0, p + b + (p * 2 + b) AS t, q + b + (q * 2 + b) AS t0 FROM ({GRID})"


@query("SELECT o_orderkey * 10 + c AS id, CAST(CASE WHEN c IN (5, 8) THEN 2 ELSE 1 END AS INTEGER) AS step0, CAST(CASE WHEN c = 8 THEN 2 WHEN c = 5 THEN 2 ELSE 1 END AS INTEGER) AS step FROM orders, (VALUES (3), (4), (5), (6), (7), (8)) t(c) WHERE o_orderkey % 7 = 0".replace("CAST(CASE WHEN c IN (5, 8) THEN 2 ELSE 1 END AS INTEGER) AS step0, ", ""))
def calc_dirty(spark, d):
    """Formulas that changes of cells reach, and in how many steps."""
    formulas, _, changed = grid(spark, d)
    return recalc.dirty(formulas, stored(recalc.precedents(formulas), "areas"), changed)


@query(
    f"""SELECT k * 10 + 3 AS id, round(c, 3) AS num, 'written' AS state FROM ({SUMS}) UNION ALL SELECT k * 10 + 4, round(t, 3), 'written' FROM ({SUMS})
        UNION ALL SELECT k * 10 + 5, round(CASE WHEN t > 100000 THEN t / 10 ELSE c END, 3), 'written' FROM ({SUMS})
        UNION ALL SELECT k * 10 + 6, round(least(b, p), 3), CASE WHEN least(b, p) = least(b, q) THEN 'same' ELSE 'written' END FROM ({SUMS})"""
)
def calc_recompute(spark, d):
    formulas, cells, changed = grid(spark, d)
    return recalc.recompute(formulas.filter("col < 7"), cells, changed).select("id", F.round("num", 3).alias("num"), "state")


@query("SELECT o_orderkey * 10 + c AS id, CASE c WHEN 7 THEN 'changes by itself' ELSE 'reads what is left' END AS why, CAST(c - 6 AS DOUBLE) AS num FROM orders, (VALUES (7), (8)) t(c) WHERE o_orderkey % 7 = 0")
def calc_left(spark, d):
    """Formulas that are left to the application, with the values they keep."""
    formulas, cells, changed = grid(spark, d)
    return recalc.recompute(formulas.filter("col > 6"), cells, changed).select("id", "why", "num")


@query("SELECT CAST(count(*) AS BIGINT) AS dirty, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS written, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS \"left\", count(*) FILTER (WHERE event_type = 'error') > 0 AS on_open FROM events")
def calc_on_open(spark, d):
    state = F.when(F.col("event_type") == "click", "written").when(F.col("event_type") == "error", "left").otherwise("same")
    return recalc.recalc_on_open(read(spark, d, "events").select(state.alias("state")))


@query("SELECT o_orderkey * 10 + c AS id, CAST(c - 7 AS INTEGER) AS step FROM orders, (VALUES (7), (8)) t(c)")
def calc_epoch(spark, d):
    """Formulas that depend on the date system."""
    formulas, _, _ = grid(spark, d)
    return recalc.epoch_bound(formulas, stored(recalc.precedents(formulas), "areas"))


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1.5 WHEN 1 THEN o_totalprice END AS num, CASE o_orderkey % 7 WHEN 2 THEN o_orderstatus END AS text, CASE o_orderkey % 7 WHEN 3 THEN '#DIV/0!' END AS err FROM orders")
def calc_cached(spark, d):
    """Values of cells after those computed anew are written; what is left or the same stays."""
    at = (F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row"), F.lit(1).alias("col"))
    k, none = F.col("o_orderkey") % 7, F.lit(None)
    o = read(spark, d, "orders")
    cells = o.select(*at, F.when(k <= 1, F.col("o_totalprice")).alias("num"), F.when((k == 2) | (k == 3), F.col("o_orderstatus")).alias("text"), none.cast("string").alias("err"))
    new = o.select(*at, F.when(k == 0, 1.5).alias("num"), F.when(k == 3, "#DIV/0!").alias("err"), F.when((k == 0) | (k == 3), "written").when(k == 1, "left").otherwise("same").alias("state"))
    return recalc.cached(cells, new).select(F.col("row").alias("o_orderkey"), "num", "text", "err")


# Books: one sheet with the nations and one with the regions, each a table with a header


def nations(spark: SparkSession, d: str) -> views.Book:
    sheets = spark.createDataFrame([(1, "nation", "work"), (2, "region", "work"), (3, "chart", "chart")], "sheet_no int, sheet string, kind string")
    parts, columns, rows = [], [], []
    for name in ("nation", "region"):
        t = read(spark, d, name)
        names = t.columns
        cells = F.array(*[F.struct(F.lit(k + 1).alias("col"), F.col(c).cast("string").alias("shown")) for k, c in enumerate(names)])
        parts.append(t.select(F.lit(name).alias("sheet"), (F.col(names[0]) + 2).alias("row"), F.explode(cells).alias("c")).select("sheet", "row", "c.col", "c.shown"))
        parts.append(spark.createDataFrame([(name, 1, k + 1, c) for k, c in enumerate(names)], "sheet string, row int, col int, shown string"))
        columns += [(name, k, c, "number" if c.endswith("key") else "text", "General" if c.endswith("key") else "@", None) for k, c in enumerate(names)]
        rows.append(t.select(F.lit(name).alias("sheet"), F.lit(name.upper()).alias("name"), F.lit(1).alias("c0"), F.lit(1).alias("r0"), F.lit(len(names)).alias("c1"), F.lit(True).alias("header"), F.lit(False).alias("totals"), F.col(names[0]).alias("k")))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    tables = rows[0].unionByName(rows[1]).groupBy("sheet", "name", "c0", "r0", "c1", "header", "totals").agg((F.max("k") + 2).alias("r1"))
    return views.Book(sheets, tables, spark.createDataFrame(columns, "table string, ord int, name string, type string, format string, formula string"), cells)


@query("SELECT CAST(n_nationkey + 2 AS BIGINT) AS row, n_name AS \"B\", CAST(n_regionkey AS VARCHAR) AS \"C\" FROM nation WHERE n_nationkey BETWEEN 8 AND 38 UNION ALL SELECT CAST(r AS BIGINT), NULL, NULL FROM range((SELECT greatest(max(n_nationkey) + 3, 10) FROM nation), 41) t(r)")
def view_range(spark, d):
    """Cells of a sheet's range, rows below the last one too."""
    return views.read(book=nations(spark, d), range="nation!B10:C40")


@query("SELECT CAST(n_nationkey + 2 AS BIGINT) AS row, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation WHERE n_nationkey + 2 BETWEEN 5 AND 12")
def view_table(spark, d):
    return views.read(book=nations(spark, d), table="Nation", rows="5:12")


@query("SELECT CAST(n_nationkey + 2 AS BIGINT) AS row, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def view_default(spark, d):
    """What is shown unasked: the first rows of the first table."""
    return views.read(book=nations(spark, d))


STRUCTURE = """SELECT sheet_no, part, "at", content FROM (
    SELECT 1 AS sheet_no, 0 AS part, 0 AS "at", '<sheet name="nation" range="A1:C' || (SELECT max(n_nationkey) + 2 FROM nation) || '">' AS content
    UNION ALL SELECT 2, 0, 0, '<sheet name="region" range="A1:B' || (SELECT max(r_regionkey) + 2 FROM region) || '">' UNION ALL SELECT 3, 0, 0, '<sheet name="chart">'
    UNION ALL SELECT s, 1048576, 0, '</sheet>' FROM (VALUES (1), (2), (3)) t(s)
    UNION ALL SELECT 1, 1, 0, '<table name="NATION" range="A1:C' || (SELECT max(n_nationkey) + 2 FROM nation) || '">' UNION ALL SELECT 2, 1, 0, '<table name="REGION" range="A1:B' || (SELECT max(r_regionkey) + 2 FROM region) || '">'
    UNION ALL SELECT s, 1, k, c FROM (VALUES (1), (2)) t(s), (VALUES (1, '| column | type | format | formula |'), (2, '|---|---|---|---|'), (1048576, '</table>')) u(k, c)
    UNION ALL SELECT * FROM (VALUES (1, 1, 3, '| n_nationkey | number | General |  |'), (1, 1, 4, '| n_name | text | @ |  |'), (1, 1, 5, '| n_regionkey | number | General |  |'), (2, 1, 3, '| r_regionkey | number | General |  |'), (2, 1, 4, '| r_name | text | @ |  |')))"""


@query(STRUCTURE)
def view_structure(spark, d):
    return views.structure(nations(spark, d)).select("sheet_no", "part", F.col("at").cast("int").alias("at"), "content")


@query(
    """SELECT 1 AS sheet_no, CAST(2097152 + 3 + n_nationkey + 2 AS INTEGER) AS at, '| ' || (n_nationkey + 2) || ' | ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS content FROM nation WHERE n_nationkey < 3
       UNION ALL SELECT 2, CAST(2097152 + 3 + r_regionkey + 2 AS INTEGER), '| ' || (r_regionkey + 2) || ' | ' || r_regionkey || ' | ' || r_name || ' |' FROM region WHERE r_regionkey < 3
       UNION ALL SELECT * FROM (VALUES (1, 2097152, '<data table="NATION" rows="2:4">'), (2, 2097152, '<data table="REGION" rows="2:4">'), (1, 2097153, '| row | n_nationkey | n_name | n_regionkey |'), (2, 2097153, '| row | r_regionkey | r_name |'), (1, 2097154, '|---|---|---|---|'), (2, 2097154, '|---|---|---|'), (1, 8388608, '</data>'), (2, 8388608, '</data>'))"""
)
def view_full(spark, d):
    """The windows of the whole book's reading, three rows of each table."""
    return views.full_view(nations(spark, d), 3).filter("at >= 2097152").select("sheet_no", F.col("at").cast("int").alias("at"), "content")


@query("SELECT * FROM (VALUES ('nation', 'NATION', 0, 'n_nationkey', 'number', 'General'), ('nation', 'NATION', 1, 'n_name', 'text', '@'), ('nation', 'NATION', 2, 'n_regionkey', 'number', 'General'), ('region', 'REGION', 0, 'r_regionkey', 'number', 'General'), ('region', 'REGION', 1, 'r_name', 'text', '@')) t(sheet, name, ord, \"column\", type, format)")
def grm_structure(spark, d):
    """The structure's text, parsed back."""
    from pyspark.sql import Window

    rows = views.structure(nations(spark, d)).select(F.lit("b").alias("book"), F.row_number().over(Window.orderBy("sheet_no", "part", "at")).alias("line"), "content")
    return grammar.parsed_structure(rows).select("sheet", "name", "ord", "column", "type", "format")


@query("SELECT user_id AS doc_id, 'k' || (event_id % 7) AS id, arg_min(props, event_id) AS label, arg_min(event_type = 'click', event_id) AS block FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def view_keeps(spark, d):
    kind = F.when(F.col("event_type") == "click", "bkeep").when(F.col("event_type") == "view", "keep").otherwise("run")
    return views.keep_list(read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("k"), F.col("event_id") % 7).alias("id"), F.col("props").alias("label")), ["doc_id"])


# Checks


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 9 THEN 'unknown' ELSE 'unfit' END AS error FROM part WHERE p_size % 10 = 9 OR (p_size % 10 < 5) <> (p_partkey % 2 = 0)")
def chk_formats(spark, d):
    size = F.col("p_size") % 10
    columns = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "number").otherwise("date").alias("type"), F.when(size == 9, "[red]0.0").when(size < 5, "#,##0.00").otherwise("yyyy-mm-dd").alias("format"))
    return checks.format_errors(columns, spark.createDataFrame([("#,##0.00",), ("yyyy-mm-dd",), ("@",)], "format string"))


@query("SELECT user_id AS batch, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS rows FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value) AS BIGINT) ELSE 0 END) > 50")
def chk_row_budget(spark, d):
    op = F.when(F.col("event_type") == "click", "append_rows").when(F.col("event_type") == "view", "insert_rows").otherwise("set")
    return checks.rows_over_budget(read(spark, d, "events").select(F.col("user_id").alias("batch"), op.alias("op"), F.floor("value").alias("n")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 3 THEN 'kind' WHEN p_size % 4 = 0 AND p_size % 3 = 0 THEN 'operator' WHEN p_size % 4 = 0 AND p_size % 3 = 1 AND p_partkey % 2 = 0 THEN 'formulas' WHEN p_size % 4 = 0 AND p_size % 3 = 2 AND p_partkey % 2 = 1 THEN 'formulas' WHEN p_size % 4 = 1 AND p_partkey % 2 = 1 THEN 'formulas' WHEN p_size % 4 = 2 THEN 'formulas' END AS error FROM part WHERE p_size % 4 IN (2, 3) OR p_size % 4 = 0 AND (p_size % 3 = 0 OR p_size % 3 = 1 AND p_partkey % 2 = 0 OR p_size % 3 = 2 AND p_partkey % 2 = 1) OR p_size % 4 = 1 AND p_partkey % 2 = 1")
def chk_rules(spark, d):
    k, m = F.col("p_size") % 4, F.col("p_size") % 3
    one, two = F.array(F.lit("A1")), F.array(F.lit("A1"), F.lit("A2"))
    kind = F.when(k == 0, "cellIs").when(k == 1, "expression").when(k == 2, "dataBar").otherwise("iconSet")
    rules = read(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(m == 1, "between").when(m == 2, "equal").otherwise("like").alias("operator"), F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("formulas"), (F.col("p_partkey") + 1).alias("priority"))
    return checks.rule_errors(rules)


ITEMS = "SELECT event_id AS id, user_id % 50 AS sheet, event_id % 97 + 1 AS c0, event_id % 1009 + 1 AS r0, event_id % 97 + 1 + event_id % 5 AS c1, event_id % 1009 + 1 + event_id % 23 AS r1, event_id % 3 AS w FROM events"


@query(
    f"""SELECT id, CASE WHEN r1 >= 500 AND c0 <= 60 AND c1 >= 10 AND NOT (c0 >= 10 AND c1 <= 60) THEN 'torn' WHEN w = 1 AND r0 < 500 THEN 'resized' ELSE 'moved' END AS why FROM ({ITEMS})
        WHERE sheet = 7 AND r1 >= 500 AND c0 <= 60 AND c1 >= 10 AND (NOT (c0 >= 10 AND c1 <= 60) OR w = 1 AND r0 < 500 OR w = 2)"""
)
def chk_shift(spark, d):
    """What three rows that come in at row 500 of columns J to BH of a sheet would tear."""
    e = read(spark, d, "events")
    what = F.when(F.col("event_id") % 3 == 1, "array").when(F.col("event_id") % 3 == 2, "data table").otherwise("merge")
    c0, r0 = F.col("event_id") % 97 + 1, F.col("event_id") % 1009 + 1
    items = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).cast("string").alias("sheet"), what.alias("what"), c0.alias("c0"), r0.alias("r0"), (c0 + F.col("event_id") % 5).alias("c1"), (r0 + F.col("event_id") % 23).alias("r1"))
    return checks.shift_errors(items, items.select("sheet", F.col("r1").alias("row"), F.col("c1").alias("col")), "7", (10, 60), 500, 3)


@query(f"SELECT id, EXISTS (SELECT 1 FROM (SELECT DISTINCT (event_id * 3) % 1009 + 1 AS r, (event_id * 5) % 97 + 1 AS c, user_id % 50 AS s FROM events WHERE event_type = 'purchase') x WHERE s = sheet AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1) AS refresh FROM ({ITEMS}) WHERE w = 0")
def chk_pivots(spark, d):
    """Pivots whose source has changed."""
    e = read(spark, d, "events").withColumn("sheet", F.col("user_id") % 50)
    c0, r0 = F.col("event_id") % 97 + 1, F.col("event_id") % 1009 + 1
    pivots = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), "sheet", c0.alias("c0"), r0.alias("r0"), (c0 + F.col("event_id") % 5).alias("c1"), (r0 + F.col("event_id") % 23).alias("r1"))
    changed = e.filter("event_type = 'purchase'").select("sheet", (F.col("event_id") * 3 % 1009 + 1).alias("row"), (F.col("event_id") * 5 % 97 + 1).alias("col"))
    return checks.pivots_to_refresh(pivots, changed).select("id", "refresh")


@query(
    """WITH c AS (SELECT p_partkey AS k, p_brand AS kind, p_size AS v FROM part WHERE p_partkey % 5 > 0), w AS (SELECT p_partkey AS k, p_brand AS kind, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 6 > 0)
       SELECT coalesce(w.kind, c.kind) AS kind, coalesce(w.k, c.k) AS id, CASE WHEN w.k IS NULL THEN 'dropped' WHEN c.k IS NULL THEN 'added' WHEN c.v = w.v THEN 'same' ELSE 'changed' END AS state, CASE WHEN c.v = w.v THEN '<x' || c.k || '/>' END AS xml FROM c FULL JOIN w ON c.k = w.k"""
)
def chk_items(spark, d):
    """Items of a kind replaced as declared, with the bytes of those that stay as they are."""
    part = read(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    current = part.filter("id % 5 > 0").withColumn("xml", F.concat(F.lit("<x"), F.col("id"), F.lit("/>")))
    wanted = part.filter("id % 6 > 0").withColumn("v", F.when(F.col("id") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return checks.kept_items(current, wanted, ["id"], most=1 << 20).select("kind", "id", "state", "xml")


@query(
    """WITH p AS (SELECT p_partkey % 50 AS path, 'part' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.bin' ELSE '.xml' END AS name, p_partkey FROM part)
       SELECT path, name AS what, 'no content type' AS error FROM p WHERE name LIKE '%.bin' AND p_partkey % 4 > 0
       UNION ALL SELECT p_partkey % 50, 'lost' || p_partkey, 'type without part' FROM part WHERE p_partkey % 40 = 0
       UNION ALL SELECT path, name || '#r1', 'no target' FROM p WHERE p_partkey % 9 = 0
       UNION ALL SELECT path, name || '#r2', 'repeated id' FROM p WHERE p_partkey % 10 = 0"""
)
def chk_package(spark, d):
    part = read(spark, d, "part").select((F.col("p_partkey") % 50).alias("path"), F.concat(F.lit("part"), F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, ".bin").otherwise(".xml")).alias("name"), "p_partkey")
    none = F.lit(None).cast("string")
    types = part.filter("name like '%.bin' and p_partkey % 4 = 0").select("path", "name", none.alias("ext")).unionByName(part.filter("p_partkey % 40 = 0").select("path", F.concat(F.lit("lost"), "p_partkey").alias("name"), none.alias("ext"))).unionByName(part.select("path").distinct().select("path", none.alias("name"), F.lit("XML").alias("ext")))
    rel = lambda i, to, cond: part.filter(cond).select("path", F.col("name").alias("part"), F.lit(i).alias("id"), to.alias("target"), F.lit(False).alias("external"))
    rels = rel("r1", F.lit("nothing"), "p_partkey % 9 = 0").unionByName(rel("r2", F.col("name"), "p_partkey % 10 = 0")).unionByName(rel("r2", F.col("name"), "p_partkey % 10 = 0"))
    return checks.package_errors(part.select("path", "name"), rels, types)


@query("SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '\\n$', ''), chr(10))) AS c FROM pages) WHERE regexp_matches(c, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') GROUP BY page_id UNION ALL SELECT -1, CAST(count(*) AS BIGINT) FROM pages")
def chk_text(spark, d):
    """Lines of pages with control characters; the last row is how many pages were read."""
    pages = read(spark, d, "pages")
    found = checks.text_diagnostics(pages, "page_id", "html").filter("code = 'control'").groupBy("page_id").agg(F.count("*").alias("n"))
    return found.unionByName(pages.select(F.lit(-1).cast("long").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("n")))


# Stores: the turns of a conversation as revisions of a document


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("turn") % 3 == 2, "reimport").otherwise("edit")
    return read(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("doc_id"), F.col("turn").alias("rev"), op.alias("op"), "text", store.digest(F.col("text")).alias("digest"))


@query(
    """WITH h AS (SELECT conv_id, max(turn) AS head FROM conversations GROUP BY conv_id), w AS (SELECT h.*, greatest(head - conv_id % 3, 0) AS base, CASE WHEN conv_id % 5 = 0 THEN 'ops' ELSE 'edit' END AS op FROM h)
       SELECT 'c' || conv_id AS doc_id, base, op, head, CASE WHEN base = head THEN 'clean' WHEN op = 'ops' OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = w.conv_id AND c.turn > base AND c.turn % 3 <> 2) THEN 'stale' ELSE 'rebase' END AS state FROM w
       UNION ALL SELECT 'c' || conv_id, head + 5, 'edit2', head, 'unknown' FROM h"""
)
def rev_gate(spark, d):
    """Which writes may go on the head, on a merge, or not at all."""
    revs = log(spark, d)
    n = F.regexp_replace("doc_id", "c", "").cast("long")
    heads = revs.groupBy("doc_id").agg(F.max("rev").alias("h"))
    writes = heads.select("doc_id", F.greatest(F.col("h") - n % 3, F.lit(0)).alias("base"), F.when(n % 5 == 0, "ops").otherwise("edit").alias("op")).unionByName(heads.select("doc_id", (F.col("h") + 5).alias("base"), F.lit("edit2").alias("op")))
    return store.gated(revs, writes).select("doc_id", "base", "op", "head", "state")


@query(
    """WITH h AS (SELECT conv_id, max(turn) AS head, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
       SELECT 'c' || conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 'unchanged' ELSE 'committed' END AS state, CASE WHEN conv_id % 2 = 1 THEN head + 1 END AS rev, CASE WHEN conv_id % 2 = 1 THEN sha256(coalesce(text, '') || chr(10) || 'x') END AS digest FROM h"""
)
def rev_reimport(spark, d):
    """Re-imports of each head: one that equals it makes no revision."""
    revs = log(spark, d)
    heads = revs.groupBy("doc_id").agg(F.max("rev").alias("base"), F.max_by("text", "rev").alias("text"))
    odd = F.regexp_replace("doc_id", "c", "").cast("long") % 2 == 1
    writes = heads.select("doc_id", "base", F.lit("reimport").alias("op"), F.when(odd, F.concat(F.coalesce("text", F.lit("")), F.lit("\nx"))).otherwise(F.col("text")).alias("text"))
    return store.committed(revs, writes).select("doc_id", "state", "rev", "digest")


@query(
    """WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)
       SELECT 'c' || conv_id AS doc_id, CASE WHEN m = 0 THEN 'clean' ELSE 'rebased' END AS state, CASE WHEN m = 0 THEN 'one' || chr(10) || 'two' || chr(10) || 'three' ELSE 'ONE' || chr(10) || 'two' || chr(10) || 'three' || chr(10) || 'four' END AS text FROM t WHERE turn = m AND m > 0"""
)
def rev_rebase(spark, d):
    """An edit of the first line, on a head that a re-import has given a fourth."""
    convs = read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m")).filter("m > 0").select(F.concat(F.lit("c"), "conv_id").alias("doc_id"))
    body = "one\ntwo\nthree\n"
    revs = convs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("rev"), F.lit("import").alias("op"), F.lit(body).alias("text")), F.struct(F.lit(2).cast("long").alias("rev"), F.lit("reimport").alias("op"), F.lit(body + "four").alias("text")))).alias("r")).select("doc_id", "r.*").withColumn("digest", store.digest(F.col("text")))
    writes = convs.select("doc_id", F.lit(1).cast("long").alias("base"), F.lit("edit").alias("op"), F.lit("ONE\ntwo\nthree\n").alias("text"))
    return store.committed(revs, writes).select("doc_id", "state", "text")


@query("WITH s AS (SELECT p_partkey, p_name, lower(replace(p_name, ' ', '-')) AS s FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_name || '.' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN s ELSE s || '-' || k END AS id FROM k")
def rev_ids(spark, d):
    """Ids of new documents by their names."""
    files = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("."), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"))
    return store.fresh_ids(files, spark.createDataFrame([], "id string")).select("p_partkey", "id")


@query("SELECT 'c' || conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE m END AS rev, sha256(coalesce(text, '')) AS digest FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn = CASE WHEN conv_id % 2 = 0 THEN 0 ELSE m END")
def rev_export(spark, d):
    """First revisions of even conversations, heads of odd ones."""
    revs = log(spark, d)
    even = F.regexp_replace("doc_id", "c", "").cast("long") % 2 == 0
    return store.exported(revs, revs.select("doc_id").distinct().select("doc_id", F.when(even, F.lit(0)).cast("long").alias("rev"))).select("doc_id", "rev", "digest")


@query("SELECT 'k' || user_id AS key, arg_max(props, event_id) AS value FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS props FROM events) GROUP BY user_id HAVING arg_max(props, event_id) <> ''")
def kv_latest(spark, d):
    """Values by key; an error takes its key's value out."""
    e = read(spark, d, "events").select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"))
    return store.latest(e).filter("value <> ''")


@query("SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'text' AS kind, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS n FROM documents")
def pkg_json(spark, d):
    """Texts as entries of a remainder, to lines of JSON and back."""
    own = read(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("text").alias("kind"), F.lit("t").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    back = props.remainder_entries(props.remainder_json(own))
    return back.select("doc_id", "seq", "kind", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n"))


# Texts as models


@query("SELECT doc_id, TRUE AS same, length(text) > 0 AS held FROM documents")
def grm_canonical(spark, d):
    """The canonical form of a canonical form is itself."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    one = stored(grammar.canonical(docs), "canonical")
    two = grammar.canonical(one).withColumnRenamed("text", "t2")
    return one.join(two, "doc_id").select("doc_id", F.col("text").eqNullSafe(F.col("t2")).alias("same"), (F.char_length("text") > 0).alias("held"))


@query("SELECT page_id, CAST(sum(len(regexp_extract_all(html, '<p(\\s+[A-Za-z-]+=\"[^\"<]*\")*\\s*/?>'))) AS BIGINT) AS n FROM pages GROUP BY page_id HAVING sum(len(regexp_extract_all(html, '<p(\\s+[A-Za-z-]+=\"[^\"<]*\")*\\s*/?>'))) > 0")
def grm_tags(spark, d):
    """Tags of a closed set."""
    return grammar.tags(read(spark, d, "pages"), "page_id", "html", ("p", "a", "div", "title")).filter("name = 'p' and form <> 'close'").groupBy("page_id").agg(F.count("*").alias("n"))


CELLS = "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS row, l_returnflag AS f, l_linestatus AS s, CAST(l_tax > 0.04 AS VARCHAR) AS t FROM lineitem"


@query(
    f"""WITH c AS ({CELLS}), x AS (SELECT doc_id, row, k AS col, 'fill' AS key, f AS value FROM c, (VALUES (1), (2)) v(k) UNION ALL SELECT doc_id, row, k, 'font', CASE WHEN k = 1 THEN s ELSE 'z' END FROM c, (VALUES (1), (2)) v(k) UNION ALL SELECT doc_id, row, k, 'bold', t FROM c, (VALUES (1), (2)) v(k)),
        w AS (SELECT doc_id, key, min(value) AS value FROM x GROUP BY 1, 2 HAVING min(value) = max(value)), r AS (SELECT doc_id, row, key, min(value) AS value FROM x GROUP BY 1, 2, 3 HAVING min(value) = max(value)),
        rr AS (SELECT r.* FROM r ANTI JOIN w USING (doc_id, key))
        SELECT doc_id, 'table' AS level, CAST(NULL AS BIGINT) AS row, CAST(NULL AS INTEGER) AS col, key, value FROM w UNION ALL SELECT doc_id, 'row', row, NULL, key, value FROM rr
        UNION ALL SELECT x.doc_id, 'cell', x.row, x.col, x.key, x.value FROM x ANTI JOIN w USING (doc_id, key) ANTI JOIN rr USING (doc_id, row, key)"""
)
def grm_lift(spark, d):
    """Styles of cells, written at the highest place that shares them."""
    return grammar.lifted(styled(spark, d))


def styled(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id").select("doc_id", F.row_number().over(order).cast("long").alias("row"), "l_returnflag", "l_linestatus", (F.col("l_tax") > 0.04).cast("string").alias("t")).withColumn("col", F.explode(F.array(F.lit(1), F.lit(2))))
    style = F.create_map(F.lit("fill"), F.col("l_returnflag"), F.lit("font"), F.when(F.col("col") == 1, F.col("l_linestatus")).otherwise("z"), F.lit("bold"), F.col("t"))
    return rows.select("doc_id", "row", "col", style.alias("style"))


@query(f"WITH c AS ({CELLS}) SELECT CAST(count(*) * 6 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lost FROM c")
def grm_spread(spark, d):
    """Lifted styles put back on their cells: none is lost or changed."""
    cells = styled(spark, d)
    back = grammar.spread_maps(stored(grammar.lifted(cells), "lifted"), cells.select("doc_id", "row", "col")).withColumnRenamed("style", "back")
    both = cells.join(back, ["doc_id", "row", "col"], "full_outer")
    at = lambda m, k: F.try_element_at(F.col(m), k)
    none = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys("style"), none), F.coalesce(F.map_keys("back"), none))
    lost = F.size(F.filter("keys", lambda k: ~at("style", k).eqNullSafe(at("back", k))))
    return both.withColumn("keys", keys).agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n"), F.coalesce(F.sum(lost), F.lit(0)).alias("lost"))


@query("SELECT user_id, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS font, CASE WHEN count(*) = count(CASE WHEN value > 2 THEN 1 END) THEN 'big' END AS size, CASE WHEN min(event_id % 2) = max(event_id % 2) THEN CAST(min(event_id % 2) AS VARCHAR) END AS color FROM events GROUP BY user_id")
def grm_fold(spark, d):
    """Properties that all of an object's text shares."""
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("font"), F.when(F.col("value") > 2, "big").alias("size"), (F.col("event_id") % 2).cast("string").alias("color"))
    return grammar.folded(e, ["user_id"])


@query("SELECT p_partkey AS block, 's' || (CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 5 END) AS style_id, CASE WHEN p_size % 3 <> 0 AND p_size % 5 = 0 THEN 'can''t hold indent' END AS error FROM part WHERE p_size % 3 = 0 OR p_size % 5 < 4 UNION ALL SELECT p_partkey, NULL, 'unknown style Style 4' FROM part WHERE p_size % 3 <> 0 AND p_size % 5 = 4")
def grm_resolve(spark, d):
    """Styles by name, or by level where a block names none."""
    own = read(spark, d, "part").select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("block"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Style "), F.col("p_size") % 5)).alias("style"), F.lit(None).cast("int").alias("level"), F.when((F.col("p_size") % 3 != 0) & (F.col("p_size") % 5 == 0), F.array(F.lit("indent"))).otherwise(F.array().cast("array<string>")).alias("keys"))
    styles = spark.createDataFrame([(1, f"s{k}", f"style {k}", k, ["align"]) for k in range(4)], "doc_id int, id string, name string, level int, can array<string>")
    return grammar.resolved(own, styles).select("block", "style_id", "error")


@query(
    """SELECT p_partkey AS id, 'kind' AS key, 'no preset' AS error FROM part WHERE p_size % 4 = 3 UNION ALL SELECT p_partkey, 'start', 'not a line' FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT p_partkey, 'start', 'unknown' FROM part WHERE p_size % 2 = 1 AND p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'effects', CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'repeated' END FROM part WHERE p_size % 5 < 2"""
)
def grm_look(spark, d):
    """Objects whose look can't be kept."""
    n = F.col("p_size")
    kind = F.when(n % 4 == 3, "blob").otherwise("roundRect")
    effects = F.when(n % 5 == 0, "shadow sparkle").when(n % 5 == 1, "glow glow").otherwise("shadow glow")
    attrs = F.create_map(F.lit("kind"), kind, F.lit("start"), F.when(F.col("p_partkey") % 3 == 0, "spear").otherwise("oval"), F.lit("effects"), effects, F.lit("adj"), F.lit("adj1:5000 adj2:-3"))
    own = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 2 == 1, "line").otherwise("shape").alias("tag"), attrs.alias("attrs"))
    return grammar.look_errors(own, spark.createDataFrame([("rect",), ("roundRect",)], "kind string"))


@query(
    """WITH b AS (SELECT * FROM (VALUES ('size', '10'), ('bold', 'off'), ('align', 'left')) t(key, value)),
       s AS (SELECT p_partkey AS name, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'align', CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END FROM part)
       SELECT CAST(name AS VARCHAR) AS name, key, value FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = s.key AND b.value = s.value) UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'bold', 'none' FROM part UNION ALL SELECT 'default', key, value FROM b"""
)
def grm_defaults(spark, d):
    """Style lines as they differ from the default style's."""
    part = read(spark, d, "part")
    pair = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    own = part.select(F.lit(1).alias("doc_id"), F.col("p_partkey").cast("string").alias("name"), pair("size", F.col("p_size").cast("string"), "align", F.when(F.col("p_partkey") % 2 == 0, "left").otherwise("right")).alias("props"), F.lit(False).alias("is_default"))
    base = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("default").alias("name"), pair("size", "10", "bold", "off", "align", "left").alias("props"), F.lit(True).alias("is_default"))
    return grammar.against_default(own.unionByName(base)).select("name", "key", "value")


# Drawings


@query(
    """WITH s AS (SELECT p_partkey AS id, p_partkey % 10 AS k, p_size AS n FROM part)
       SELECT id, 0 AS depth, CAST(100 * k AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y, 40.0 AS w, 20.0 AS h FROM s WHERE k = 0
       UNION ALL SELECT id, 1, 0 + (k - 0) * 2.0, g + (n - 0) * 0.5, 8.0, 2.0 FROM (SELECT s.*, o.n AS g FROM s JOIN s o ON o.id = s.id - s.k AND s.k > 0)"""
)
def drw_frames(spark, d):
    """Nine shapes in a group that shows them twice as wide and half as high."""
    k = F.col("p_partkey") % 10
    f = lambda a, b: F.when(k == 0, F.lit(float(a))).otherwise(F.lit(float(b)))
    shapes = read(spark, d, "part").select(F.lit(1).alias("doc_id"), F.lit(1).alias("slide"), F.col("p_partkey").alias("id"), F.when(k > 0, F.col("p_partkey") - k).alias("parent"), F.when(k == 0, 0.0).otherwise(k.cast("double")).alias("x"), F.col("p_size").cast("double").alias("y"), f(40, 4).alias("w"), f(20, 4).alias("h"), f(0, 0).alias("cx"), f(0, 0).alias("cy"), f(20, 4).alias("cw"), f(40, 4).alias("ch"))
    return drawing.frames(shapes).select("id", "depth", "x", "y", "w", "h")


@query(
    """SELECT p_partkey AS line, CASE WHEN p_size % 6 < 4 AND p_partkey >= 3 THEN (p_partkey - 3) * 10 + CASE p_size % 6 WHEN 1 THEN 0 WHEN 3 THEN 4.0 ELSE 2.0 END END AS px,
       CASE WHEN p_size % 6 < 4 AND p_partkey >= 3 THEN CASE p_size % 6 WHEN 0 THEN 0.0 WHEN 2 THEN 6.0 ELSE 3.0 END END AS py, CASE WHEN p_partkey < 3 THEN 'no object' WHEN p_size % 6 >= 4 THEN 'no site' END AS error FROM part"""
)
def drw_connectors(spark, d):
    part = read(spark, d, "part")
    placed = part.select(F.lit(1).alias("doc_id"), F.lit(1).alias("slide"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(4.0).alias("w"), F.lit(6.0).alias("h"))
    ends = part.select(F.lit(1).alias("doc_id"), F.lit(1).alias("slide"), F.col("p_partkey").alias("line"), F.lit("to").alias("which"), (F.col("p_partkey") - 3).alias("target"), (F.col("p_size") % 6).alias("site"))
    return drawing.connector_ends(ends, placed).select("line", "px", "py", "error")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'own' WHEN p_size % 5 = 1 THEN 'layout' ELSE 'master' END AS fill, CASE WHEN p_size % 5 = 1 THEN '20' ELSE '10' END AS size FROM part")
def drw_inherit(spark, d):
    """A property of a shape's own, its layout's slot or its master's."""
    empty = F.create_map().cast("map<string,string>")
    shapes = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("l").alias("layout"), F.lit("body").alias("type"), (F.col("p_size") % 5).alias("idx"), F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("fill"), F.lit("own"))).otherwise(empty).alias("props"))
    layouts = spark.createDataFrame([("l", "m", "body", 1, {"fill": "layout", "size": "20"})], "layout string, master string, type string, idx int, props map<string,string>")
    masters = spark.createDataFrame([("m", "body", {"fill": "master", "size": "10"})], "master string, type string, props map<string,string>")
    return drawing.inherited(shapes, layouts, masters).select("id", F.col("props")["fill"].alias("fill"), F.col("props")["size"].alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(dense_rank() OVER (ORDER BY 'fill=' || l_returnflag || ';font=' || l_linestatus) - 1 AS INTEGER) AS style_id FROM lineitem")
def drw_styles(spark, d):
    """Equal styles as one record."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.create_map(F.lit("font"), "l_linestatus", F.lit("fill"), "l_returnflag").alias("style"))
    return drawing.style_records(rows)[0].drop("style")


@query(
    """WITH t AS (SELECT lang AS corpus, doc_id, CASE WHEN n_chars % 11 = 0 THEN 'nested' WHEN n_chars % 7 = 0 THEN 'grid' WHEN n_chars % 3 = 0 THEN 'merged' ELSE 'plain' END AS category FROM documents), n AS (SELECT coalesce(corpus, '*') AS corpus, category, count(*) AS tables, count(DISTINCT doc_id) AS docs FROM t GROUP BY GROUPING SETS ((corpus, category), (category)))
       SELECT corpus, category, CAST(tables AS BIGINT) AS tables, CAST(docs AS BIGINT) AS docs, tables / sum(tables) OVER (PARTITION BY corpus) AS share FROM n"""
)
def drw_survey(spark, d):
    """Tables by their first category, each corpus and all."""
    n = F.col("n_chars")
    flags = F.filter(F.array(F.when(n % 3 == 0, "merged:rows"), F.when(n % 7 == 0, "grid"), F.when(n % 11 == 0, "nested")), lambda x: x.isNotNull())
    return drawing.table_survey(read(spark, d, "documents").select(F.col("lang").alias("corpus"), "doc_id", flags.alias("flags")))


@query(
    """WITH w AS (SELECT user_id AS file, event_type <> 'error' AS m, event_id % 5 > 0 AS s, event_id % 3 = 0 AS a, event_id % 4 = 0 AS b, value / 1000 AS off FROM events), x AS (SELECT file, count(*) FILTER (WHERE m) AS nm, count(*) AS n, count(*) FILTER (WHERE m AND s) AS ms, count(*) FILTER (WHERE m AND a AND b) AS tp, count(*) FILTER (WHERE m AND a <> b) AS f, avg(CASE WHEN m AND s THEN 1 - least(1.0, off / 0.02) END) AS w FROM w GROUP BY file),
       y AS (SELECT file, 2.0 * nm / (n + n) AS t, CASE WHEN nm = 0 THEN 0.0 ELSE ms / nm END AS p, CASE WHEN tp + f = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + f) END AS l, coalesce(w, 0.0) AS w FROM x)
       SELECT file, round(t, 6) AS t, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(l AS DOUBLE), 6) AS l, round(w, 6) AS w, CASE WHEN least(t, p, l, w) <= 0 THEN 0.0 ELSE round(pow(CAST(t AS DOUBLE) * p * l * w, 0.25), 6) END AS layout FROM y"""
)
def drw_scores(spark, d):
    """How near a rendering's layout is: glyphs, pages, lines, places."""
    e = read(spark, d, "events")
    words = e.select(F.col("user_id").alias("file"), (F.col("event_type") != "error").alias("matched"), (F.col("event_id") % 5 > 0).alias("same_page"), (F.col("event_id") % 3 == 0).alias("starts"), (F.col("event_id") % 4 == 0).alias("starts_there"), (F.col("value") / 1000).alias("off"))
    glyphs = words.groupBy("file").agg(F.count("*").alias("native"), F.count("*").alias("rendered"), F.count_if("matched").alias("matched"))
    return drawing.layout_scores(words, glyphs).select("file", *[F.round(c, 6).alias(c) for c in ("t", "p", "l", "w", "layout")])


@query("SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k = m AND m > 1 AND user_id % 2 = 0 THEN 0 ELSE 1 END, k) AS INTEGER) AS pos, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events)")
def drw_reorder(spark, d):
    """Decks of even number have their last slide moved to the front."""
    from pyspark.sql import Window

    slides = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    last = slides.groupBy("doc_id").agg(F.max_by("id", "pos").alias("id"), F.count("*").alias("n")).filter("doc_id % 2 = 0 and n > 1")
    moves = last.select("doc_id", "id", F.lit("move").alias("op"), F.lit(1).alias("to"))
    links = slides.limit(0).select("doc_id", F.col("id").alias("target"))
    return drawing.reordered(slides, moves, links).select("doc_id", F.col("pos").cast("int").alias("pos"), "id")
