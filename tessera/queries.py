"""The engine's operators as queries over the driver's tables, each with equivalent SQL where SQL can express it.

Queries read whole tables; limits stand only where they are the feature (row windows, the first hundred changes).
Sums of floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import a1, chars, units, values
from tessera.operators import aggregates, blocks, diffs, entries, lookups, matching, revisions, safety, sheets, tables, validation, windows
from tessera.plans import formula

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN round(p_retailprice * 1.1, 2) ELSE p_retailprice END AS p_retailprice, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part")
def tbl_set(spark, d):
    part = read(spark, d, "part").withColumn("pos", F.col("p_partkey"))
    changes = part.filter("p_partkey % 7 = 0").select("pos", F.round(F.col("p_retailprice") * 1.1, 2).alias("p_retailprice"), F.lit(None).cast("string").alias("p_brand"))
    return tables.set_cells(part, changes, ["p_retailprice", "p_brand"]).select("p_partkey", "p_name", "p_retailprice", "p_brand")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS pos, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL SELECT CAST((SELECT count(*) FROM nation) + r_regionkey + 1 AS BIGINT), r_name, NULL FROM region")
def tbl_append(spark, d):
    nation = read(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return tables.append_rows(nation, read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("pos"), F.col("r_name").alias("name")))


@query("SELECT CAST(CASE WHEN n_nationkey + 1 >= 6 THEN n_nationkey + 6 ELSE n_nationkey + 1 END AS BIGINT) AS pos, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey + 6 AS BIGINT), r_name FROM region WHERE r_regionkey < 5")
def tbl_insert(spark, d):
    nation = read(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.col("n_name").alias("name"))
    return tables.insert_rows(nation, 6, read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("pos"), F.col("r_name").alias("name")), 5)


@query("SELECT CAST(CASE WHEN n_nationkey + 1 > 9 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS BIGINT) AS pos, n_name AS name FROM nation WHERE n_nationkey + 1 NOT BETWEEN 5 AND 9")
def tbl_delete(spark, d):
    nation = read(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.col("n_name").alias("name"))
    return tables.delete_rows(nation, 5, 9)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_discount = 0 THEN '#DIV/0!' END AS ratio_err FROM lineitem")
def tbl_fill_formula(spark, d):
    df = formula.fill(read(spark, d, "lineitem"), "net", "=[@[l_extendedprice]]*(1-[@l_discount])")
    df = formula.fill(df, "ratio", "=[@l_tax]/[@l_discount]")
    return df.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), "ratio_err")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END || '-' || l_returnflag AS label, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS ratio, round(l_extendedprice / (SELECT sum(l_extendedprice) FROM lineitem) * 1e6, 6) AS share FROM lineitem")
def tbl_formulas(spark, d):
    df = read(spark, d, "lineitem")
    out = formula.fill(df, "label", '=IF([@l_quantity]>25,"big","small")&"-"&[@l_returnflag]')
    out = formula.fill(out, "ratio", "=IFERROR([@l_tax]/[@l_discount],0)")
    out = formula.fill(out, "share", "=[@l_extendedprice]/SUM(lineitem[l_extendedprice])*1000000", {"lineitem": df})
    return out.select("l_orderkey", "l_linenumber", "label", F.round("ratio", 6).alias("ratio"), F.round("share", 6).alias("share"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, lpad(CAST(p_size AS VARCHAR), 4, '0') AS code, CAST(p_size AS DOUBLE) AS back FROM part")
def tbl_set_type(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"))
    part = tables.set_type(part.withColumn("size_text", F.col("n")), "size_text", "text", values.display(F.col("n"), "0")).withColumn("code", values.display(F.col("n"), "0000"))
    return tables.set_type(part.withColumn("back", F.col("code")), "back", "number").select("p_partkey", "size_text", "code", "back")


@query("SELECT c_custkey, c_name, c_acctbal, c_acctbal < 0 AS in_debt FROM customer")
def tbl_add_column(spark, d):
    return tables.add_column(read(spark, d, "customer"), "in_debt", F.col("c_acctbal") < 0).select("c_custkey", "c_name", "c_acctbal", "in_debt")


@query(
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END,
         CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END,
         CASE WHEN event_id % 3 = 2 AND event_id % 11 <> 0 THEN value END NULLS FIRST, CASE WHEN event_id % 3 = 0 AND event_id % 11 <> 0 THEN lower(event_type) END NULLS FIRST,
         CASE WHEN event_id % 3 = 1 AND event_id % 11 <> 0 THEN value > 10 END NULLS FIRST, event_id) AS pos FROM events"""
)
def tbl_sort_mixed(spark, d):
    e = read(spark, d, "events")
    k = F.col("event_id") % 3
    c = values.cell(F.when(k == 2, F.col("value")), F.when(k == 0, F.col("event_type")), F.when(k == 1, F.col("value") > 10))
    rows = e.select("event_id", "user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 11 == 0, values.cell()).otherwise(c).alias("c"))
    return tables.sort_rows(rows, [("c", False)], ["user_id"]).select("event_id", "pos")


@query("SELECT CAST(o_orderkey AS BIGINT) AS pos, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey BETWEEN 101 AND 300")
def tbl_window(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_totalprice")
    return windows.row_window(orders, 101, 300).filter("o_orderstatus is not null")


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def tbl_range_display(spark, d):
    serial = values.serial_of(F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", values.display(F.col("o_totalprice"), "#,##0.00").alias("price"), values.display(serial, "yyyy-mm-dd").alias("day"), values.display(serial, "yyyy-mm").alias("month"))


ISLANDS = """WITH r AS (SELECT l_returnflag, l_linenumber, l_orderkey AS p, l_orderkey - row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY l_orderkey) AS g FROM lineitem),
  i AS (SELECT l_linenumber, l_returnflag, min(p) AS a, max(p) AS z FROM r GROUP BY l_linenumber, l_returnflag, g)"""


@query(ISLANDS + " SELECT l_linenumber, l_returnflag, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || ':' || z END, ', ' ORDER BY a, z) AS rows FROM i GROUP BY l_linenumber, l_returnflag")
def tbl_inverted_index(spark, d):
    return windows.inverted_index(read(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey")), "l_returnflag", ["l_linenumber"])


@query(
    """WITH c AS (SELECT l_orderkey AS row, l_linenumber AS col, l_linestatus AS v FROM lineitem),
       r AS (SELECT row, v, col - row_number() OVER (PARTITION BY row, v ORDER BY col) AS g, col FROM c), h AS (SELECT row, v, min(col) AS c0, max(col) AS c1 FROM r GROUP BY row, v, g),
       s AS (SELECT *, row - row_number() OVER (PARTITION BY c0, c1, v ORDER BY row) AS k FROM h)
       SELECT c0, CAST(min(row) AS BIGINT) AS r0, c1, CAST(max(row) AS BIGINT) AS r1, v AS value FROM s GROUP BY c0, c1, v, k"""
)
def fmt_rectangles(spark, d):
    return windows.rectangles(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_linestatus").alias("value")))


# Aggregates and lookups


@query("SELECT o.o_orderkey, round(coalesce(s.v, 0), 2) AS total, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey")
def agg_sumifs(spark, d):
    items, orders = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), read(spark, d, "orders").select("o_orderkey")
    out = aggregates.per_row_sumifs(orders, items, {"o_orderkey": "l_orderkey"}, "l_extendedprice", "total")
    out = aggregates.per_row_sumifs(out, items, {"o_orderkey": "l_orderkey"}, None, "n")
    return out.select("o_orderkey", F.round("total", 2).alias("total"), F.col("n").cast("long").alias("n"))


@query("SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity >= 10 AND l_linestatus = 'O') AS BIGINT) AS n, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity >= 10 AND l_linestatus <> 'O'), 0), 2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_countifs(spark, d):
    df = read(spark, d, "lineitem")
    return df.groupBy("l_returnflag").agg(aggregates.sumifs(df, None, {"l_quantity": ">=10", "l_linestatus": "o"}).alias("n"), F.round(aggregates.sumifs(df, "l_extendedprice", {"l_quantity": ">=10", "l_linestatus": "<>o"}), 2).alias("total"))


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS \"sum\", round(avg(c_acctbal), 6) AS average, min(c_acctbal) AS \"min\", max(c_acctbal) AS \"max\" FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_nationkey")
def agg_ranges(spark, d):
    c = F.when(F.col("c_custkey") % 5 == 0, values.cell(None, F.col("c_name"))).otherwise(values.cell(F.col("c_acctbal")))
    out = aggregates.ranges(read(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), c.alias("value")), ["c_nationkey"])
    return out.select("c_nationkey", F.round("sum", 2).alias("sum"), F.round("average", 6).alias("average"), "min", "max")


@query(
    """WITH f AS (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN '0.00' WHEN event_id % 4 = 1 THEN '#,##0' ELSE 'General' END AS fmt, count(*) FILTER (WHERE event_id % 10 <> 0 OR event_type = 'click') AS n FROM events GROUP BY 1, 2),
       b AS (SELECT event_type, fmt, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN n > 0 THEN n ELSE -1 END DESC, fmt DESC) AS k FROM f)
       SELECT event_type, CASE WHEN event_type = 'click' THEN 'number' ELSE 'mixed' END AS type, fmt AS format FROM b WHERE k = 1"""
)
def agg_type_inference(spark, d):
    fmt = F.when(F.col("event_id") % 4 == 0, "0.00").when(F.col("event_id") % 4 == 1, "#,##0").otherwise("General")
    c = F.when((F.col("event_id") % 10 == 0) & (F.col("event_type") != "click"), values.cell(None, F.col("event_type"))).otherwise(values.cell(F.col("value")))
    return aggregates.column_types(read(spark, d, "events").select("event_type", c.alias("value"), fmt.alias("format")), ["event_type"])


@query("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def agg_census(spark, d):
    return aggregates.census(read(spark, d, "documents"), "lang", "source")


@query("WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k FROM p) WHERE k = 1")
def agg_mode(spark, d):
    return aggregates.common_value(read(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT o.o_orderkey, coalesce(c.c_name, 'none') AS found FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def join_xlookup(spark, d):
    customer = read(spark, d, "customer").withColumn("pos", F.col("c_custkey"))
    return lookups.xlookup(read(spark, d, "orders"), customer, "o_custkey", "c_custkey", "pos", "c_name", F.lit("none")).select("o_orderkey", "found")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 80000 THEN 'top' WHEN l_extendedprice >= 40000 THEN 'high' WHEN l_extendedprice >= 10000 THEN 'mid' WHEN l_extendedprice >= 0 THEN 'low' END AS found FROM lineitem")
def join_vlookup_approx(spark, d):
    bands = spark.createDataFrame([(0.0, "low", 0), (10000.0, "mid", 1), (40000.0, "high", 2), (80000.0, "top", 3)], "k double, v string, pos int")
    if not lookups.is_sorted(bands, "k", "pos").first().is_sorted:
        raise ValueError("the vector isn't sorted")
    return lookups.vlookup_approximate(read(spark, d, "lineitem"), bands, "l_extendedprice", "k", "v").select("l_orderkey", "l_linenumber", "found")


@query("SELECT e.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS found FROM events e")
def join_as_of(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return lookups.as_of(e, e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("v")), "user_id", "ts", "t", "v").select("event_id", "found")


RANGES = "SELECT event_id AS id, user_id % 50 AS sheet, event_id % 97 AS c0, event_id % 1009 AS r0, event_id % 97 + event_id % 5 AS c1, event_id % 1009 + event_id % 23 AS r1 FROM events"


@query(f"WITH g AS ({RANGES}) SELECT a.sheet, a.id AS a, b.id AS b FROM g a JOIN g b ON a.sheet = b.sheet AND a.id < b.id AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1")
def join_overlap(spark, d):
    read(spark, d, "events").createOrReplaceTempView("tessera_events")
    g = spark.sql(RANGES.replace("FROM events", "FROM tessera_events"))
    return lookups.overlaps(g.select("sheet", "id", F.struct("c0", "r0", "c1", "r1").alias("r")))


@query("SELECT p_partkey AS node, CAST(p_partkey % 10 AS INTEGER) AS depth FROM part WHERE p_partkey % 10 < 8 AND p_partkey % 20 < 10")
def reach_parts(spark, d):
    """Chains of eight parts, each with links back to its first part and to itself; every other chain has no root."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("src"))
    last = part.select(F.col("src").alias("dst"))
    edges = part.filter("src % 10 < 7").select("src", (F.col("src") + 1).alias("dst")).join(last, "dst", "left_semi").select("src", "dst")
    back = part.filter("src % 10 < 8").select("src", F.explode(F.array(F.col("src") - F.col("src") % 10, F.col("src"))).alias("dst"))
    return lookups.reachable(spark, edges.unionByName(back), part.filter("src % 20 = 0").select(F.col("src").alias("node")))


@query("SELECT * FROM (VALUES ('gross', 1), ('net', 2), ('tax', 3), ('total', 4)) AS t(\"column\", step)")
def dep_closure(spark, d):
    formulas = {"total": "=[@net]+[@tax]", "tax": "=[@net]*0.1", "net": "=[@gross]-[@rebate]", "gross": "=[@price]*[@quantity]", "other": "=[@quantity]*2"}
    dirty, out = {"price"}, []
    for c in formula.order(formulas):
        if any(x in dirty for _, x in formula.precedents(formula.parse(formulas[c]))):
            dirty.add(c)
            out.append(c)
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(out)], "column string, step int")


# Validation


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'ok' ELSE 'bad' END AS verdict FROM events")
def val_list(spark, d):
    return read(spark, d, "events").select("event_id", validation.in_list(F.col("event_type"), [" Click", "VIEW "]).alias("verdict"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN 'ok' ELSE 'bad' END AS size_ok, CASE WHEN p_retailprice % 1 = 0 AND p_retailprice > 1000 THEN 'ok' ELSE 'bad' END AS price_ok FROM part")
def val_whole(spark, d):
    return read(spark, d, "part").select("p_partkey", validation.whole(F.col("p_size"), "between", F.lit(10), F.lit(40)).alias("size_ok"), validation.whole(F.col("p_retailprice"), "greaterThan", F.lit(1000)).alias("price_ok"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-01-01' OR CAST(o_orderdate AS DATE) > DATE '1996-12-31' THEN 'ok' ELSE 'bad' END AS verdict FROM orders")
def val_date(spark, d):
    low, high = (values.serial_of(F.lit(x).cast("date")) for x in ("1995-01-01", "1996-12-31"))
    return read(spark, d, "orders").select("o_orderkey", validation.date(values.serial_of(F.to_date("o_orderdate")), "notBetween", low, high).alias("verdict"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN 'ok' ELSE 'bad' END AS verdict FROM documents")
def val_length(spark, d):
    return read(spark, d, "documents").select("doc_id", validation.text_length(F.col("text"), "lessThanOrEqual", F.lit(1000)).alias("verdict"))


@query("SELECT s_suppkey, length(s_name) > 31 OR regexp_matches(s_name, '[\\[\\]:*?/\\\\]') OR regexp_full_match(s_name, '[A-Za-z]{1,3}[0-9]+') AS bad FROM supplier")
def val_names(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", validation.bad_name(F.col("s_name")).alias("bad"))


# Differences


VERSIONS = "old AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), new AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN s_suppkey + 100000 ELSE s_suppkey END AS s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier)"


@query(
    f"""WITH {VERSIONS}, o AS (SELECT s_suppkey, 's_name' AS "column", s_name AS v FROM old UNION ALL SELECT s_suppkey, 's_acctbal', CAST(round(s_acctbal * 100) AS VARCHAR) FROM old),
        n AS (SELECT s_suppkey, 's_name' AS "column", s_name AS v FROM new UNION ALL SELECT s_suppkey, 's_acctbal', CAST(round(s_acctbal * 100) AS VARCHAR) FROM new)
        SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o."column", n."column") AS "column", o.v IS NULL AS added, n.v IS NULL AS removed FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey AND o."column" = n."column" WHERE o.v IS DISTINCT FROM n.v"""
)
def cell_diff(spark, d):
    old = read(spark, d, "supplier")
    new = old.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))).withColumn("s_suppkey", F.when(F.col("s_suppkey") % 13 == 0, F.col("s_suppkey") + 100000).otherwise(F.col("s_suppkey")))
    out = diffs.cell_diff(old, new, ["s_suppkey"], ["s_name", "s_acctbal"])
    return out.select("s_suppkey", "column", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("removed"))


def turns(spark, d) -> DataFrame:
    """Each turn of a conversation with the two that follow it."""
    up = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text", 1).over(up).alias("text1"), F.lead("text", 2).over(up).alias("text2"))


@query()
def txt_opcodes(spark, d):
    return turns(spark, d).filter("text1 is not null").select("conv_id", "turn", diffs.line_opcodes("text", "text1").alias("ops")).select("conv_id", "turn", F.explode("ops").alias("op")).select("conv_id", "turn", "op.*")


@query()
def txt_ratio(spark, d):
    return turns(spark, d).filter("text1 is not null").select("conv_id", "turn", diffs.similarity("text", "text1").alias("ratio"))


@query()
def txt_unified(spark, d):
    return turns(spark, d).filter("text1 is not null").select("conv_id", "turn", diffs.unified("text", "text1").alias("diff"))


@query()
def txt_merge3(spark, d):
    return turns(spark, d).filter("text2 is not null").select("conv_id", "turn", diffs.merge3("text", "text1", "text2").alias("m")).select("conv_id", "turn", "m.*")


@query()
def txt_align(spark, d):
    """Each text's lines as paragraphs, against a version whose first one stands last."""
    parts = F.split("text", "\n")
    rows = read(spark, d, "documents").select("doc_id", F.array_join(parts, "\n\n").alias("old"), F.array_join(F.concat(F.slice(parts, 2, 1 << 30), F.slice(parts, 1, 1)), "\n\n").alias("new"))
    return rows.select("doc_id", F.explode(diffs.aligned("old", "new")).alias("a")).select("doc_id", "a.*")


# Texts


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)) WHERE i BETWEEN 2 AND 4")
def txt_lines(spark, d):
    return windows.line_window(read(spark, d, "documents"), 2, 4)


MARKED = "concat('# ', substr(text, 1, 20), chr(10), replace(text, chr(10), concat(chr(10), '## ')))"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(CASE WHEN l[i] LIKE '## %' THEN 2 ELSE 1 END AS INTEGER) AS level FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace({MARKED}, '\\n$', ''), chr(10)) AS l FROM documents)) WHERE l[i] LIKE '# %' OR l[i] LIKE '## %'")
def txt_outline(spark, d):
    return windows.outline(read(spark, d, "documents").select("doc_id", F.expr(MARKED).alias("text"))).select("doc_id", "line", "level")


@query(
    f"""WITH l AS (SELECT doc_id, i AS line, l[i] AS c, len(l) AS z FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace({MARKED}, '\\n$', ''), chr(10)) AS l FROM documents))),
       h AS (SELECT *, CASE WHEN c LIKE '## %' THEN 2 ELSE 1 END AS v FROM l WHERE c LIKE '# %' OR c LIKE '## %')
       SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(CASE WHEN v = 2 THEN coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, z) ELSE coalesce(min(CASE WHEN v = 1 THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, z) END AS INTEGER) AS "end" FROM h"""
)
def txt_section(spark, d):
    rows = windows.lines(read(spark, d, "documents").select("doc_id", F.expr(MARKED).alias("text")))
    return windows.sections(rows).select("doc_id", "line", F.col("end").cast("int").alias("end"))


@query(
    """WITH l AS (SELECT doc_id, i AS line, l[i] AS c, len(l) AS z FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents))),
       u AS (SELECT *, sum(strlen(c) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM l), o AS (SELECT doc_id, z, min(CASE WHEN used > 2000 THEN line END) AS k FROM u GROUP BY doc_id, z),
       b AS (SELECT o.doc_id, o.z, o.k, max(CASE WHEN trim(l.c) = '' AND l.line < o.k AND l.line - 1 >= (o.k - 1) * 3 // 4 THEN l.line END) AS e FROM o JOIN l USING (doc_id) GROUP BY 1, 2, 3)
       SELECT doc_id, CAST(CASE WHEN k IS NULL THEN z ELSE coalesce(e, greatest(k - 1, 1)) END AS INTEGER) AS last_line FROM b"""
)
def txt_clip(spark, d):
    return windows.clip(read(spark, d, "documents"), 2000).select("doc_id", F.col("last_line").cast("int").alias("last_line"))


@query("SELECT doc_id, CAST(len(list_filter(list_slice(p, 2, len(p) - 1), lambda x: x = 'n')) AS BIGINT) AS n, CASE WHEN contains(text, 'ana') THEN CAST(strpos(text, 'ana') - 1 AS INTEGER) END AS first FROM (SELECT doc_id, text, string_split(text, 'a') AS p FROM documents)")
def txt_occurrences(spark, d):
    """How often ana stands in each text, overlapping ones too, and where first. (SQL: an n alone between two a.)"""
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", values.occurrence_count(text, "ana").alias("n"), F.get(values.occurrences(text, "ana"), 0).alias("first"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x84\\x{85}\\x{86}-\\x{a0}\\x{ad}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{feff}\\x{fffd}]')) AS BIGINT) AS n FROM documents")
def txt_unusual(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(chars.unusual(F.col("text"))).cast("long").alias("n"))


@query(
    r"""WITH l AS (SELECT doc_id, i, t[i] AS c FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)),
       k AS (SELECT *, CASE WHEN trim(c) = '' THEN 'blank' WHEN regexp_matches(c, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(c, '^---\s*$') THEN 'break' WHEN regexp_matches(c, '^\s*([-*+]|\d+[.)]) ') THEN 'item' WHEN regexp_matches(c, '^\|.*\|\s*$') THEN 'row' ELSE 'para' END AS kind FROM l),
       g AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR kind IN ('heading', 'break', 'item') THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
       b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS block FROM g)
       SELECT doc_id, block, kind, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, string_agg(c, chr(10) ORDER BY i) AS content FROM b WHERE kind <> 'blank' GROUP BY doc_id, block, kind"""
)
def txt_blocks(spark, d):
    return blocks.blocks(read(spark, d, "documents"))


#: FNV-1a of 64 bits of a text's UTF-8, byte by byte in integers of 128 bits.
FNV = """list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), list_transform(regexp_extract_all(hex(encode(coalesce({0}, ''))), '..'), lambda x: CAST(CAST(concat('0x', x) AS BIGINT) AS HUGEINT))), lambda h, b: CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211 % CAST('18446744073709551616' AS HUGEINT))"""


@query(f"SELECT doc_id, lpad(lower(to_hex(CAST({FNV.format('text')} AS UBIGINT))), 16, '0') AS digest FROM documents")
def dig_fnv1a(spark, d):
    return read(spark, d, "documents").select("doc_id", revisions.digest("text").alias("digest"))


# Revisions


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations")
def rev_history(spark, d):
    return revisions.history(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "parent")


@query("SELECT conv_id, max(turn) AS head, CAST(count(*) AS BIGINT) AS revisions, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def rev_head(spark, d):
    return revisions.heads(read(spark, d, "conversations"), "conv_id", "turn", ("role",))


@query("SELECT conv_id, CAST(1 AS BIGINT) AS base, max(turn) AS head, CAST(count(*) FILTER (WHERE turn > 1) AS BIGINT) AS later, coalesce(bool_or(turn > 1 AND role <> 'user'), false) AS stale FROM conversations GROUP BY conv_id")
def rev_stale(spark, d):
    log = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "reimport").otherwise("edit").alias("op"))
    return revisions.stale(log, log.select("conv_id").distinct().withColumn("base", F.lit(1).cast("long")), "conv_id", "turn")


# Safety and quality


def _rule(kind: str, phase: str, pattern: str) -> str:
    found = "regexp_extract_all(html, '" + pattern.replace("'", "''") + "')"
    return f"SELECT page_id, '{kind}' AS kind, '{phase}' AS phase, CAST(len({found}) AS BIGINT) AS n FROM pages WHERE len({found}) > 0"


@query(" UNION ALL ".join(_rule(*r) for r in safety.RULES))
def safe_scan(spark, d):
    return safety.notices(read(spark, d, "pages"), "page_id", "html")


@query("SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'WEBSERVICE' WHEN 3 THEN 'RTD' WHEN 4 THEN 'REGISTER.ID' WHEN 5 THEN 'DDE' END AS notice FROM part")
def safe_formula_text(spark, d):
    """Parts' names in formulas that sum, fetch, quote a fetching function, or name another program."""
    name = F.col("p_name")
    texts = [("=SUM(T[", "])"), ('=WEBSERVICE("http://', '")'), ('="RTD(', ')"&"x"'), ('=1+rtd("', '",,"b")'), ('=REGISTER.ID("', '")'), ("=CMD|'", "'!A1")]
    text = F.lit(None).cast("string")
    for k, (a, b) in enumerate(texts):
        text = F.when(F.col("p_size") % 6 == k, F.concat(F.lit(a), name, F.lit(b))).otherwise(text)
    return read(spark, d, "part").select("p_partkey", safety.unsafe_formula(text).alias("notice"))


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS warnings, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'refused' WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'degraded' ELSE 'as is' END AS status FROM events GROUP BY user_id")
def quality_report(spark, d):
    code = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "view", "substituted").otherwise("approximated")
    return safety.quality_report(read(spark, d, "events").withColumn("code", code), "user_id", "code", True).select("user_id", "errors", "warnings", "status")


# Numbers and addresses


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders")
def num_date_serial(spark, d):
    serial = values.serial_of(F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", serial.alias("serial"), values.date_text(serial).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(printf('%.14e', l_extendedprice * l_tax) AS DECIMAL(38,18)), 1) AS DOUBLE) AS rounded FROM lineitem")
def num_round15(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.round15(F.col("l_extendedprice") * F.col("l_tax"), 1).alias("rounded"))


@query("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INTEGER)) WHEN i <= 702 THEN chr(CAST(65 + (i - 27) // 26 AS INTEGER)) || chr(CAST(65 + (i - 1) % 26 AS INTEGER)) ELSE chr(CAST(65 + (i - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((i - 27) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (i - 1) % 26 AS INTEGER)) END AS letters, CAST(i AS INTEGER) AS back FROM range(1, 16385) t(i)")
def a1_codec(spark, d):
    return spark.range(1, 16385).select(F.col("id").alias("i"), a1.col_letters(F.col("id")).alias("letters")).withColumn("back", a1.col_index(F.col("letters")))


@query(
    f"""WITH g AS ({RANGES}) SELECT id, CASE WHEN c1 < 10 OR c0 > 60 OR r1 < 500 THEN 'same' WHEN c0 >= 10 AND c1 <= 60 THEN CASE WHEN r0 >= 500 AND r1 <= 519 THEN 'gone' ELSE 'to' END ELSE 'split' END AS moved,
        CASE WHEN c1 < 10 OR c0 > 60 OR r1 < 500 THEN r0 WHEN c0 >= 10 AND c1 <= 60 AND NOT (r0 >= 500 AND r1 <= 519) THEN CASE WHEN r0 < 500 THEN r0 WHEN r0 <= 519 THEN 500 ELSE r0 - 20 END END AS r0,
        CASE WHEN c1 < 10 OR c0 > 60 OR r1 < 500 THEN r1 WHEN c0 >= 10 AND c1 <= 60 AND NOT (r0 >= 500 AND r1 <= 519) THEN CASE WHEN r1 <= 519 THEN 499 ELSE r1 - 20 END END AS r1 FROM g"""
)
def rng_shift(spark, d):
    read(spark, d, "events").createOrReplaceTempView("tessera_events")
    g = spark.sql(RANGES.replace("FROM events", "FROM tessera_events")).withColumn("r", F.struct("c0", "r0", "c1", "r1"))
    moved, to = a1.shift_delete(F.col("r"), (10, 60), 500, 519)
    return g.select("id", moved.alias("moved"), to.alias("to")).select("id", "moved", "to.r0", "to.r1")


@query("SELECT p_partkey, 'bold:' || p_brand || ';color:' || p_type || ';size:' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '10' END AS \"all\", 'color:' || p_type || CASE WHEN p_partkey % 2 = 0 AND p_size <> 10 THEN ';size:' || p_size ELSE '' END AS diff FROM part")
def map_overlay(spark, d):
    """Own properties over others, and what then differs from them."""
    base = F.create_map(F.lit("bold"), "p_brand", F.lit("size"), F.lit("10"))
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("color"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("color"), F.col("p_type")))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"]))), ";")
    whole = values.overlay(base, own)
    return read(spark, d, "part").select("p_partkey", text(whole).alias("all"), text(values.map_minus(whole, base)).alias("diff"))


# Matches


@query("SELECT p_partkey, CASE WHEN h % 100 = 0 THEN concat(h // 100, 'pt') WHEN h % 10 = 0 THEN concat(h // 100, '.', (h % 100) // 10, 'pt') ELSE concat(h // 100, '.', lpad(CAST(h % 100 AS VARCHAR), 2, '0'), 'pt') END AS shown, h AS back FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS h FROM part)")
def num_length(spark, d):
    rows = read(spark, d, "part").select("p_partkey", units.length_text(F.round(F.col("p_retailprice") * 100).cast("long")).alias("shown"))
    return rows.withColumn("back", units.parse_length(F.col("shown")))


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{2E80}-\\x{312F}\\x{3190}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{3FFFF}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}]') THEN 'latin' WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}]') THEN 'hangul' ELSE 'cjk' END AS script FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def txt_script(spark, d):
    return read(spark, d, "documents").select("doc_id", units.script(F.coalesce("text", F.lit(""))).alias("script"))


@query("SELECT 'n' || p_partkey AS name, CASE WHEN p_partkey % 5 < 4 THEN 'Sheet1!A' || (p_partkey - p_partkey % 5 + 1) END AS target, CAST(CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 ELSE 8 END AS INTEGER) AS steps FROM part")
def join_names(spark, d):
    """Of five names the first is a cell, three stand for the one before, in capitals, and the last stands for itself."""
    k = F.col("p_partkey")
    refers = F.when(k % 5 == 0, F.concat(F.lit("Sheet1!A"), k + 1)).when(k % 5 == 4, F.concat(F.lit("N"), k)).otherwise(F.concat(F.lit("N"), k - 1))
    return matching.defined_names(read(spark, d, "part").select(F.concat(F.lit("n"), k).alias("name"), refers.alias("refers")))


@query(f"WITH g AS ({RANGES}), c AS (SELECT DISTINCT CAST(event_id % 97 AS BIGINT) AS r, CAST(event_id % 89 AS BIGINT) AS k FROM events WHERE event_id % 11 = 0) SELECT id FROM g WHERE EXISTS (SELECT 1 FROM c WHERE c.r BETWEEN g.r0 AND g.r1 AND c.k BETWEEN g.c0 AND g.c1)")
def join_dirty_areas(spark, d):
    """Areas that hold a changed cell."""
    events = read(spark, d, "events")
    events.createOrReplaceTempView("tessera_events")
    areas = spark.sql(RANGES.replace("FROM events", "FROM tessera_events")).select("id", F.lit("s").alias("sheet"), "c0", "r0", "c1", "r1")
    cells = events.filter("event_id % 11 = 0").select(F.lit("s").alias("sheet"), (F.col("event_id") % 97).alias("row"), (F.col("event_id") % 89).alias("col"))
    return matching.touched(areas, cells)


@query("SELECT user_id, event_id AS label, kind, CASE WHEN kind = 'endnote' THEN 'e' ELSE '' END || row_number() OVER (PARTITION BY user_id, kind ORDER BY pos, event_id) AS number FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'endnote' ELSE 'footnote' END AS kind, event_id % 101 AS pos FROM events WHERE value > 20)")
def join_notes(spark, d):
    events = read(spark, d, "events").withColumnRenamed("event_id", "label")
    uses = events.filter("value > 20").select("user_id", "label", (F.col("label") % 101).alias("pos"))
    notes = events.select("user_id", "label", F.when(F.col("event_type") == "click", "endnote").otherwise("footnote").alias("kind"), F.col("props").alias("text"))
    return matching.numbered_notes(uses, notes, "user_id").select("user_id", "label", "kind", "number")


@query(f"""WITH {VERSIONS} SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'add' WHEN n.s_suppkey IS NULL THEN 'drop' ELSE 'change' END AS op, n.s_acctbal AS s_acctbal FROM old o FULL JOIN new n ON o.s_suppkey = n.s_suppkey WHERE o.s_suppkey IS NULL OR n.s_suppkey IS NULL OR o.s_acctbal <> n.s_acctbal""")
def join_reconcile(spark, d):
    old = read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = old.select(F.when(F.col("s_suppkey") % 13 == 0, F.col("s_suppkey") + 100000).otherwise(F.col("s_suppkey")).alias("s_suppkey"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return matching.reconciled(old, new, ["s_suppkey"], ["s_acctbal"])


@query("SELECT user_id, event_type AS fp, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS landed, CAST(count(*) FILTER (WHERE event_id % 3 <> 0 AND event_type <> 'click') AS BIGINT) AS orphaned, CAST(count(*) FILTER (WHERE event_id % 3 <> 0 AND event_type = 'click') AS BIGINT) AS lost FROM (SELECT * FROM events WHERE event_type <> 'click' OR event_id % 3 <> 0) GROUP BY user_id, event_type")
def agg_outcomes(spark, d):
    rows = read(spark, d, "events").filter("event_type <> 'click' or event_id % 3 <> 0").select("user_id", F.col("event_type").alias("fp"), F.col("event_id").alias("path"))
    return matching.tally(rows, rows.filter("path % 3 = 0"), ["user_id", "fp"])


@query("SELECT a.turn AS old, b.turn + 2 AS new, a.conv_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def map_compose(spark, d):
    """What one step and the next keep."""
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("old"))
    return entries.composed(rows.withColumn("new", F.col("old") + 1), rows.withColumn("new", F.col("old") + 2), "conv_id").select("old", "new", "conv_id")


@query("SELECT user_id, event_id, max(event_id % 101) OVER (PARTITION BY user_id ORDER BY event_id) AS to_start FROM events")
def place_in_order(spark, d):
    rows = read(spark, d, "events").select("user_id", F.lit(1).alias("para"), F.col("event_id").alias("start"), F.lit(0).alias("seq"), F.lit(1).alias("to_para"), (F.col("event_id") % 101).alias("to_start"))
    return entries.in_order(rows, "user_id").select("user_id", F.col("start").alias("event_id"), "to_start")


@query("SELECT user_id, event_id, value <= 50 AND sum(CASE WHEN value <= 50 THEN v ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) <= 300000 AS shown FROM (SELECT user_id, event_id, value, CAST(round(value * 1000) AS BIGINT) AS v FROM events)")
def agg_picture_budget(spark, d):
    rows = read(spark, d, "events").select("user_id", F.col("event_id").alias("page"), F.lit(0).alias("seq"), F.round(F.col("value") * 1000).cast("long").alias("bytes"))
    return entries.within_budget(rows, "user_id", 50_000, 300_000).select("user_id", F.col("page").alias("event_id"), "shown")


@query("SELECT user_id AS sheet, min(event_id % 97) AS c0, min(event_id % 1009) AS r0, max(event_id % 97) AS c1, max(event_id % 1009) AS r1 FROM events GROUP BY user_id")
def agg_used_range(spark, d):
    return sheets.used_ranges(read(spark, d, "events").select(F.col("user_id").alias("sheet"), (F.col("event_id") % 97).alias("col"), (F.col("event_id") % 1009).alias("row")))


@query(f"WITH g AS ({RANGES}), c AS (SELECT event_id, user_id % 50 AS sheet, (event_id * 7) % 1009 AS r, (event_id * 5) % 97 AS k FROM events) SELECT event_id FROM c WHERE EXISTS (SELECT 1 FROM g WHERE g.sheet = c.sheet AND c.r BETWEEN g.r0 AND g.r1 AND c.k BETWEEN g.c0 AND g.c1 AND NOT (c.r = g.r0 AND c.k = g.c0))")
def val_merge_cover(spark, d):
    """Cells that a merge covers."""
    events = read(spark, d, "events")
    events.createOrReplaceTempView("tessera_events")
    merges = spark.sql(RANGES.replace("FROM events", "FROM tessera_events"))
    cells = events.select("event_id", (F.col("user_id") % 50).alias("sheet"), (F.col("event_id") * 7 % 1009).alias("row"), (F.col("event_id") * 5 % 97).alias("col"))
    return sheets.covered(cells, merges).select("event_id")


@query()
def txt_tracked(spark, d):
    rows = turns(spark, d).filter("text1 is not null").select("conv_id", "turn", F.col("text").alias("old"), F.col("text1").alias("new"))
    return entries.tracked(rows.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "engine", "id")


@query("WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) SELECT doc_id, 1 AS id, 'placed' AS status, 7 AS start, CAST(least(n, 100) + 7 AS INTEGER) AS \"end\" FROM n UNION ALL SELECT doc_id, 2, 'placed', CAST(greatest(n - 100, 0) + 7 AS INTEGER), CAST(n + 7 AS INTEGER) FROM n")
def place_entries(spark, d):
    """Every document's first and last hundred letters, through an edit that puts a word before the text."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    marks = F.array(F.struct(F.lit(1).alias("id"), F.lit(0).alias("start"), F.least(n, F.lit(100)).alias("end")), F.struct(F.lit(2).alias("id"), F.greatest(n - 100, F.lit(0)).alias("start"), n.alias("end")))
    rows = docs.select("doc_id", F.explode(marks).alias("x")).select("doc_id", "x.*")
    return entries.placed(rows, docs.select("doc_id", F.col("text").alias("old"), F.concat(F.lit("Again: "), F.col("text")).alias("new")))


DIGIT = "substr('0123456789abcdefghijklmnopqrstuv', CAST(h // {0} % 32 AS INTEGER) + 1, 1)"


@query(f"SELECT doc_id, seq, fp, 'k' || {DIGIT.format(1)} || {DIGIT.format(32)} || {DIGIT.format(1024)} || {DIGIT.format(32768)} || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS keep_id FROM (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_returnflag AS fp, {FNV.format('l_returnflag')} AS h, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem)")
def keep_ids(spark, d):
    return entries.keep_ids(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("fp")))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_returnflag")
def flagship(spark, d):
    """A calculated column, then SUMIFS by flag."""
    net = formula.fill(read(spark, d, "lineitem"), "net", "=[@l_extendedprice]*(1-[@l_discount])")
    return net.groupBy("l_returnflag").agg(F.round(F.sum("net"), 2).alias("total"))
