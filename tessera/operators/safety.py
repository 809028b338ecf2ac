"""Safety scans: what a page, a relationship or a formula would fetch, run or hide, as notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.formula import FETCH

# Rules of pages: kind, what happens to it, pattern.
RULES = (
    ("script", "neutralised", r"(?i)<script\b"),
    ("remote_image", "neutralised", r"(?i)<img\b[^>]*\bsrc\s*=\s*[\"']?https?:"),
    ("frame", "neutralised", r"(?i)<(?:iframe|object|embed)\b"),
    ("event_handler", "neutralised", r"(?i)\son[a-z]+\s*=\s*[\"']"),
    ("comment", "surfaced", r"<!--"),
    ("hidden", "surfaced", r"(?i)display\s*:\s*none|\bhidden\b"),
    ("external_link", "surfaced", r"(?i)\bhref\s*=\s*[\"']?https?:"),
)
# Relationship types of packages that are taken out, and why.
REMOVED_TYPES = {"vbaProject": "macro", "oleObject": "ole", "control": "activex", "attachedTemplate": "template", "externalLink": "external", "connections": "connection", "queryTable": "query"}


def notices(docs: DataFrame, by: str, text: str, rules: tuple = RULES) -> DataFrame:
    """(by, kind, phase, n): a row for each rule that a text meets, with how often. One pass of the text a rule, no join."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("phase"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r)).cast("long").alias("n")) for k, p, r in rules])
    return docs.select(by, F.explode(found).alias("x")).select(by, "x.*").filter("n > 0")


def relationship_notices(rels: DataFrame) -> DataFrame:
    """rels (part, id, type, target, external) with notice: null where it may stay."""
    kinds = F.create_map(*[F.lit(x) for kv in sorted(REMOVED_TYPES.items()) for x in kv])
    return rels.withColumn("notice", F.coalesce(F.try_element_at(kinds, "type"), F.when(F.col("external") & (F.col("type") != "hyperlink"), "external")))


def unsafe_formula(formula: Column) -> Column:
    """The first fetching function of a formula's text outside string literals, DDE, or null."""
    bare = F.upper(F.regexp_replace(formula, r'"(?:[^"]|"")*"', '""'))
    names = "|".join(n.replace(".", r"\.") for n in sorted(FETCH, key=len, reverse=True))
    name = F.regexp_extract(bare, rf"(?:^|[^A-Z0-9_.])({names})\s*\(", 1)
    return F.when(name != "", name).when(bare.rlike(r"[A-Z]+\|'?[^!]+'?!"), "DDE")


def gate(notices_: DataFrame, acknowledged: bool) -> DataFrame:
    """(by, allowed): an export goes out only if nothing was surfaced, or that is acknowledged."""
    by = notices_.columns[0]
    return notices_.groupBy(by).agg((F.lit(acknowledged) | (F.count_if(F.col("phase") == "surfaced") == 0)).alias("allowed"))


# Severities of quality codes.
SEVERITY = {"missing": "error", "overflow": "error", "substituted": "warning", "approximated": "info"}


def quality_report(diagnostics: DataFrame, by: str, code: str, strict: bool = False) -> DataFrame:
    """(by, errors, warnings, infos, status): refused under strict with an error, else degraded or as is."""
    sev = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(SEVERITY.items()) for x in kv]), code)
    n = lambda s: F.count_if(sev == s).alias(f"{s}s")
    out = diagnostics.groupBy(by).agg(n("error"), n("warning"), n("info"))
    return out.withColumn("status", F.when((F.col("errors") > 0) & F.lit(strict), "refused").when(F.col("errors") + F.col("warnings") > 0, "degraded").otherwise("as is"))
