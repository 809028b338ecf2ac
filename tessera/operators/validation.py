"""Checks of cells: lists, numbers, dates and lengths; what isn't evaluated says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators of bounds.
OPERATORS = ("between", "notBetween", "equal", "notEqual", "greaterThan", "lessThan", "greaterThanOrEqual", "lessThanOrEqual")


def bounded(x: Column, operator: str, low: Column, high: Column | None = None) -> Column:
    high = low if high is None else high
    return {
        "between": (x >= low) & (x <= high), "notBetween": (x < low) | (x > high), "equal": x == low, "notEqual": x != low,
        "greaterThan": x > low, "lessThan": x < low, "greaterThanOrEqual": x >= low, "lessThanOrEqual": x <= low,
    }[operator]


def verdict(value: Column, ok: Column) -> Column:
    """ok, bad, or skipped for an empty cell."""
    return F.when(value.isNull(), "skipped").when(ok, "ok").otherwise("bad")


def in_list(value: Column, items: list[str]) -> Column:
    """Trimmed, ignoring ASCII case."""
    return verdict(value, F.lower(F.trim(value)).isin([i.strip().lower() for i in items]))


def whole(value: Column, operator: str, low: Column, high: Column | None = None) -> Column:
    return verdict(value, (value % 1 == 0) & bounded(value, operator, low, high))


def decimal(value: Column, operator: str, low: Column, high: Column | None = None) -> Column:
    return verdict(value, bounded(value, operator, low, high))


date = decimal


def text_length(value: Column, operator: str, low: Column, high: Column | None = None) -> Column:
    return verdict(value, bounded(F.char_length(value), operator, low, high))


def unchecked(value: Column) -> Column:
    """Custom and time rules, and bounds that are formulas."""
    return F.when(value.isNull(), "skipped").otherwise("unchecked")


def fits(value: Column, kind: str) -> Column:
    """Whether a cell struct may stand in a column of a type."""
    from tessera.functions.values import iso_date

    tag = value["tag"]
    rule = {"number": tag == "number", "text": tag == "text", "date": (tag == "text") & iso_date(value["str"]).isNotNull(), "mixed": F.lit(True)}[kind]
    return (tag == "empty") | rule


def bad_name(name: Column) -> Column:
    """A sheet's name with over 31 characters, none, a forbidden one, or the looks of a cell."""
    return (F.char_length(name) > 31) | (F.char_length(name) == 0) | name.rlike(r"[\[\]:*?/\\]") | name.rlike(r"^[A-Za-z]{1,3}[0-9]+\z")
