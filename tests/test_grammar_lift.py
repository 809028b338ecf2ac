"""Lifted styles: where each stands, that they come back, and that cells aren't shuffled property by property."""

from tessera.book_queries import styled
from tessera.operators import grammar


def test_lift_and_spread_of_uneven_rows(spark):
    cells = spark.createDataFrame(
        [(1, 1, 1, {"a": "x", "b": "y"}), (1, 1, 2, {"a": "x", "b": "y", "c": "z"}), (1, 2, 1, {"a": "x", "b": "n"}), (1, 3, 1, None), (2, 1, 1, {"a": "x"}), (2, None, 1, {"a": "x"}), (None, 1, 1, {"a": "x"})],
        "doc_id int, row int, col int, style map<string,string>",
    )
    got = sorted(map(tuple, grammar.lifted(cells).collect()), key=str)
    row1 = [(1, "row", 1, None, "a", "x"), (1, "row", 1, None, "b", "y"), (1, "cell", 1, 2, "c", "z"), (1, "row", 2, None, "a", "x"), (1, "row", 2, None, "b", "n")]
    assert got == sorted([*row1, (2, "table", None, None, "a", "x"), (None, "cell", 1, 1, "a", "x")], key=str)
    back = {tuple(r) for r in grammar.spread(grammar.lifted(cells), cells).collect()}
    assert back == {(r.doc_id, r.row, r.col, k, v) for r in cells.collect() if r.doc_id is not None for k, v in (r.style or {}).items()}


def test_lift_moves_rows_once(spark, sf):
    plan = grammar.lifted(styled(spark, sf))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if " Exchange hashpartitioning(" in x]
    assert len(exchanges) <= 2 and all("hashpartitioning(doc_id#" in x for x in exchanges), plan
