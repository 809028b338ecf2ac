"""Runs of equal values by blocks of positions: those of one numbering, repeated and null rows too."""

from tessera.operators import windows


def test_islands_by_blocks(spark):
    rows = [(1, "a", p) for p in (0, 1, 2, 3, 4, 7, 8, 8, 9, 12, None)] + [(1, None, p) for p in (3, 4, 5)] + [(None, "b", 4), (None, "b", 5)]
    df = spark.createDataFrame(rows, "k int, v string, pos long")
    whole = sorted(map(tuple, windows.islands(df, ["k"], "pos", ["v"]).collect()), key=str)
    assert whole == sorted(map(tuple, windows.islands(df, ["k"], "pos", ["v"], 4).collect()), key=str)
    some = df.filter("pos is not null and v is not null")
    got = {(r.k, r.v): r.rows for r in windows.inverted_index(some, "v", ["k"], block=4).collect()}
    assert got == {(1, "a"): "0:4, 7:8, 8:9, 12", (None, "b"): "4:5"}
    plan = windows.islands(df, ["k"], "pos", ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(k#" in plan and all("block_#" in x for x in plan.split("\n") if "row_number() windowspec" in x)
