"""Approximate nearest neighbours by shifted space-filling curves, with an optional exact check of what they found."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, written

#: Orderings, projected dimensions and bits of each: a key has DIMS * LEVELS = 60 bits.
CURVES, DIMS, LEVELS = 4, 6, 10
#: Rows of a block of an ordering, but on small tables, where an ordering has SPLIT blocks; blocks of an ordering at most
#: (their centres go to every executor: 32768 x dims doubles).
BLOCK, SPLIT, BLOCKS = 2048, 16, 1 << 15
#: Queries that one task holds, about; more queries of a block are dealt to tasks of their own.
ASKS = 1024


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dims), each coordinate of so many bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(levels - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(v: np.ndarray, curve: int, scale: float, seed: int) -> np.ndarray:
    """Each curve has its own orthonormal projection and its own shift of the grid."""
    draw = np.random.default_rng([seed, curve])
    width = min(DIMS, v.shape[1])
    axes = np.linalg.qr(draw.standard_normal((v.shape[1], width)))[0]
    shift = draw.random(width)
    # Projected coordinates spread about scale / sqrt(dims); four such to either side fill half of the shifted grid.
    with np.errstate(over="ignore", invalid="ignore"):
        unit = (v @ axes) * (math.sqrt(v.shape[1]) / (8 * scale)) * 0.5 + 0.25 + shift * 0.5
    return hilbert(np.clip(np.nan_to_num(unit * (1 << LEVELS)), 0, (1 << LEVELS) - 1).astype(np.int64))


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>), a row for each id: the least of its vectors, if it has several.

    Rows without an id and null, empty or zero vectors and such as hold null, NaN or infinity are left out, and then all
    that aren't of the commonest length (of two as common the longer), as there is no distance between lengths.
    """
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine).filter(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("v") == (width.width if width else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _keyed(batches: Iterator[pa.RecordBatch], scale: float, curves: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
        for c in range(curves):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(v, c, scale, seed)), batch.column(0)], ["curve", "ckey", "vec_id"])


def nearest(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of each query's k nearest other candidates, ties to the smaller id. Distances are
    summed from the differences in double precision; a product of matrices only leaves out what is clearly farther."""
    own, ids, far = [], [], []
    with np.errstate(over="ignore", invalid="ignore"):  # squares may go beyond a double: such distances are infinite
        norms = np.einsum("ij,ij->i", c, c)
        most = norms.max(initial=0)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            rough = np.nan_to_num(norms - 2 * part @ c.T + np.einsum("ij,ij->i", part, part)[:, None], nan=np.inf, posinf=np.inf)
            itself = q_id[at : at + 256][:, None] == c_id
            rough[itself] = np.inf
            edge = np.partition(rough, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            slack = 1e-9 * (1 + np.abs(edge)) + 1e-12 * most
            for i in range(len(part)):
                near = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & ~itself[i])
                d = np.sqrt(np.cumsum((c[near] - part[i]) ** 2, axis=1)[:, -1])  # from the first component to the last
                best = np.lexsort((c_id[near], d))[:k]
                own.append(np.full(len(best), q_id[at + i]))
                ids.append(c_id[near][best])
                far.append(d[best])
    return (np.concatenate(own), np.concatenate(ids), np.concatenate(far)) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


FOUND = "query_id long, vec_id long, score double"


def _scan_block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["ask"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v, ids = np.stack(pdf["v"].to_numpy()).astype(float), pdf["vec_id"].to_numpy(np.int64)
        own, got, far = nearest(ids[asks], v[asks], ids[~asks], v[~asks], k)
        return pd.DataFrame({"query_id": own, "vec_id": got, "score": far})

    return run


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        mid = v.mean(axis=0)
        radius = np.sqrt(((v - mid) ** 2).sum(axis=1)).max()
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "mid": [mid], "radius": [float(radius)]})


def _open_blocks(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, mids: np.ndarray, radii: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each query the blocks that may hold a nearer row than its k-th so far, but for those it has seen."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q, seen, edge = np.stack(batch.column(1).to_numpy(zero_copy_only=False)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            away = np.sqrt(np.maximum(0, (mids**2).sum(1) - 2 * q @ mids.T + (q**2).sum(1)[:, None])) - radii
            closed = away > edge[:, None] * (1 + 1e-9) + 1e-6  # what can't be told stays open
        i, j = np.nonzero(~closed & (np.abs(blocks - seen[:, None]) > 1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(blocks[j])], ["vec_id", "block"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of a query, by sorting its few found rows (k a block scanned) in one array."""
    best = F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best"))


def search(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = CURVES, block: int | None = None, check: bool = True, seed: int = 5, asks: int = ASKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others found for each row whose vec_id is divisible by every.

    vectors needs vec_id and embedding; other columns are not read. See valid for what takes part. All that do are
    indexed: each of the curves sorts their Hilbert keys (then ids, so that equal vectors can be dealt out) by ranges,
    without the vectors, and cuts the order into blocks by rank. A query takes its own block and the one on either side
    on every curve; the union is reranked by the true distance. With check, the k-th distance so found bounds a second
    look: blocks of the first curve whose centre is no farther than it plus the block's radius are scanned too, so that
    results are exact. Without it, recall follows from the data: near 1 where vectors lie in clusters, low for points
    spread evenly on a sphere. Rows that repeat an id and its vector are one row. Equal distances, infinite ones (beyond
    a double) among them, go by the smaller id. Fewer than k others: all of them. Empty: empty.
    """
    rows = written(valid(vectors), "vectors")
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    n, scale = rows.agg(F.count("*"), F.percentile_approx(F.when(norm < float("inf"), norm), 0.5)).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    block = max(block or max(64, min(BLOCK, n // SPLIT)), math.ceil(n / BLOCKS))
    keyed = rows.mapInArrow(partial(_keyed, scale=scale or 1.0, curves=curves, seed=seed), "curve int, ckey long, vec_id long")
    parts = partitions(rows.sparkSession)
    ordered = keyed.repartitionByRange(parts, "curve", "ckey", "vec_id").sortWithinPartitions("curve", "ckey", "vec_id").withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.select("curve", "vec_id", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ordered = written(ordered, "ordered")
    runs = sorted((r.curve, r.part, r.least, r.n) for r in ordered.groupBy("curve", "part").agg(F.min("at").alias("least"), F.count("*").alias("n")).collect())
    starts, total = [], {}
    for c, p, least, m in runs:  # a few for each partition
        starts.append((c, p, total.get(c, 0) - least))
        total[c] = total.get(c, 0) + m
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "curve int, part int, start long"))
    ranked = ordered.join(offsets, ["curve", "part"]).select("curve", "vec_id", F.floor((F.col("at") + F.col("start")) / block).alias("block")).join(rows, "vec_id")
    own = written(ranked.filter(F.col("vec_id") % every == 0), "asks")

    def scanned(asked: DataFrame) -> DataFrame:
        """asked (curve, block, vec_id, v) against all rows of those blocks. A block's rows go to as many tasks as its
        queries need; there are curves * BLOCKS blocks at most."""
        tasks = F.broadcast(asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / asks).alias("tasks")))
        have = ranked.join(tasks, ["curve", "block"]).select("curve", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "vec_id", "v", F.lit(False).alias("ask"))
        want = asked.join(tasks, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("vec_id"), "tasks").alias("task"), "vec_id", "v", F.lit(True).alias("ask"))
        return have.unionByName(want).groupBy("curve", "block", "task").applyInPandas(_scan_block(k), FOUND)

    near = F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1))
    found = scanned(own.select("curve", near.alias("block"), "vec_id", "v"))
    if check:
        found = written(found, "found")
        centres = ranked.filter("curve = 0").groupBy("block").applyInPandas(_centre, "block long, mid array<double>, radius double").collect()
        stats = np.array([r.block for r in centres]), np.array([r.mid for r in centres]), np.array([r.radius for r in centres])
        edge = _top(found, k).select(F.col("query_id").alias("vec_id"), F.when(F.size("best") == k, F.element_at("best", -1)["score"]).otherwise(F.lit(float("inf"))).alias("edge"))
        first = own.filter("curve = 0").join(edge, "vec_id", "left").select("vec_id", "v", "block", F.coalesce("edge", F.lit(float("inf"))).alias("edge"))
        more = written(first.mapInArrow(partial(_open_blocks, blocks=stats[0], mids=stats[1], radii=stats[2]), "vec_id long, block long"), "open")
        asked = more.join(own.filter("curve = 0").select("vec_id", "v"), "vec_id").withColumn("curve", F.lit(0))
        found = found.unionByName(scanned(asked))
    best = _top(found, k).select("query_id", F.posexplode("best").alias("p", "b"))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
