"""Mixing sources to target weights by the cube method: how often each whole document is taken."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import GAP, keeps_columns, whole, written

#: A source's words are taken this often at most.
MOST = 3.0
#: Documents whose probabilities move together in one task.
CHUNK = 4096
SURE = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, k): size in words; k is the same for equal (doc_id, source, text)."""
    text = whole(F.col("text"))
    size = F.size(F.split(text, GAP, -1)) - F.when(text.rlike(rf"^{GAP}"), 1).otherwise(0) - F.when(text.rlike(rf"{GAP}\z"), 1).otherwise(0)
    size = F.when(text.rlike(r"[^\x20\x09-\x0D]"), size).otherwise(0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), key().alias("k"))


def key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"))


def shares(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets by weight of the sum of sizes, none above most times its size; what is above is shared anew by weight."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_ and left > 0:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if level * weights[i] < most * sizes[i]]
    return target


def flight(pi: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The cube method's flight phase: moves probabilities within [0, 1] along directions that keep both the sum of
    size * pi and the sum of pi, until two at most are neither 0 nor 1 (more only if all the open sizes are equal: one).
    """
    pi, still = pi.copy(), []
    for k in range(len(pi)):
        if SURE < pi[k] < 1 - SURE:
            still.append(k)
        while len(still) >= 3 or len(still) == 2 and size[still[0]] == size[still[1]]:
            if len(still) == 2:
                idx, u = still, (1.0, -1.0)
            else:
                idx = still
                a, b, c = (float(size[i]) for i in idx)
                u = (b - c, c - a, a - b)  # orthogonal to (a, b, c) and to (1, 1, 1)
                if u == (0.0, 0.0, 0.0):
                    u = (1.0, -1.0, 0.0)
            up = min([((1 - pi[i]) if x > 0 else pi[i]) / abs(x) for i, x in zip(idx, u, strict=True) if x])
            down = min([(pi[i] if x > 0 else (1 - pi[i])) / abs(x) for i, x in zip(idx, u, strict=True) if x])
            step = up if draw.random() * (up + down) < down else -down
            for i, x in zip(idx, u, strict=True):
                pi[i] = min(1.0, max(0.0, pi[i] + step * x))
            still = [i for i in idx if SURE < pi[i] < 1 - SURE]
    return np.where(pi >= 1 - SURE, 1.0, np.where(pi <= SURE, 0.0, pi))


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last few probabilities: of all choices, the one nearest to their sum of words, then of documents."""
    open_ = [k for k in range(len(pi)) if 0 < pi[k] < 1]
    words, docs = sum(pi[k] * size[k] for k in open_), sum(pi[k] for k in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(open_) if m >> j & 1) - words), abs(m.bit_count() - docs), m))
    out = pi.copy()
    for j, k in enumerate(open_):
        out[k] = best >> j & 1
    return out


def _fly(seed: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "doc_id", "size"], kind="stable")
        pi, size = pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float)
        pi = flight(pi, size, np.random.default_rng([seed, abs(int(pdf["k"].iloc[0]))]))
        pdf["pi"] = landing(pi, size) if land else pi
        return pdf

    return run


def source_targets(counts: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """counts (source, source_size, n) -> the same with target. Sources stand by code point, null last; weights repeat.

    One row a source goes to the driver: sources are named in a catalogue, they don't grow with the documents.
    """
    rows = sorted(counts.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = shares([r.source_size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    return counts.sparkSession.createDataFrame([(r.source, int(r.source_size), int(r.n), float(t)) for r, t in zip(rows, targets, strict=True)], "source string, source_size long, n long, target double")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, k), one row for each row of docs.

    Every document of a source has the same expected number of copies, target / source_size. The whole part is sure;
    the rest is an inclusion probability. Probabilities fly in chunks of a source (a hot source has many), balanced
    on words and on documents; the two at most that each chunk leaves open fly again together, chunk by chunk, until
    a source's rest fits one chunk, which flies and lands. Random numbers follow from seed and the rows, so reruns agree.
    A null text has size 0, a null source is a source, repeated rows count each, a very long text is one document with its
    whole size. docs needs doc_id, source and text; other columns, whatever their names, are not read. Of two choices as
    near to a source's target the one nearer in documents is taken. Empty tables give empty ones.
    """
    rows = written(sized(docs), "sized")
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = F.broadcast(source_targets(counts, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = rows.withColumnRenamed("source", "own")
    open_ = named.join(plan, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("rate", rate)
    base = F.floor(F.col("rate") + SURE)
    open_ = open_.withColumn("base", base.cast("long")).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - base)).drop("rate")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema) + ", cell long"
    done, level = None, 0
    while True:
        # n open rows of a source go to n / chunk cells, drawn by hash; a level leaves two at most of each cell.
        cells = F.ceil(F.col("n") / F.lit(chunk))
        dealt = open_.withColumn("cell", F.pmod(F.xxhash64("k", F.lit(level)), cells).cast("long"))
        most_n = open_.agg(F.max("n")).first()[0]
        last = most_n is None or most_n <= chunk
        flown = written(dealt.groupBy("source", "cell").applyInPandas(_fly(seed + level, last), schema).drop("cell"), "flown")
        sure = flown.filter("pi in (0.0, 1.0)")
        done = sure if done is None else done.unionByName(sure)
        if last:
            break
        level += 1
        # Within a level a source that is down to one cell is not landed before the last level; its rest is carried on.
        rest = flown.filter("pi not in (0.0, 1.0)")
        left = rest.groupBy("source").agg(F.count("*").alias("m")).withColumnRenamed("source", "own")
        open_ = rest.join(F.broadcast(left), F.col("own").eqNullSafe(F.col("source"))).withColumn("n", F.col("m")).drop("own", "m")
    copies = (F.col("base") + F.col("pi")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "k")


@keeps_columns("doc_id", "source", "text")
def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as mix() takes it. Equal rows (same doc_id, source and text) are interchangeable.

    All columns keep their names and values. Nulls, repeated rows, very long texts and empty tables: see mix.
    """
    by_key = mix(docs, weights, most, seed).groupBy("k").agg(F.sum("copies").alias("copies_"))
    by_key = by_key.filter("copies_ > 0").withColumnRenamed("k", "key_")
    # equal rows become one before they move; the join keeps their partitioning, so texts move once
    once = docs.withColumn("key_", key()).dropDuplicates(["key_"]).join(by_key, "key_")
    return once.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_"))))
