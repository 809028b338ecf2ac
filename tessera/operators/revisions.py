"""An append-only log of revisions: history, heads, and writes that name a revision that is no longer the head."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lazy import arrow_udf


def history(log: DataFrame, doc: str = "doc_id", rev: str = "rev") -> DataFrame:
    """log with parent: the revision before, null for the first."""
    return log.withColumn("parent", F.lag(rev).over(Window.partitionBy(doc).orderBy(rev)))


def heads(log: DataFrame, doc: str = "doc_id", rev: str = "rev", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, head, revisions, keep) of each document."""
    return log.groupBy(doc).agg(F.max(rev).alias("head"), F.count("*").alias("revisions"), *[F.max_by(c, rev).alias(c) for c in keep])


def stale(log: DataFrame, base: DataFrame, doc: str = "doc_id", rev: str = "rev", op: str = "op") -> DataFrame:
    """base (doc, base) -> (doc, base, head, later, stale): a write is stale if any revision after its base is something
    else than a re-import."""
    both = log.join(base, doc)
    return both.groupBy(doc, "base").agg(
        F.max(rev).alias("head"), F.count_if(F.col(rev) > F.col("base")).alias("later"), F.coalesce(F.bool_or((F.col(rev) > F.col("base")) & (F.col(op) != "reimport")), F.lit(False)).alias("stale")
    )


def commit(spark, path: str, rows: DataFrame) -> None:
    """Appends revisions; a reader sees none or all, as Parquet's committer renames whole files."""
    rows.write.mode("append").parquet(path)


def fnv1a(data: bytes) -> int:
    """FNV-1a of 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_of(texts: pd.Series) -> np.ndarray:
    """FNV-1a of texts' UTF-8, all texts a byte at a time: those of like lengths go together, so steps are few."""
    raw = [(x or "").encode() for x in texts]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    live, prime = len(order), np.uint64(0x100000001B3)
    for k in range(int(size.max(initial=0))):
        while live and size[order[live - 1]] <= k:
            live -= 1
        if live < 8:  # a few long texts left: each by itself
            for i in order[:live]:
                h = int(out[i])
                for b in raw[i][k:]:
                    h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                out[i] = h
            break
        at = order[:live]
        out[at] = (out[at] ^ flat[begin[at] + k]) * prime
    return out


@arrow_udf("string")
def digest(text: pd.Series) -> pd.Series:
    """FNV-1a of a text's UTF-8 as 16 hexadecimal digits. Arrow batches: the columns' integers can't wrap around."""
    return pd.Series([f"{h:016x}" for h in fnv1a_of(text).tolist()])
