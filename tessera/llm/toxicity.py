"""Toxicity: a classifier chain. Categories are predicted one after another, each with the earlier ones' probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import portions, written

#: The chain: unreadable text, toxic text, toxic text that reads well. The second decides.
CATEGORIES = ("junk", "toxic", "abusive")
#: Labelled rows that the linear models are fitted on, about, at most; words that are features; folds.
TRAIN_ROWS, WORDS, FOLDS = 20_000, 512, 3
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """The different runs of letters of a whole text, in lower case."""
    return set(WORD.findall((text or "").lower()))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text", 16 << 20):
            n: Counter = Counter()
            bad: list[Counter] = [Counter() for _ in CATEGORIES]
            flags = [part.column(1 + k).to_pylist() for k in range(len(CATEGORIES))]
            for i, text in enumerate(part.column(0).to_pylist()):
                own = terms(text)
                n.update(own)
                for k, c in enumerate(bad):
                    if flags[k][i]:
                        c.update(own)
            words = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), *(pa.array([c[w] for w in words], pa.int64()) for c in bad)], ["word", "n", *CATEGORIES])


def _rows(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    place = {w: i for i, w in enumerate(words)}
    for batch in batches:
        have = [sorted(place[w] for w in terms(x) & place.keys()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(have, pa.list_(pa.int32()))], ["doc_id", *CATEGORIES, "have"])


def drawn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, junk, toxic, abusive) of about train_rows labelled documents, drawn by hash.

    Contradictory labels count as bad. As the draw is bounded, it is sent to the documents; no text is shuffled.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min(F.coalesce("quality", F.lit(1))).alias("q"))
    share = 1_000_000 * min(1.0, train_rows / max(1, labels.count()))
    flags = one.select("doc_id", (F.col("q") == 0).alias("junk"), (F.col("t") == 1).alias("toxic"), ((F.col("t") == 1) & (F.col("q") == 1)).alias("abusive"))
    flags = flags.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < F.lit(share))
    return docs.select("doc_id", "text").join(F.broadcast(flags), "doc_id")


def features(rows: DataFrame, words: int = WORDS) -> list[str]:
    """The words that tell most, by each category's chi-squared over the drawn documents. A word's counts are summed
    over the cluster; just the chosen words reach the driver."""
    counts = written(rows.select("text", *CATEGORIES).mapInArrow(_word_counts, "word string, n long, " + ", ".join(f"{c} long" for c in CATEGORIES)).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *CATEGORIES)]).filter("n >= 5"), "terms")
    total = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in CATEGORIES]).first()
    chosen: dict[str, None] = {}
    for c in CATEGORIES:
        share = (total[c] or 0) / max(1, total.n)
        if 0 < share < 1:
            z = (F.col(c) - F.col("n") * F.lit(share)) / F.sqrt(F.col("n") * F.lit(share * (1 - share)))
            chosen |= dict.fromkeys(r.word for r in counts.orderBy(F.desc(F.abs(z)), "word").limit(words // len(CATEGORIES)).collect())
    return list(chosen)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression (last weight: the constant) by accelerated gradient descent, in single precision."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    u = np.ones(x.shape[1], np.float32)
    for _ in range(15):  # the greatest eigenvalue, for the step
        u = x.T @ (x @ u)
        top = np.linalg.norm(u)
        u /= max(top, 1e-9)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / (1.05 * top + 4 * ridge))
    for k in range(rounds):
        slope = x.T @ (sigmoid(x @ v) - y) + np.float32(ridge) * np.append(v[:-1], np.float32(0))
        new = v - step * slope
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


class Chain:
    """Linear models, one a category; each is trained with the out-of-fold predictions of the ones before it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        self.models, seen = [], x
        for c in range(y.shape[1]):
            out = np.zeros(len(x), np.float32)
            for f in range(FOLDS):
                out[fold == f] = apply(fit(seen[fold != f], y[fold != f, c]), seen[fold == f])
            self.models.append(fit(seen, y[:, c]))
            if c == CATEGORIES.index("toxic"):
                self.cut = best_cut(out, y[:, c])
            seen = np.hstack([seen, out[:, None]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w in self.models:
            p = apply(w, x).astype(np.float32)
            out.append(p)
            x = np.hstack([x, p[:, None]])
        return np.stack(out, axis=1)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 of out-of-fold predictions, midway between the two scores at it."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    words, chain = model.value
    place = {w: i for i, w in enumerate(words)}
    keys = place.keys()
    for batch in batches:
        for part in portions(batch, "text", 16 << 20):
            x = np.zeros((part.num_rows, len(words)), np.float32)
            for i, text in enumerate(part.column(1).to_pylist()):
                for w in terms(text) & keys:
                    x[i, place[w]] = 1
            p = chain.predict(x).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, CATEGORIES.index("toxic")] >= chain.cut)], ["doc_id", *[f"p_{c}" for c in CATEGORIES], "is_toxic"])


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, p_junk, p_toxic, p_abusive, is_toxic) for each row of docs, from its whole text.

    Words, models and threshold (that of the best F1 out of fold) are fitted on about train_rows labelled documents,
    drawn by hash: the bound that classifiers may have. docs needs doc_id and text, other columns, whatever their names,
    are not read. Nulls are empty texts; very long ones are read whole; repeated rows are alike; a probability at the
    threshold is toxic; without labels of both kinds nothing is (probabilities 0). An empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(drawn(own, labels, train_rows), "drawn")
    words = features(rows)
    if not words:
        return own.select("doc_id", *[F.lit(0.0).alias(f"p_{c}") for c in CATEGORIES], F.lit(False).alias("is_toxic"))
    t = rows.mapInArrow(partial(_rows, words=words), "doc_id long, " + ", ".join(f"{c} boolean" for c in CATEGORIES) + ", have array<int>").toArrow().sort_by("doc_id")
    x = np.zeros((t.num_rows, len(words)), np.float32)
    for i, have in enumerate(t["have"].to_pylist()):
        x[i, have] = 1
    y = np.stack([t[c].to_numpy().astype(np.float32) for c in CATEGORIES], axis=1)
    fold = (t["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    model = spark.sparkContext.broadcast((words, Chain(x, y, fold)))
    return own.mapInArrow(partial(_predict, model=model), "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean")
