"""SimHash near-duplicates: fingerprints of whole texts, and all links within a Hamming budget by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import portions, written
from tessera.llm.components import star_components

BITS = 64
#: Rows that one task of the trie join holds at most, unless it can't be split further.
TASK_ROWS = 1 << 17
#: Bits by which a heavy task is split.
SPLIT_BITS = 6


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text. Bit b is 1 if set in over half of the shingles' XXH64 (repeats count).

    A-Z are lower-cased; words end at ASCII white space. Fewer words than a shingle: the whole sequence is one.
    No words (null, empty, blank): 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, total, n = xxhash.xxh64_digest, np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 1 << 16):  # a very long text goes by parts
        part = words[at : min(at + (1 << 16), n) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        raw = np.frombuffer(b"".join([digest(b" ".join(g), seed) for g in grams]), np.uint8)
        total += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text"):
            prints = np.array([simhash(x, shingle) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp: long with the fingerprint's 64 bits), one row for each row of docs; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def portioned(sizes: np.ndarray, limit: int) -> list[np.ndarray]:
    """The indices of sizes in a row, in portions whose sizes add up to limit and one more at most."""
    before = np.cumsum(sizes) - sizes
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(before // limit)) + 1)


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, depth: np.ndarray, used: np.ndarray, budget: int, pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (i < j in trie order) within the budget, below the given pairs of trie nodes.

    keys is sorted within each node; node pair t is keys[lo:hi] against keys[lo2:hi2], both at bit depth[t], with
    used[t] bits that differ above. Pairs descend together; a child pair is dropped once its used bits exceed the
    budget. Pairs with few members are compared outright, some pairs of keys at a time.
    """
    out_i, out_j = [], []
    front = [x.astype(np.int64) for x in (lo, hi, lo2, hi2, depth, used)]

    def leaf(sel: np.ndarray, lo, hi, lo2, hi2) -> None:
        n, m = (hi - lo)[sel], (hi2 - lo2)[sel]
        for s in portioned(n * m, pairs):
            size = n[s] * m[s]
            owner = np.repeat(np.arange(len(s)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = lo[sel][s][owner] + k // m[s][owner], lo2[sel][s][owner] + k % m[s][owner]
            ok = i < j
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            out_i.append(i[ok])
            out_j.append(j[ok])

    for d in range(BITS + 1):
        lo, hi, lo2, hi2, depth, used = front
        if not len(lo):
            break
        now = depth <= d
        small = now & (((hi - lo) * (hi2 - lo2) <= 64) | (depth >= BITS))
        leaf(np.flatnonzero(small), lo, hi, lo2, hi2)
        go, rest = now & ~small, ~now
        waiting = [x[rest] for x in front]
        if not go.any():
            front = waiting
            continue
        lo, hi, lo2, hi2, used = (x[go] for x in (lo, hi, lo2, hi2, used))
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)))
        mid, mid2, same = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2]), lo == lo2
        children = [(lo, mid, lo2, mid2, used, ~same | True), (mid, hi, mid2, hi2, used, ~same | True), (lo, mid, mid2, hi2, used + 1, ~same | True), (mid, hi, lo2, mid2, used + 1, ~same)]
        parts = []
        for a, b, a2, b2, u, ok in children:
            ok = ok & (u <= budget) & (b > a) & (b2 > a2) & ~((a == a2) & (b - a < 2))
            parts.append([a[ok], b[ok], a2[ok], b2[ok], np.full(ok.sum(), d + 1), u[ok]])
        front = [np.concatenate([w, *(p[k] for p in parts)]) for k, w in enumerate(waiting)]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, label[i], label[j])
        np.minimum.at(low, label[j], label[i])
        while True:  # follow the pointers to the end
            nxt = low[low]
            if (nxt == low).all():
                break
            low = nxt
        low = low[label]
        if (low == label).all():
            return label
        label = low


def _join_tasks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task (r, depth, u, v), side and key; whole tasks are joined once some 200,000 rows wait."""

    def joined(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(t["r"])
        new = np.ones(n, bool)
        new[1:] = (np.diff(t["r"]) != 0) | (np.diff(t["depth"]) != 0) | (t["u"][1:] != t["u"][:-1]) | (t["v"][1:] != t["v"][:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], n)
        first = np.add.reduceat((t["side"] == 0).astype(np.int64), at)  # rows of side u come first
        alone = t["u"][at] == t["v"][at]
        lo2, split = np.where(alone, at, at + first), np.where(alone, end, at + first)
        used = np.bitwise_count((t["u"][at] ^ t["v"][at]).view(np.uint64)).astype(np.int64)
        ok = (split > at) & (end > lo2) & (end - at > 1)
        i, j = trie_links(t["rot"].view(np.uint64), at[ok], split[ok], lo2[ok], end[ok], t["depth"][at][ok], used[ok], budget)
        label = roots(n, i, j)
        moved = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(t["rep"][moved]), pa.array(t["rep"][label[moved]])], ["a", "b"])

    names = ("r", "depth", "u", "v", "side", "rot", "rep")
    held: list[dict[str, np.ndarray]] = []

    def merged() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in names}

    rows = 0
    for batch in batches:
        held.append({c: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in enumerate(names)})
        rows += batch.num_rows
        if rows >= 200_000:
            t = merged()
            last = (t["r"] != t["r"][-1]) | (t["depth"] != t["depth"][-1]) | (t["u"] != t["u"][-1]) | (t["v"] != t["v"][-1])
            if last.any():
                cut = int(np.flatnonzero(last)[-1]) + 1
                yield joined({c: x[:cut] for c, x in t.items()})
                held, rows = [{c: x[cut:] for c, x in t.items()}], rows - cut
    if rows:
        yield joined(merged())


def near_links(prints: DataFrame, budget: int = 2, task_rows: int = TASK_ROWS) -> DataFrame:
    """prints (fp, rep: long; each fp once) -> (a, b): links that connect just what fingerprints within budget bits connect.

    The trie is built for budget + 1 rotations of the 64 bits. Two fingerprints within the budget agree on the top
    block of one rotation at least, so each rotation starts with the node pairs of equal top blocks. A task with over
    task_rows rows is split into child node pairs by its next bits, with what is left of the budget, until none is
    heavier; so no task grows with a group of copies. Within a task a component gives a star, not all its pairs
    (a fingerprint has 2080 others within two bits at most, so even those are linear in the fingerprints).
    """
    blocks = budget + 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    turns = []
    for r in range(blocks):
        o, width = cuts[r], cuts[r + 1] - cuts[r]
        rot = F.col("fp") if o == 0 else F.shiftleft("fp", o).bitwiseOR(F.shiftrightunsigned("fp", BITS - o))
        turns.append(F.struct(F.lit(r).alias("r"), F.lit(width).alias("depth"), rot.alias("rot"), F.shiftrightunsigned(rot, BITS - width).alias("u")))
    task = ["r", "depth", "u", "v"]
    front = prints.select("rep", F.explode(F.array(*turns)).alias("t")).select("t.r", "t.depth", "t.u", F.col("t.u").alias("v"), F.lit(0).alias("side"), "t.rot", "rep")
    ready = None
    while True:
        heavy = written(front.groupBy(*task).count().filter((F.col("count") > task_rows) & (F.col("depth") + SPLIT_BITS < BITS)).drop("count"), "heavy")
        if heavy.isEmpty():
            ready = front if ready is None else ready.unionByName(front)
            break
        light = front.join(heavy, task, "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        # A row of a heavy task goes to the child pairs that its own child is part of.
        front = front.join(heavy, task, "left_semi")
        own = F.expr(f"shiftrightunsigned(rot, {BITS - SPLIT_BITS} - depth) & {(1 << SPLIT_BITS) - 1}")
        left = F.lit(budget) - F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
        front = front.withColumn("own", own.cast("int")).withColumn("left", left)
        front = front.withColumn("other", F.explode(F.expr(f"filter(sequence(0, {(1 << SPLIT_BITS) - 1}), t -> bit_count(t ^ own) <= left)")))
        alone = F.col("u") == F.col("v")
        mine, its = F.when(alone, F.least("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))), F.when(alone, F.greatest("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        front = front.select("r", (F.col("depth") + SPLIT_BITS).alias("depth"), (F.shiftleft("u", SPLIT_BITS) + mine).alias("u"), (F.shiftleft("v", SPLIT_BITS) + its).alias("v"), F.when(alone, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"), "rot", "rep")
        front = written(front, "front")
    # The sign bit is flipped so that the sort is the unsigned one that the trie needs.
    dealt = ready.repartition(*task).withColumn("by", F.col("rot").bitwiseXOR(F.lit(-(1 << 63)))).sortWithinPartitions(*task, "side", "by").drop("by")
    return dealt.mapInArrow(partial(_join_tasks, budget=budget), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs: its fingerprint and the smallest doc_id that links reach.

    docs needs doc_id and text; other columns, whatever their names, are not read. Repeated doc_ids stay repeated.
    A row without a doc_id has a fingerprint and takes its component's id, null if none there has an id.
    Equal fingerprints (a third of all rows, say) meet as one, by a partial aggregate. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min_by("fp", "fp").alias("rep")), "groups")
    near = star_components(near_links(groups.select("fp", "rep"), budget))
    placed = groups.join(near, groups.rep == near.node, "left").select("fp", "least", F.coalesce("root", "rep").alias("root"))
    lows = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(lows, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
