"""LM scoring: a hashed maximum-entropy model of words, its softmax factored by class.

Words stand at leaves: the OWN most frequent have one each, the others share the rest by the bytes they end in. Leaves are
dealt into CLASSES classes of SLOTS leaves by what stands before them in the corpus. Then

    P(word | context) = P(class | context) * P(leaf | class, context) * P(word | leaf).

The first two factors are softmaxes over hashed n-gram and skip features of the context; for words with a leaf of their
own the third is 1, for others it is a count's share with 0.1 added, and with one place a leaf for words not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, portions, written

CLASSES, SLOTS = 32, 32
LEAVES = CLASSES * SLOTS
#: Leaves of one word.
OWN = LEAVES // 2
#: Bytes at a word's end that the leaf of a rarer word follows from.
LOOK = 2
#: Rows of the two hashed tables of weights: contexts, and contexts with the class that is given.
ROWS = (1 << 14, 1 << 15)
#: Words whose counts go to every task; the rest are joined.
HEAD = 1 << 18
ADD = 0.1
#: Rounds of the gradient, each over its own part of the corpus; the step, and the count that holds rare weights back.
ROUNDS, RATE, HOLD = 5, 0.4, 2.0
#: Tokens a task of the gradient has at least, so that the sums it sends stay small against what it reads.
TASK_TOKENS = 1_000_000
#: Buckets of the words before by which leaves are told apart, rows of weights that travel together, tokens of a batch.
BEFORE, BLOCK, STEP = 256, 16, 1 << 14
#: Bytes of text that a task holds as words at a time, about.
PART = 1 << 22
_end = xxhash.xxh64_intdigest(b"\n", 42)  # no word holds a line end
END = _end - (1 << 64) * (_end >> 63)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def look_of(word: bytes) -> int:
    """Which of the shared leaves a word would stand at, by its last LOOK bytes."""
    return zlib.crc32(word[-LOOK:]) % (LEAVES - OWN)


class _Looks(dict):
    def __missing__(self, tail: bytes) -> int:
        self[tail] = out = look_of(tail)
        return out


_looks = _Looks()  # 2 ** 16 entries at most


def pieces(part: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[tuple[pa.Array, bool]]:
    """(texts, ended): the texts of a portion; a single text beyond limit bytes comes in pieces, cut where words are apart."""
    texts = pc.fill_null(part.column(column), "")
    if len(texts) > 1 or pc.binary_length(texts)[0].as_py() <= limit:
        yield texts, True
        return
    raw, at = memoryview(texts[0].as_buffer()), 0
    while at < len(raw):
        gap = _BREAK.search(raw, at + limit)
        stop = gap.end() if gap and at + limit < len(raw) else len(raw)
        yield pa.array([bytes(raw[at:stop])], pa.binary()).cast(pa.string(), safe=False), stop == len(raw)
        at = stop


def words_in(texts: pa.Array, ended: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index, stops, words): the texts' words as indexes into words, an end (index len(words)) after each text that is
    ended, and where each text stops."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets, flat = parts.offsets.to_numpy(), parts.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    held = np.concatenate(([0], np.cumsum(keep)))
    stops = held[offsets[1:] - offsets[0]]
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    if not ended:
        return coded.indices.to_numpy(), stops, words
    stops = stops + np.arange(1, len(stops) + 1)
    index = np.full(stops[-1] if len(stops) else 0, len(words), np.int32)
    spot = np.ones(len(index), bool)
    spot[stops - 1] = False
    index[spot] = coded.indices.to_numpy()
    return index, stops, words


def hashes_of(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, then the end's."""
    raw = b"".join([xxhash.xxh64_digest(w, 42) for w in words])
    return np.append(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64), END)


def looks_of(words: list[bytes]) -> np.ndarray:
    return np.array([*[_looks[w[-LOOK:]] for w in words], 0], np.int32)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text", PART):
            for texts, ended in pieces(part, 0):
                index, _, words = words_in(texts, ended)
                n = np.bincount(index, minlength=len(words) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(hashes_of(words)), pa.array(looks_of(words)), pa.array(n)], ["h", "look", "n"])


class Words:
    """The counts that every task has: hashes in order, with their leaves and logarithms."""

    def __init__(self, h: np.ndarray, look: np.ndarray, n: np.ndarray) -> None:
        """Given the most frequent first."""
        leaf = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), OWN + look)
        order = np.argsort(h)
        self.h, self.leaf, self.log = h[order], leaf[order].astype(np.int16), np.log10(n[order] + ADD)

    def find(self, h: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, leaf, log10 of the count and 0.1) of hashes; leaves by looks and 0 for those not held."""
        if not len(self.h):
            return np.zeros(len(h), bool), (OWN + look).astype(np.int16), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return known, np.where(known, self.leaf[at], (OWN + look).astype(np.int16)), np.where(known, self.log[at], 0.0)


ENCODED = "doc_id long, held_out boolean, round int, leaves array<short>, n_tokens long, n_head long, log_head double, tail array<long>"


def _encode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, round, text -> ENCODED: each text as leaves, its sums over words of the head, others' hashes."""
    words_: Words = model.value

    def lists(flat: np.ndarray, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))

    for batch in batches:
        for part in portions(batch, "text", PART):
            leaves, tails, rows = [], [], np.zeros((part.num_rows, 4))  # tokens, those of the head, their logs, those of the tail
            for texts, ended in pieces(part, 3):
                index, stops, words = words_in(texts, ended)
                hashes = hashes_of(words)
                known, leaf, log = words_.find(hashes, looks_of(words))
                sums = np.concatenate((np.zeros((1, 3)), np.cumsum(np.stack([np.ones(len(index)), known[index], log[index]], 1), axis=0)))
                begins = np.concatenate(([0], stops[:-1])).astype(np.int64)
                own = sums[stops] - sums[begins]
                rows[:, :3] += own
                rows[:, 3] += own[:, 0] - own[:, 1]
                leaves.append(leaf[index])
                tails.append(hashes[index][~known[index]])
            counts = rows[:, [0, 1, 3]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], lists(np.concatenate(leaves), counts[:, 0].tolist()), pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(rows[:, 2]), lists(np.concatenate(tails), counts[:, 2].tolist())],
                ["doc_id", "held_out", "round", "leaves", "n_tokens", "n_head", "log_head", "tail"],
            )


def before(leaves: np.ndarray, stops: np.ndarray, most: int = 3) -> list[np.ndarray]:
    """The leaves one, two, ... most places before each token, LEAVES before a text's start."""
    sizes = np.diff(stops, prepend=0)
    place = np.arange(len(leaves)) - np.repeat(stops - sizes, sizes)
    out = []
    for k in range(1, most + 1):
        x = np.full(len(leaves), LEAVES, np.int16)
        x[k:] = leaves[:-k]
        x[place < k] = LEAVES
        out.append(x)
    return out


def _token_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, leaves, stops) of about limit tokens, one row at least."""
    sizes = batch.column(column).value_lengths().to_numpy()
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        part = batch.slice(at, stop - at)
        yield part, part.column(column).flatten().to_numpy(), np.cumsum(sizes[at:stop])
        at = stop


def _blocks(sums: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """sums (rows, values) as blocks of width rows that hold anything but 0."""
    cut = sums.reshape(len(sums) // width, -1)
    held = np.flatnonzero(cut.any(axis=1))
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([cut[i].astype(np.float32).tobytes() for i in held], pa.binary())], ["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(sums, np.float32).astype(np.float64)
            held[block] = held[block] + values if block in held else values
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])


def summed_over(rows: DataFrame, sums, shape: tuple[int, int], width: int) -> np.ndarray:
    """Sums over all rows of what sums (batches -> one array of the shape a task) gives: blocks are added where they meet."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(sums(batches), width)

    t = rows.mapInArrow(own, "block int, sums binary").repartition(partitions(rows.sparkSession), "block").mapInArrow(_added, "block int, sums binary").toArrow()
    out = np.zeros((shape[0] // width, shape[1] * width))
    for block, raw in zip(t["block"].to_pylist(), t["sums"].to_pylist(), strict=True):
        out[block] = np.frombuffer(raw, np.float64)
    return out.reshape(shape)


def _pairs(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often each leaf stands after each bucket of leaves."""
    out = np.zeros((LEAVES, BEFORE))
    for batch in batches:
        for _, leaves, stops in _token_slices(batch, 0):
            (w1,) = before(leaves, stops, 1)
            np.add.at(out.ravel(), leaves.astype(np.int64) * BEFORE + w1 % BEFORE, 1.0)
    return out


def classes_of(pairs: np.ndarray) -> np.ndarray:
    """A class for each leaf: leaves are halved by the first principal direction of what stands before them, again and again."""
    total, each = pairs.sum(axis=1), (pairs.sum(axis=0) + 1e-9) / (pairs.sum() + 1e-9 * BEFORE)
    z = np.sqrt((pairs + 2 * each) / (total[:, None] + 2)) - np.sqrt(each)
    weight = np.sqrt(total + 1)
    out = np.zeros(LEAVES, np.int64)

    def halve(own: np.ndarray, first: int, parts: int) -> None:
        if parts == 1:
            out[own] = first
            return
        apart = z[own] - np.average(z[own], axis=0, weights=weight[own])
        way = np.linalg.svd(apart * np.sqrt(weight[own])[:, None], full_matrices=False)[2][0]
        way = way * np.sign(way[np.abs(way).argmax()] or 1.0)
        own = own[np.lexsort((own, np.round(apart @ way, 9)))]
        for k, half in enumerate((own[: len(own) // 2], own[len(own) // 2 :])):
            halve(half, first + k * parts // 2, parts // 2)

    halve(np.arange(LEAVES), 0, CLASSES)
    return out


def _hash(bits: int, *xs: np.ndarray) -> np.ndarray:
    """Rows of a table of 2 ** bits rows."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for x in xs:
        h = (h ^ np.asarray(x).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = h ^ (h >> np.uint64(31))
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint16)


class Tree:
    """Where each leaf stands, and the rows of weights that a context has.

    Features of a context, for the class: the word before, the two before, the one before that (a skip), the classes of
    the three before. For the leaf, each with the class that is given: the word before and the skip.
    """

    def __init__(self, classes: np.ndarray, n: np.ndarray) -> None:
        """n: how often each leaf occurs."""
        self.klass = classes
        order = np.argsort(classes, kind="stable")
        self.slot = np.empty(LEAVES, np.int64)
        self.slot[order] = np.arange(LEAVES) % SLOTS
        of_class = np.bincount(classes, weights=n, minlength=CLASSES)
        share = np.zeros((CLASSES, SLOTS))
        share[classes, self.slot] = (n + 0.5) / (of_class[classes] + 0.5 * SLOTS)
        self.bias = np.log((of_class + 1) / (n.sum() + CLASSES)).astype(np.float32), np.log(share).astype(np.float32)
        one, two = (int(r).bit_length() - 1 for r in ROWS)
        w, c, y = np.arange(LEAVES + 1), np.arange(CLASSES + 1), np.arange(CLASSES)
        self.above = np.append(classes, CLASSES).astype(np.int32)
        self.word, self.skip = _hash(one, 1 + 0 * w, w), _hash(one, 3 + 0 * w, w)
        self.classes3 = _hash(one, 4 + 0 * c[:, None, None], c[:, None, None], c[None, :, None], c[None, None, :]).ravel()
        self.word_in, self.skip_in = (_hash(two, k + 0 * w[:, None], w[:, None], y[None, :]).ravel() for k in (5, 7))
        self.one = one

    def rows(self, leaves: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, slot, rows for the class, rows for the leaf) of tokens."""
        c1, c2, c3 = self.above[w1], self.above[w2], self.above[w3]
        y, n = self.klass[leaves], CLASSES + 1
        first = np.stack([self.word[w1], _hash(self.one, 2 + 0 * w1, w1, w2), self.skip[w2], self.classes3[(c1 * n + c2) * n + c3]], axis=1)
        second = np.stack([self.word_in[w1 * np.int64(CLASSES) + y], self.skip_in[w2 * np.int64(CLASSES) + y]], axis=1)
        return y, self.slot[leaves], first, second


_ones = np.ones(CLASSES, np.float32)


def powers(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """e to bias plus the weights of each token's rows (tokens, choices). Steps are bounded, so none is beyond a float."""
    z = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    z += bias
    return np.exp(z, out=z)


def runs_summed(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: long runs each by a product with ones, all short ones together, a row at a time."""
    count = np.diff(np.append(begin, len(values)))
    out = values[begin]
    ones = np.ones(count.max(initial=0), np.float32)
    for i in np.flatnonzero(count > 16):
        out[i] = ones[: count[i]] @ values[begin[i] : begin[i] + count[i]]
    k, live = 1, np.flatnonzero((count > 1) & (count <= 16))
    while len(live):
        out[live] += values[begin[live] + k]
        k += 1
        live = live[count[live] > k]
    return out


def _slopes(batches: Iterator[pa.RecordBatch], model) -> np.ndarray:
    """For each weight how often its choice was seen less how often it was expected, and how often it was seen: a table of
    all rows of weights, slopes before counts."""
    tree, tables = model.value
    width = CLASSES  # as many as SLOTS
    slope, seen = np.zeros((sum(ROWS), width)), np.zeros((sum(ROWS), width))
    for batch in batches:
        for _, leaves, stops in _token_slices(batch, 0):
            context = before(leaves, stops)
            for at in range(0, len(leaves), STEP):
                y, s, *rows = tree.rows(leaves[at : at + STEP], *(x[at : at + STEP] for x in context))
                for k, (row, choice, bias) in enumerate(((rows[0], y, tree.bias[0]), (rows[1], s, tree.bias[1][y]))):
                    p = powers(tables[k], bias, row)
                    p *= (-1 / (p @ _ones))[:, None]
                    p[np.arange(len(p)), choice] += 1
                    flat, base = row.ravel(), k * ROWS[0]
                    order = np.argsort(flat, kind="stable")  # short integers are sorted by their digits
                    ordered = flat[order]
                    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                    own = ordered[begin]
                    slope[own.astype(np.int64) + base] += runs_summed(np.take(p, order // row.shape[1], axis=0), begin)
                    np.add.at(seen.ravel(), ((row.astype(np.int64) + base) * width + choice[:, None]).ravel(), 1.0)
    return np.concatenate((slope, seen), axis=1)


def train(encoded: DataFrame, tree: Tree, tokens: int) -> list[np.ndarray]:
    """The two tables of weights: ROUNDS gradient steps, each from sums over its own part of the training texts.

    A text's part follows from a hash of it, and sums don't depend on how rows are dealt, so neither do the weights. Each
    step is the slope over the expected count: a seen share above the expected one raises a weight, RATE for one twice it.
    """
    tables = [np.zeros((r, CLASSES), np.float32) for r in ROWS]
    tasks = max(1, tokens // ROUNDS // TASK_TOKENS)
    for k in range(ROUNDS):
        held = encoded.sparkSession.sparkContext.broadcast((tree, tables))
        own = encoded.filter(F.col("round") == k).select("leaves").coalesce(tasks)
        slope, seen = np.hsplit(summed_over(own, partial(_slopes, model=held), (sum(ROWS), 2 * CLASSES), BLOCK), 2)
        step = (RATE * np.clip(slope / np.maximum(seen - slope + HOLD, 1e-6), -1, 2)).astype(np.float32)
        tables = [tables[0] + step[: ROWS[0]], tables[1] + step[ROWS[0] :]]
        held.unpersist()
    return tables


def log_probabilities(tree: Tree, tables: list[np.ndarray], leaves: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """log10 of P(leaf | context) of each token, in sparse batches."""
    context, out = before(leaves, stops), np.zeros(len(leaves), np.float32)
    for at in range(0, len(leaves), STEP):
        y, s, first, second = tree.rows(leaves[at : at + STEP], *(x[at : at + STEP] for x in context))
        i, a, b = np.arange(len(y)), powers(tables[0], tree.bias[0], first), powers(tables[1], tree.bias[1][y], second)
        out[at : at + STEP] = np.log10(a[i, y] / (a @ _ones)) + np.log10(b[i, s] / (b @ _ones))
    return out


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(..., leaves) -> (..., inner): sums over a text of the logarithms of all factors but the counts within leaves."""
    tree, tables, below = model.value
    for batch in batches:
        for part, leaves, stops in _token_slices(batch, batch.num_columns - 1):
            p = log_probabilities(tree, tables, leaves, stops).astype(np.float64) - below[leaves]
            inner = np.add.reduceat(p, stops - np.diff(stops, prepend=0))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(inner)], [*part.schema.names[:-1], "inner"])


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, log_head double, inner double"


def held_out(doc_id: F.Column) -> F.Column:
    """A tenth, by the id's checksum; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    docs needs doc_id and text; other columns, whatever their names, are not read. A null or empty text is its end alone; a
    very long one is read in pieces. Repeated rows are scored alike, and each counts in training. Words of equal counts have
    their order from their hash. Without any training row leaves are alike and each holds just its place for words not seen.
    An empty table gives an empty one.

    Counts come from all training rows, by a partial aggregate; words are known by their 64-bit hash. The HEAD most
    frequent go to every task, the others' occurrences are joined with the counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ROUNDS)).cast("int").alias("round"), "text")
    counts = rows.filter("not held_out").select("text").mapInArrow(_word_counts, "h long, look int, n long").filter("n > 0")
    counts = written(counts.groupBy("h", "look").agg(F.sum("n").alias("n")), "words")
    of_look = counts.groupBy("look").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, kinds = sum(r.n for r in of_look), sum(r.v for r in of_look)
    top = counts.orderBy(F.desc("n"), "h", "look").limit(HEAD).toArrow()
    h, look, often = (top[c].to_numpy() for c in ("h", "look", "n"))
    n, v = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in of_look:
        n[OWN + r["look"]], v[OWN + r["look"]] = r.n, r.v
    m = min(OWN, len(h))
    np.subtract.at(n, OWN + look[:m], often[:m])
    np.subtract.at(v, OWN + look[:m], 1)
    n[:m] = often[:m]
    below = np.log10(np.where(np.arange(LEAVES) < OWN, n + ADD, n + ADD * (v + 1)))
    own = rows.mapInArrow(partial(_encode, model=spark.sparkContext.broadcast(Words(h, look, often))), ENCODED).withColumn("row", F.monotonically_increasing_id())
    encoded = written(own, "leaves", by=["round"])
    learned = encoded.filter("not held_out").select("round", "leaves")
    tree = Tree(classes_of(summed_over(learned.select("leaves"), _pairs, (LEAVES, BEFORE), BLOCK)), n)
    model = spark.sparkContext.broadcast((tree, train(learned, tree, total), below))
    inner = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_head", "log_head", "leaves").mapInArrow(partial(_score, model=model), SCORED)
    tail = encoded.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count("*").alias("t"))
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    rest = tail.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("t") * log).alias("log_tail"), F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("n_tail"))
    both = inner.join(rest, "row", "left").withColumn("logs", F.col("log_head") + F.coalesce("log_tail", F.lit(0.0)))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + ADD * (kinds + 1))))).alias("base_score"), (F.col("logs") + F.col("inner")).alias("score"),
    )
