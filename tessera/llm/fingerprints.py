"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, partitions, whole, words_of

#: Words of a gram, and grams of a window: any WORDS + WINDOW - 1 = 8 words that two texts share leave a common mark.
WORDS, WINDOW = 5, 4
#: The rolling hash is a polynomial in BASE over the field of PRIME.
PRIME, BASE = (1 << 31) - 1, 1_000_003
LAST = (1 << 32) - 1


def winnow(text: Column, k: int = WORDS, window: int = WINDOW) -> Column:
    """The marks of a text as array<long>, hash * 2^32 + (2^32 - 1 - position), in order of position, each once.

    Words are hashed to the field; a gram's hash is the polynomial of its k words, the value that a rolling update
    h' = (h - w * BASE^(k-1)) * BASE + w' gives. Each window of grams marks its least hash, of equal ones the
    rightmost: a long holds the hash above the complement of the position, so least() settles both. Window minima come
    from doubling. A text of fewer than k words is one gram, of fewer grams than a window one window; none has no mark.
    Letters count in lower case.
    """
    zero = F.lit(0).cast("long")

    def push(acc: Column, w: Column) -> Column:
        return F.pmod(acc * F.lit(BASE) + w, F.lit(PRIME))

    def grams(h: Column) -> Column:
        def of(i: Column) -> Column:
            acc = F.get(h, i)
            for j in range(1, k):
                acc = push(acc, F.get(h, i + j))
            return F.shiftleft(acc, 32).bitwiseOR(F.lit(LAST) - i)

        short = F.array(F.shiftleft(F.reduce(h, zero, push), 32).bitwiseOR(F.lit(LAST)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, short).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), of))

    def minima(m: Column) -> Column:
        def wider(x: Column, shift: int) -> Column:
            return F.transform(x, lambda v, i: F.least(v, F.get(x, i + shift)))

        def grow(x: Column, have: int) -> Column:
            if have == window:
                return F.array_distinct(F.slice(x, 1, F.greatest(F.lit(1), F.size(x) - (window - 1))))
            shift = min(have, window - have)
            return let(wider(x, shift), lambda y: grow(y, have + shift))

        return F.when(F.size(m) == 0, m).otherwise(grow(m, 1))

    hashes = F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    return let(hashes, lambda h: let(grams(h), minima))


def hashes_of(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda x: F.shiftrightunsigned(x, 32)))


def positions_of(marks: Column) -> Column:
    """Word positions (of a gram's first word, from 0)."""
    return F.transform(marks, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def shown(marks: Column) -> Column:
    """hash@position, comma-joined; hashes in hexadecimal."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, 32)), F.lit("@"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two without any are alike."""

    def of(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, 1.0).otherwise(both / union)

    return let(F.size(F.array_intersect(a, b)), of)


def _buckets(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """docs with o (doc_id, a null first) and bucket: ranges of o of about equal depth, and (bucket, highest o, the
    bucket that follows it on the way down) for each bucket that has rows. A few rows a partition go to the driver."""
    low = -(1 << 63)
    docs = docs.withColumn("o", F.coalesce("doc_id", F.lit(low)))
    want = 8 * partitions(docs.sparkSession)
    coarse, fine = min(want, 256), -(-want // 256)
    cuts = docs.agg(F.percentile_approx("o", [i / coarse for i in range(1, coarse)], 10 * coarse), F.min("o"), F.max("o")).first()
    if cuts[0] is None:
        return docs.withColumn("bucket", F.lit(0)), []
    splits = sorted(set(cuts[0]))
    bounds = [cuts[1], *splits, cuts[2]]
    lit = F.array(*[F.lit(x).cast("long") for x in bounds])
    c = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in splits]), lambda s: s < F.col("o")))
    docs = docs.withColumn("c", c)
    lo, hi = F.get(lit, F.col("c")).cast("double"), F.get(lit, F.col("c") + 1).cast("double")
    part = F.least(F.lit(fine - 1), F.floor((F.col("o").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * fine)).cast("int")
    docs = docs.withColumn("bucket", F.col("c") * fine + F.greatest(part, F.lit(0))).drop("c")
    heads = sorted((r.bucket, r.top) for r in docs.groupBy("bucket").agg(F.max("o").alias("top")).collect())
    return docs, [(b, top, heads[(i + 1) % len(heads)][0]) for i, (b, top) in enumerate(heads)]


def neighbours(docs: DataFrame, k: int = WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, marks, next_text, next_marks): each document and the next one by descending doc_id; after the
    last comes the first. Equal doc_ids go by text, rows without one come last; a table of one row follows itself.

    Rows are dealt once, by ranges of doc_id; a range's last row gets a copy of the next range's first one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    rows, heads = _buckets(rows)
    rows = rows.withColumn("ghost", F.lit(0))
    if heads:
        tops = F.broadcast(docs.sparkSession.createDataFrame(heads, "bucket int, o long, before int"))
        ghosts = rows.join(tops, ["bucket", "o"]).select("doc_id", "text", "o", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
        rows = rows.select("doc_id", "text", "o", "bucket", "ghost").unionByName(ghosts)
    spark = docs.sparkSession
    dealt = rows.repartition(partitions(spark), "bucket").withColumn("marks", winnow(F.col("text"), k, window))
    from pyspark.sql import Window

    down = Window.partitionBy("bucket").orderBy("ghost", F.desc("o"), "text")
    out = dealt.select("doc_id", "text", "marks", "ghost", F.lead("text").over(down).alias("next_text"), F.lead("marks").over(down).alias("next_marks"))
    return out.filter("ghost = 0").drop("ghost")


def edited(docs: DataFrame, k: int = WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has the last half of its code points (rounded down) replaced by as many of the next document's
    first ones, or all it has. Null texts are empty. Likeness is that of hashes; positions only show where they stand.
    """
    n = F.char_length("text")
    both = neighbours(docs, k, window).withColumn("n_chars", n.cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))

    def of(m: Column) -> Column:
        own, new, nxt = m["own"], m["new"], m["next"]
        return let(
            F.struct(hashes_of(own).alias("own"), hashes_of(new).alias("new"), hashes_of(nxt).alias("next")),
            lambda h: F.struct(shown(own).alias("fingerprint"), shown(new).alias("edited_fingerprint"), likeness(h["own"], h["new"]).alias("near_edited"), likeness(h["own"], h["next"]).alias("near_next")),
        )

    marks = F.struct(F.col("marks").alias("own"), winnow(F.col("edited"), k, window).alias("new"), F.col("next_marks").alias("next"))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), let(marks, of).alias("r")).select("doc_id", "n_chars", "edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next")
