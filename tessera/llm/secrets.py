"""Secret scans: patterns, and a battery of randomness tests over unknown tokens, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keeps_columns, let, scan, whole

# The patterns of known kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is as long as it can be, so this is AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # likewise
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

# Encodings that a token may have, the first that fits, with what it must hold besides.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^[0-9a-f]+\z", r"[0-9]", r"[a-f]"),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+\z", r"[0-9]", r"[A-F]"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+\z", r"[2-7]", r"[A-Z]"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+\z", r"[0-9]", r"[a-z]"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[0-9A-Z]+\z", r"[0-9]", r"[A-Z]"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+\z", r"[0-9]", r"[A-Z]", r"[a-z]"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+\z", r"[0-9]", r"[A-Z]", r"[a-z]"),
)
#: Upper ends of the length bands within which false discoveries are held.
BANDS = (24, 32, 48, 64, 128)
#: p-values are counted in steps of a tenth of a power of ten, down to 10^-12.
STEPS, FLOOR = 10, 12


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points (end exclusive).

    Where no match stands nothing more is done; else what stands between them gives the places.
    """

    def placed(found: Column) -> Column:
        whole_ = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def of(m: Column) -> Column:
            # what a lambda uses is bound before it: else the text is split again for each match
            gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
            sizes = F.transform(m, lambda x: F.char_length(x))
            steps = let(gaps, lambda g: F.transform(sizes, lambda x, i: x + F.get(g, i)))
            return let(
                F.struct(let(steps, lambda s: scan(s, lambda a, b: a + b)).alias("ends"), sizes.alias("sizes")),
                lambda s: F.transform(found, lambda f, i: F.struct((F.get(s["ends"], i) - F.get(s["sizes"], i)).alias("start"), F.get(s["ends"], i).alias("end"), f.alias("found"))),
            )

        return let(whole_, of)

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the normal distribution, by a rational approximation (Abramowitz and Stegun 26.2.17)."""

    def of(a: Column) -> Column:
        t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
        poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
        return F.exp(-a * a / 2) * F.lit(1 / math.sqrt(2 * math.pi)) * poly

    p = let(F.least(F.abs(z), F.lit(38.0)), of)
    return F.when(z >= 0, p).otherwise(F.lit(1.0) - p)


def two_sided(z: Column) -> Column:
    return F.lit(2.0) * upper_tail(F.abs(z))


def encoding_of(token: Column) -> Column:
    """The index of the first encoding that fits, or null: words, identifiers and plain numbers have none."""
    out = F.lit(None).cast("int")
    for k, (_, _, shape, *must) in reversed(list(enumerate(ENCODINGS))):
        fits = token.rlike(shape)
        for m in must:
            fits &= token.rlike(m)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def plausibility(token: Column, encoding: Column) -> Column:
    """The battery's combined p-value that the token's symbols were drawn evenly and independently.

    Chi-squared over the encoding's alphabet (upper tail, by Wilson and Hilferty's cube root), runs above and below the
    alphabet's middle, and serial correlation of symbol values (both two-sided), combined by Fisher's method.
    """
    letters = F.array(*[F.lit(a) for _, a, *_ in ENCODINGS])

    def tests(s: Column) -> Column:
        x, size, n = s["codes"], s["size"].cast("double"), s["n"].cast("double")
        squares = F.aggregate(F.transform(F.sequence(F.lit(1), s["size"]), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double")), F.lit(0.0), lambda a, o: a + o * o)
        free = size - 1
        chi = size / n * squares - n
        spread = F.lit(2.0) / (F.lit(9.0) * free)
        p1 = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread))
        high = F.transform(x, lambda y: (y * 2 > s["size"]).cast("int"))

        def runs(h: Column) -> Column:
            up = F.aggregate(h, F.lit(0), lambda a, y: a + y).cast("double")
            down = n - up
            turns = F.aggregate(F.transform(h, lambda y, i: F.when((i > 0) & (F.get(h, i - 1) != y), 1).otherwise(0)), F.lit(1), lambda a, y: a + y).cast("double")
            mean = F.lit(2.0) * up * down / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when((up == 0) | (down == 0) | (var <= 0), 1e-12).otherwise(two_sided((turns - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))

        def serial(d: Column) -> Column:
            down = F.aggregate(d, F.lit(0.0), lambda a, y: a + y * y)
            up = F.aggregate(F.transform(d, lambda y, i: F.coalesce(y * F.get(d, i + 1), F.lit(0.0))), F.lit(0.0), lambda a, y: a + y)
            return F.when(down <= 0, 1e-12).otherwise(two_sided((up / F.greatest(down, F.lit(1e-9)) + F.lit(1.0) / n) * F.sqrt(n)))

        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
        p3 = let(mean, lambda mu: let(F.transform(x, lambda y: y.cast("double") - mu), serial))
        logs = -(F.log(F.greatest(p1, F.lit(1e-12))) + F.log(F.greatest(let(high, runs), F.lit(1e-12))) + F.log(F.greatest(p3, F.lit(1e-12))))
        return let(logs, lambda t: F.exp(-t) * (F.lit(1.0) + t + t * t / 2))

    alphabet = F.get(letters, encoding)
    return let(alphabet, lambda a: let(F.struct(F.transform(F.split(token, ""), lambda c: F.instr(a, c)).alias("codes"), F.char_length(a).alias("size"), F.char_length(token).alias("n")), tests))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base (spans of known kinds) and tokens (spans that have an encoding, with its band and step of p)."""
    text = whole(F.col("text"))

    def spans(k: int, pattern: str, group: int = 0, least: int = 0) -> Column:
        found = matches(text, pattern, group)
        if least:
            found = F.filter(found, lambda m: F.char_length(m["found"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    def tested(m: Column) -> Column:
        n = F.char_length(m["found"])
        band = F.lit(0)
        for edge in BANDS:
            band = band + F.when(n >= edge, 1).otherwise(0)
        step = F.floor(F.least(F.lit(float(FLOOR)), -F.log10(F.greatest(plausibility(m["found"], m["code"]), F.lit(1e-13)))) * STEPS).cast("int")
        return F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"), (m["code"] * 8 + band).alias("cell"), step.alias("step"))

    coded = F.filter(F.transform(matches(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), encoding_of(m["found"]).alias("code"))), lambda m: m["code"].isNotNull())
    base = F.array_sort(F.concat(spans(0, ASSIGN, 1, 6), spans(1, ACCESS), spans(2, HEX)))
    return docs.withColumn("base_", base).withColumn("tokens_", F.transform(coded, tested))


def thresholds(steps: DataFrame, q: float) -> dict[int, int]:
    """steps (cell, step) of all tokens -> the step of p from which a cell's tokens count as ordinary text.

    Benjamini and Hochberg's rule at level q within each cell (encoding and length band): the hypothesis is that a token
    is random, so a false discovery is a secret taken for text; how many are allowed follows the tokens of like length,
    whose tests have like power. Only counts by cell and step (some 6,800 at most) go to the driver.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in steps.groupBy("cell", "step").count().collect():
        counts.setdefault(r.cell, {})[r.step] = r["count"]
    out = {}
    for cell, by in counts.items():
        total, seen, cut = sum(by.values()), 0, FLOOR * STEPS + 1
        for step in sorted(by, reverse=True):
            seen += by[step]
            if 10.0 ** (-step / STEPS) <= q * seen / total:
                cut = step
        out[cell] = cut
    return out


def found_spans(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """docs with base_ and spans_: arrays of (start, kind, end) in order; spans_ has the battery's finds too.

    A token is a secret if it has a key's encoding and the battery doesn't reject that it is random (see thresholds).
    One inside a known kind's span adds nothing. Nulls are empty texts; no match gives empty arrays; repeated rows have
    equal spans, very long texts are scanned whole, and an empty table gives an empty one. Names of further columns are free
    but for those with a trailing underscore.
    """
    rows = scanned(docs)
    cuts = thresholds(scanned(docs.select("text")).select(F.explode("tokens_").alias("t")).select("t.cell", "t.step"), q)
    cut = F.lit(FLOOR * STEPS + 1)
    if cuts:
        cut_of = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
        random = F.filter("tokens_", lambda t: (t["step"] < F.coalesce(F.try_element_at(cut_of, t["cell"]), cut)) & ~F.exists("base_", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
        random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
        both = F.array_sort(F.concat(F.col("base_"), random))
    else:
        both = F.col("base_")
    return rows.withColumn("spans_", both).drop("tokens_")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@keeps_columns("text", "n_chars")
def redacted(docs: DataFrame, q: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark (spans that overlap by one) and n_chars brought up to date.

    Rows without a find are as they were, nulls included. No row is dropped; repeated rows stay repeated, all columns keep
    their names and values but for text and n_chars. Very long texts are scanned whole. An empty table gives an empty one.
    """
    rows = found_spans(docs, q)

    def cut(r: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(r["ends"], i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(F.substring(F.col("text"), before + 1, s["start"] - before), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(r["spans"], piece), ""), F.substring(F.col("text"), F.element_at(r["ends"], -1) + 1, F.char_length("text")))

    ends = scan(F.transform("spans_", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    new = F.when(F.size("spans_") > 0, let(F.struct(F.col("spans_").alias("spans"), ends.alias("ends")), cut)).otherwise(F.col("text"))
    out = rows.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans_") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
