"""Trained operators: accuracy on labels, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(900001, None, None), (900002, "", "xx"), (900003, "a", "en"), (900004, "Wort " * 40000, None), (None, "and the", "en")], "doc_id long, text string, lang string")


def test_quality_keeps_good_text_and_rejects_junk(spark, tables):
    docs, labels = tables
    rows = docs.select("doc_id", "text", "lang").unionByName(odd(spark)).selectExpr("*", "1 as n", "'x' as keep")
    got = quality.classify(rows, labels).toPandas()
    assert len(got) == rows.count()
    both = got.merge(labels.toPandas(), on="doc_id")
    assert both[both["quality"] == 1]["keep"].mean() > 0.97
    assert both[both["quality"] == 0]["keep"].mean() < 0.15
    assert quality.classify(rows.limit(0), labels).count() == 0
    assert quality.classify(rows, labels.limit(0)).filter("keep").count() == rows.count()
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 0.9


def test_quality_keeps_good_text_that_no_model_has_seen(spark):
    """Trusted documents whose labels are left out stay nearly all, in each language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    left_out = quality.trusted(labels).filter("doc_id % 10 < 3")
    got = quality.classify(docs, labels.filter("doc_id % 10 >= 3")).join(left_out, "doc_id").groupBy("lang").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert min(r.n for r in got) > 50 and all(r.kept > 0.95 for r in got), got


def test_quality_thresholds_take_no_python_workers(spark):
    """They are a table of the plan's own; of a list Spark makes an RDD, whose workers stand beside those with the models."""
    scores = spark.createDataFrame([(i, "en", 30, 1.0 + i) for i in range(300)], "doc_id long, lang string, n long, perplexity_ double")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    cuts = quality.thresholds(scores, labels, ["en"])
    assert "LocalRelation" in cuts._jdf.queryExecution().optimizedPlan().toString()
    assert cuts.dtypes == [("l_", "string"), ("b_", "int"), ("low", "double"), ("high", "double")] and cuts.count() == 8
    assert {r.low for r in cuts.collect() if r.b_ == 0} == {1.0} and {r.high for r in cuts.collect() if r.b_ == 0} == {300.0}


def test_kneser_ney_against_sums_by_hand(spark):
    """On a small text: every seen context's probabilities sum to 1, and scores equal a direct recursion's."""
    texts = ["abab abc", "abcab cab", "aa b"]
    model = quality.collected(*quality.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")))["en"]
    codes, ends = quality.codes_of(texts)
    keys, _ = quality.ngrams(codes, ends)
    alphabet = np.arange(1 << quality.CODE_BITS, dtype=np.int64)
    for key in set(keys.tolist()):
        ctx = key >> quality.CODE_BITS << quality.CODE_BITS
        assert np.exp2(model.log2(ctx | alphabet).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def brute_log2(texts, asked):
    """Interpolated modified Kneser-Ney by recursion over tuples of codes: mean log2 of the characters of each asked text."""
    from collections import Counter
    from functools import cache

    order, size = quality.ORDER, 1 << quality.CODE_BITS
    code = lambda t: (*[quality.START] * (order - 1), *[min(ord(c), quality.OTHER) for c in t], quality.END)
    counts = {order: Counter(c[i - order + 1 : i + 1] for c in map(code, texts) for i in range(order - 1, len(c)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, c in counts.items():
        by = Counter(c.values())
        y = by[1] / (by[1] + 2 * by[2]) if by[1] + by[2] else 0.5
        cuts[n] = [min(max(i - (i + 1) * y * by[i + 1] / max(by[i], 1), 0.1), i - 0.05) for i in (1, 2, 3)]

    @cache
    def p(g):
        n = len(g)
        lower = 1 / size if n == 1 else p(g[1:])
        own = {x: a for x, a in counts[n].items() if x[:-1] == g[:-1]}
        if not own:
            return lower
        cut = lambda a: cuts[n][min(a, 3) - 1]
        total = sum(own.values())
        return max(0, own.get(g, 0) - (cut(own[g]) if g in own else 0)) / total + sum(map(cut, own.values())) / total * lower

    out = []
    for t in asked:
        c = code(t)
        out.append(np.mean([np.log2(p(c[i - order + 1 : i + 1])) for i in range(order - 1, len(c))]))
    return out


def test_kneser_ney_against_a_recursion(spark):
    texts = ["abab abc", "abcab cab", "aa b", "", "the cat and the bat sat", "the end of the band"]
    asked = [*texts, "abc the zebra", "\U0001f600 x", "q"]
    model = quality.collected(*quality.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")))["en"]
    keys, begins = quality.ngrams(*quality.codes_of(asked))
    bits = np.add.reduceat(model.log2(keys).astype(float), begins) / np.diff(np.append(begins, len(keys)))
    assert bits == pytest.approx(brute_log2(texts, asked), rel=1e-4)


def test_quality_is_trained_on_all_trusted_text(spark):
    """Scores are those of a direct recursion over all trusted texts of the language's other folds, or of all languages'."""
    draw = np.random.default_rng(5)
    words = ["ab", "cab", "bac", "aa", "c", "abba"]
    rows = [(i, " ".join(draw.choice(words, 4)) + f" {i}", "en" if i % 3 else "de") for i in range(60)]
    rows += [(900, "zab c", "xx"), (901, "abba cab", "en"), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    fold = {r.doc_id: r.f % 2 for r in docs.select("doc_id", quality.fold_hash().alias("f")).collect()}
    own, _ = quality.scored(docs, labels, train_docs=10)
    got = {r.doc_id: r.perplexity_ for r in own.collect()}
    for lang, asked in (("en", lambda x: x == "en"), ("de", lambda x: x == "de"), (None, lambda x: x not in ("en", "de"))):
        for f in (0, 1):
            seen = [t for i, t, x in rows[:60] if lang in (None, x) and fold[i] != f]
            mine = [(i, t or "") for i, t, x in rows if asked(x) and fold[i] == f]
            assert len(seen) > 5
            want = brute_log2(seen, [t for _, t in mine])
            assert [got[i] for i, _ in mine] == pytest.approx([2.0**-x for x in want], rel=1e-4)


def test_quality_keeps_callers_columns(spark, tables):
    """Columns named like those that the stages make come back as they were."""
    import corpus_pipeline as pipeline

    docs, _ = tables
    docs = docs.unionByName(docs.limit(30))
    names = ("n", "keep", "low", "high", "perplexity_", "l_", "b_", "fold_", "node_", "node", "spans_", "base_", "tokens_", "key_", "copies_", "rows_", "k", "row", "x0", "size", "target")
    rows = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, rows, SF)
        assert got.columns == rows.columns, name
        wrong = " or ".join(f"`{c}` is distinct from concat('{c}:', cast(doc_id as string))" for c in names)
        assert got.filter(wrong).isEmpty() and not got.isEmpty(), name
        assert stage(spark, rows.limit(0), SF).count() == 0


def test_lookup():
    draw = np.random.default_rng(0)
    keys = np.unique(draw.integers(0, 1 << 60, 5000))
    table = quality.Lookup(keys, np.arange(len(keys), dtype=float))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(table.get(keys + 1)[~np.isin(keys + 1, keys)]).all()


def test_toxicity(spark):
    """Trained on half of some 4,000 labels, held against the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").unionByName(odd(spark).drop("lang")).selectExpr("*", "1 as junk", "'x' as word")
    train = labels.filter("doc_id % 2 = 0")
    got = toxicity.classify(rows, train).toPandas()
    assert len(got) == rows.count()
    held = got.merge(labels.filter("doc_id % 2 = 1").toPandas(), on="doc_id")
    hit = held[held["toxic"] == 1]["is_toxic"].mean()
    assert hit > 0.6 and held[held["toxic"] == 0]["is_toxic"].mean() < 0.05
    assert not toxicity.classify(rows, labels.limit(0)).filter("is_toxic").count()
    assert toxicity.classify(rows.limit(0), labels).count() == 0


def newton(x, y, ridge=1.0):
    """Ridge logistic regression by Newton's method; the constant isn't held back."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w, hold = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + hold * w)
    return w


def test_chain_against_newton():
    """Each category's model has the earlier ones' out-of-fold predictions as further features, and predicts in a row."""
    draw = np.random.default_rng(8)
    x = (draw.random((400, 12)) < 0.3).astype(np.float32)
    y = np.stack([x[:, 0] + x[:, 1] > 1, x[:, 2] + x[:, 3] * draw.random(400) > 0.9, (x[:, 2] > 0) & (draw.random(400) < 0.7)], axis=1).astype(np.float32)
    fold = np.arange(400) % toxicity.FOLDS
    apply = lambda w, a: 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30)))
    seen, models = x.astype(float), []
    for c in range(3):
        out = np.zeros(400)
        for f in range(toxicity.FOLDS):
            out[fold == f] = apply(newton(seen[fold != f], y[fold != f, c]), seen[fold == f])
        models.append(newton(seen, y[:, c]))
        seen = np.hstack([seen, out[:, None]])
    want, now = [], x.astype(float)
    for w in models:
        want.append(apply(w, now))
        now = np.hstack([now, want[-1][:, None]])
    got = toxicity.Chain(x, y, fold).predict(x)
    assert np.abs(got - np.stack(want, axis=1)).max() < 0.01


def brute_license(text, templates):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found, sets = {}, {}
    for name, notice in templates.items():
        want = licenses.normal(notice)
        want = [tuple(want[i : i + 5]) for i in range(len(want) - 4)]
        sets[name] = set(want)
        width = len(want) if len(want) < 8 else 4 * (-(-len(want) // 4) + 1)
        step = 1 if len(want) < 8 else 4
        best = max(((len(set(grams[i : i + width]) & set(want)) / len(set(want)), -i) for i in range(0, max(1, len(grams)), step)), default=(0, 0))
        if best[0] >= 0.8:
            found[name] = (best[0], -best[1], width)
    # of matches at one place of templates that are mostly the same, the one contained most, then the longest
    rank = lambda n: (found[n][0], len(sets[n]))
    meet = lambda a, b: found[a][1] < found[b][1] + found[b][2] and found[b][1] < found[a][1] + found[a][2]
    return {n: f[0] for n, f in found.items() if not any(o != n and len(sets[n] & sets[o]) >= 0.8 * len(sets[n]) and meet(n, o) and rank(o) > rank(n) for o in found)}


def test_licenses(spark, tables):
    docs, _ = tables
    mit = licenses.TEMPLATES["MIT"]
    near = mit.replace("persons to whom", "people to whom")
    half = " ".join(mit.split()[:40])
    texts = [None, "", "Released under", "x y z Released under the MIT License. more", f"pre fix {mit} post", f"é {near} ö", half, "\n".join([licenses.TEMPLATES["Apache-2.0-line"]] * 300), f"{mit}\n{licenses.TEMPLATES['GPL-3.0']}", "Released under no license at all, the MIT one included.", f"x {licenses.TEMPLATES['BSD-3-Clause']} y", licenses.TEMPLATES["BSD-2-Clause"], licenses.TEMPLATES["AGPL-3.0"], f"{licenses.TEMPLATES['BSD-2-Clause']} {'filler ' * 200} {licenses.TEMPLATES['BSD-3-Clause']}"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: {x.template: x.containment for x in r.licenses_} for r in licenses.scan_licenses(rows).select("doc_id", "licenses_").collect()}
    for r in rows.collect():
        assert got[r.doc_id] == pytest.approx(brute_license(r.text, licenses.TEMPLATES)), r.doc_id
    assert [set(got[i]) for i in (900010, 900011, 900012)] == [{"BSD-3-Clause"}, {"BSD-2-Clause"}, {"AGPL-3.0"}]
    assert {"MIT"} <= set(got[900005]) and not got[900006] and not got[900009]
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def test_pipeline_stages_compose(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs.unionByName(docs.limit(20)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path)).cache()
        if name != "packing":
            assert now.columns == before.columns
    assert pipeline.run(spark, str(tmp_path)).count() == now.count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["quality", "simhash", "secrets", "mixing", "packing"]
