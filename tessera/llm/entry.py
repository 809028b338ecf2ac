"""Queries and SQL of the operators of this folder, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import edited

    return edited(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import found_spans, listed

    rows = found_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base_", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  (a second parameter would be the index)
    n = [of(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *n, F.sha2(listed(F.col("base_")), 256).alias("base_sha256"), listed(F.col("spans_")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file()).drop("piece")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("licenses_").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses_", lambda x: x["template"]), ",").alias("licenses"),
        F.array_join(F.transform("licenses_", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("word_spans"),
        F.array_max(F.transform("licenses_", lambda x: x["containment"])).alias("containment"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_nearest, op3_mixing, op4_secrets, op5_quality, op6_simhash, op7_packing, op8_lm, op9_licenses, op10_toxicity)}


NEAREST = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
  g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  f AS (SELECT vec_id, min(v) AS v FROM g WHERE len(v) = (SELECT len(v) FROM g GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1) GROUP BY vec_id),
  p AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])), lambda x, y: x + y)) AS score
        FROM f a JOIN f b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash with XXH64, tokenize, draw or train, which SQL can't express; tests hold them against plain Python."""
    return {"op2_nearest": NEAREST}
