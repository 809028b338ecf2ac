"""A store of revisions: import, checked commits, rebase over re-imports, exports, and values by key.

A log is a table (doc_id, rev, op, text, digest) whose texts are canonical. Many documents are written at once; each is
checked against its own head. RevisionStore keeps a log in a folder: data is written first, its record last, so readers see
whole commits only, and of two writers at once the second is refused and may try again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import slug
from tessera.operators import diffs, revisions
from tessera.sources.shared import stored

#: What formats a name's end stands for.
FORMATS = {"docx": "document", "hwpx": "document", "pptx": "presentation", "xlsx": "spreadsheet", "md": "document"}
LOG = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("rev", T.LongType()), T.StructField("op", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType())])


class Stale(RuntimeError):
    """Another writer has committed since; read again and retry."""


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fresh_ids(names: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """names with id: a name's slug, and from its second use on, those in taken (id) included, with -2, -3, ... The first by
    name has the plain one."""
    own = names.withColumn("slug_", slug(F.col(name)))
    used = taken.select("id").withColumn("slug_", F.regexp_replace("id", r"-[0-9]+\z", "")).withColumn("n_", F.coalesce(F.regexp_extract("id", r"-([0-9]+)\z", 1).try_cast("int"), F.lit(1)))
    both = used.select("slug_", "n_").unionByName(used.select(F.col("id").alias("slug_"), F.lit(1).alias("n_")))
    last = both.groupBy("slug_").agg(F.max("n_").alias("n_"))
    k = F.row_number().over(Window.partitionBy("slug_").orderBy(name)) + F.coalesce("n_", F.lit(0))
    return own.join(last, "slug_", "left").withColumn("id", F.when(k == 1, F.col("slug_")).otherwise(F.concat_ws("-", "slug_", k.cast("string")))).drop("slug_", "n_")


def opened(files: DataFrame, log: DataFrame) -> DataFrame:
    """files (name, text) -> (doc_id, name, format, rev, op, text, digest): revision 1 of each, under an id of its own; names
    of no known format are refused (format and rev are null)."""
    end = F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), end)
    own = fresh_ids(files, log.select(F.col("doc_id").alias("id")).distinct()).withColumn("format", kind)
    return own.select(F.col("id").alias("doc_id"), "name", "format", F.when(F.col("format").isNotNull(), F.lit(1)).cast("long").alias("rev"), F.lit("import").alias("op"), "text", digest(F.col("text")).alias("digest"))


def gated(log: DataFrame, writes: DataFrame) -> DataFrame:
    """writes (doc_id, base, op) with head and state: unknown (no such document, or no such base), clean (the base is the
    head), rebase (all later revisions are re-imports) or stale. Range operations (op ops) are never rebased, re-imports
    neither. One equi-join, aggregated."""
    own = log.select(F.col("doc_id").alias("d_"), "rev", F.col("op").alias("o_"))
    later = F.col("rev") > F.col("base")
    keys = writes.columns
    both = writes.join(own, F.col("doc_id") == F.col("d_"), "left").groupBy(*keys).agg(F.max("rev").alias("head"), F.bool_or(F.col("rev") == F.col("base")).alias("has_"), F.coalesce(F.bool_or(later & (F.col("o_") != "reimport")), F.lit(False)).alias("other_"))
    state = F.when(~F.coalesce("has_", F.lit(False)), "unknown").when(F.col("head") == F.col("base"), "clean").when(F.col("other_") | F.col("op").isin("ops", "reimport"), "stale").otherwise("rebase")
    return both.withColumn("state", state).drop("has_", "other_")


def committed(log: DataFrame, writes: DataFrame) -> DataFrame:
    """log (doc_id, rev, op, text, digest), writes (doc_id, base, op, text) -> (doc_id, base, op, state, rev, text, digest).

    state: committed, rebased (merged line by line onto the head), conflict, unchanged (equal to the head: no revision),
    stale or unknown; rev, text and digest are those to be stored, null where nothing is. Of several writes of a document
    the first by base and op is taken, others are stale.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("base", "op", "text"))
    first = stored(writes.withColumn("k_", rank), "writes")
    own = gated(log, first.filter("k_ = 1").select("doc_id", "base", "op")).join(first.filter("k_ = 1").drop("k_"), ["doc_id", "base", "op"])
    texts = log.select(F.col("doc_id").alias("d_"), F.col("rev").alias("r_"), F.col("text").alias("t_"))
    at = lambda rev, name: texts.select(F.col("d_").alias("doc_id"), F.col("r_").alias(rev), F.col("t_").alias(name))
    both = own.join(at("base", "base_"), ["doc_id", "base"], "left").join(at("head", "head_"), ["doc_id", "head"], "left")
    both = both.withColumn("m_", F.when(F.col("state") == "rebase", diffs.merge3("base_", "text", "head_")))
    new = F.when(F.col("state") == "clean", F.col("text")).when(F.col("state") == "rebase", F.col("m_.merged"))
    both = both.withColumn("new_", new)
    state = F.when(F.col("state").isin("unknown", "stale"), F.col("state")).when(F.col("new_").isNull() & (F.col("state") == "rebase"), "conflict").when(F.col("new_").eqNullSafe(F.col("head_")), "unchanged").when(F.col("state") == "clean", "committed").otherwise("rebased")
    done = state.isin("committed", "rebased")
    out = both.select("doc_id", "base", "op", state.alias("state"), F.when(done, F.col("head") + 1).alias("rev"), F.when(done, F.col("new_")).alias("text"), F.when(done, digest(F.col("new_"))).alias("digest"))
    rest = first.filter("k_ > 1").select("doc_id", "base", "op", F.lit("stale").alias("state"), F.lit(None).cast("long").alias("rev"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("digest"))
    return out.unionByName(rest)


def diff_revisions(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, a, b) -> (doc_id, a, b, diff): the unified diff of two revisions; equal ones have an empty one."""
    side = lambda rev, name: log.select("doc_id", F.col("rev").alias(rev), F.col("text").alias(name))
    both = pairs.join(side("a", "ta_"), ["doc_id", "a"]).join(side("b", "tb_"), ["doc_id", "b"])
    same = F.col("ta_").eqNullSafe(F.col("tb_"))
    return both.select("doc_id", "a", "b", F.when(same, "").otherwise(diffs.unified("ta_", "tb_")).alias("diff"))


def exported(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, rev: null for the head) -> (doc_id, rev, text, digest)."""
    heads = revisions.heads(log).select("doc_id", "head")
    at = wanted.join(heads, "doc_id").select("doc_id", F.coalesce("rev", "head").alias("rev"))
    return at.join(log.select("doc_id", "rev", "text", "digest"), ["doc_id", "rev"])


def latest(entries: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq") -> DataFrame:
    """entries (keys, seq, value) -> (keys, value): the value put last under each key, null ones (taken out) gone."""
    return entries.groupBy(*keys).agg(F.max_by("value", seq).alias("value")).filter("value is not null")


class RevisionStore:
    """A log in a shared folder, with any Hadoop file system below it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def records(self) -> list[str]:
        """The names of the commits' folders, in order."""
        out, n = [], 0
        while self.fs.exists(self._file(f"records/{n}")):
            stream = self.fs.open(self._file(f"records/{n}"))
            out.append(stream.readUTF())
            stream.close()
            n += 1
        return out

    def log(self) -> DataFrame:
        held = self.records()
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{x}" for x in held]) if held else self.spark.createDataFrame([], LOG)

    def append(self, rows: DataFrame, seen: int) -> None:
        """Adds rows to the log that had seen commits when they were made, or raises Stale."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*[f.name for f in LOG]).write.parquet(f"{self.path}/{name}")
        try:
            stream = self.fs.create(self._file(f"records/{seen}"), False)  # there is one file of a name
        except Exception as e:
            self.fs.delete(self._file(name), True)
            raise Stale(f"commit {seen} is there") from e
        stream.writeUTF(name)
        stream.close()

    def open(self, files: DataFrame) -> DataFrame:
        """Imports files (name, text); gives what opened() gives, with refused ones left out of the log."""
        seen = len(self.records())
        new = stored(opened(files, self.log()), "opened")
        self.append(new.filter("rev is not null"), seen)
        return new

    def commit(self, writes: DataFrame) -> DataFrame:
        """Writes of many documents; gives what committed() gives. Nothing is stored if nothing is to be."""
        seen = len(self.records())
        new = stored(committed(self.log(), writes), "committed")
        keep = new.filter("rev is not null")
        if not keep.isEmpty():
            self.append(keep, seen)
        return new
