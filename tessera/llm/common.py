"""What the operators of this folder share: words, written tables and native array helpers."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts within text_batches.
BATCH_ROWS = 1_000
#: Bits of a map of ids that travels to the tasks (4 MB).
ID_BITS = 1 << 25


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. Lost executors lose nothing.

    by: columns whose values have folders of their own. Tables stay until cleared() of tessera.sources.shared, as results are read from them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what is executed passes BATCH_ROWS rows at once at most to Python. Of texts of a few KB Spark's 10,000 rows
    are some 30 MB, which the JVM and the worker hold several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeps_columns(*core: str) -> Callable:
    """For functions of docs that return rows of docs: within, all columns but the core ones have names of their own
    (x0, x1, ...), so that no caller's column, whatever its name, meets one that the function makes."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def use(docs: DataFrame, *args, **kwargs) -> DataFrame:
            inner = [c if c in core else f"x{i}" for i, c in enumerate(docs.columns)]
            return f(docs.toDF(*inner), *args, **kwargs).select(*inner).toDF(*docs.columns)

        return use

    return wrap


def mapped(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id, each once), and few others: a bitmap of ID_BITS hashes of ids travels to
    the tasks. A join must still decide; it shuffles little more than the rows wanted."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_BITS)) + 1
    maps = ids.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("map_"))
    rows = docs.withColumn("h_", at).withColumn("bucket_", F.bitmap_bucket_number("h_")).withColumn("bit_", F.bitmap_bit_position("h_")).join(F.broadcast(maps), "bucket_")
    held = rows.filter(F.expr("shiftright(cast(conv(hex(substring(map_, cast(bit_ div 8 as int) + 1, 1)), 16, 10) as int), cast(bit_ % 8 as int)) & 1") == 1)
    return held.select(*docs.columns)


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """The words of a text as an array, natively."""
    return F.array_remove(F.split(text, GAP, -1), "")


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running op over an array (an inclusive prefix scan) in log2(size) passes, natively."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values) - F.lit(0.5))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, step: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), step)
        return F.transform(acc, lambda x, i: F.when(i < back, x).otherwise(op(x, F.get(acc, i - back))))

    return F.reduce(steps, values, double)


def portions(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of text (one row at least), so that memory doesn't follow the batch."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


@functools.cache
def tokenizer(path: str):
    """A tokenizer file, loaded once a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
