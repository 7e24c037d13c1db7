"""What the operators share: shared folders, stable numbering, held-out marks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..operators.store import cut as stored
from ..operators.store import drop, shared_dir


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def numbered(df: DataFrame, keys: list[str], salt: Column, order: list[Column], name: str, largest: int, per_task: int = 50_000) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within equal keys, without any task holding a whole key.

    Each key's rows are split by `salt` (a hash) into parts of about per_task rows; parts are counted, and each part's numbers begin
    after those of the parts before it. `largest` is the row count of the largest key. The part counts are joined, not broadcast by force.
    """
    parts = max(1, -(-largest // per_task))
    df = df.withColumn("_part", F.pmod(salt, F.lit(parts)).cast("int"))
    sizes = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    out = df.withColumn("_rank", rank)
    right = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], "_before")
    cond = None
    for i, k in enumerate([*keys, "_part"]):
        c = out[k] == right[f"_k{i}"]
        cond = c if cond is None else cond & c
    return out.join(right, cond).withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: from now on batches for Python hold at most 2,000 rows in this session, unless it has chosen another number than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, "2000")


def bounded(query: Callable) -> Callable:
    """A query (its first argument is the session) that runs with small_batches()."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        small_batches(spark)
        return query(spark, *args)

    return run


def held_out(n: int) -> Column:
    """Whether crc32 of doc_id as text is 0 modulo n; a row without an id is held out."""
    return F.coalesce(bucket_of(F.col("doc_id"), n) == 0, F.lit(True))


def kept_fields(docs: DataFrame, keep: tuple[str, ...], made: tuple[str, ...]) -> list[StructField]:
    """The fields of the columns to keep. One with the name of a column that the operator makes is an error, as the result would have two."""
    twice = sorted(set(keep) & set(made))
    if twice:
        raise ValueError(f"columns to keep have names of result columns: {', '.join(twice)}")
    return [f for f in docs.schema.fields if f.name in keep]
