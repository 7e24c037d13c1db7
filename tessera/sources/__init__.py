"""Edge lists in, communities out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two whole numbers at the start of a line, parted by white space or by the second one's sign; what follows doesn't matter.
EDGE = r"^\s*([+-]?\d+)(?:\s+([+-]?\d+)|([+-]\d+))"


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst (long) of the lines that hold an edge; other lines, and numbers beyond 32 bits, are dropped. A negative id is an error when rows are read."""
    def number(x: Column) -> Column:
        return x.try_cast("int").cast("long")

    second = F.concat(F.regexp_extract(column, EDGE, 2), F.regexp_extract(column, EDGE, 3))
    rows = lines.select(number(F.regexp_extract(column, EDGE, 1)).alias("src"), number(second).alias("dst")).where("src is not null and dst is not null")
    negative = (F.col("src") < 0) | (F.col("dst") < 0)
    return rows.withColumn("src", F.when(negative, F.raise_error(F.concat(F.lit("negative vertex id in edge "), F.col("src"), F.lit(" "), F.col("dst"))).cast("long")).otherwise(F.col("src")))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def community_lines(communities: DataFrame) -> DataFrame:
    """cluster_id, line: the members' ids joined by commas."""
    return communities.select("cluster_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("line"))


def write_communities(communities: DataFrame, path: str, form: str = "text") -> None:
    """A line per community (text), or rows with arrays (parquet); an existing folder is replaced."""
    if form == "text":
        community_lines(communities).select("line").write.mode("overwrite").text(path)
    else:
        communities.write.mode("overwrite").parquet(path)
