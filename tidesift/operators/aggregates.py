"""Aggregation, distribution by hash buckets, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(column: str | Column) -> Column:
    """A floating amount as a decimal, so that sums don't depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def money_sum(column: Column) -> Column:
    return F.sum(column).cast("decimal(38,4)")


def aggregate(df: DataFrame, keys: Sequence[str | Column] = (), having: str | Column | None = None, **sums: Column) -> DataFrame:
    """Groups and aggregates, partially before the shuffle; without keys one row."""
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    return out if having is None else out.where(having)


def aggregate_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, **sums: Column) -> DataFrame:
    """Groups dealt out to hash buckets of the keys. Rows are aggregated in each task before any of them move, so a key that holds
    a third of all rows sends a row a task; what is dealt out are groups."""
    return aggregate(df, keys, **sums).repartition(buckets, *keys)


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Adds _bucket_id; the hash is this engine's own, so ids mean nothing elsewhere."""
    return df.withColumn("_bucket_id", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, sort_by: Sequence[str] = ()) -> DataFrame:
    """Writes a folder for each bucket, each by one task, so that there are as many files as buckets. Gives back _bucket_id and
    rows of each bucket, 0 for those that got none and so have no folder."""
    from pyspark.sql import Observation

    seen = Observation()
    out = with_bucket(df, key, buckets).repartition(buckets, "_bucket_id")
    counts = [F.count(F.when(F.col("_bucket_id") == k, 1)).alias(str(k)) for k in range(buckets)]
    (out.sortWithinPartitions("_bucket_id", *sort_by) if sort_by else out).observe(seen, *counts).write.partitionBy("_bucket_id").parquet(path)
    return df.sparkSession.createDataFrame([(k, seen.get[str(k)]) for k in range(buckets)], "_bucket_id int, rows long")


def write_sorted(df: DataFrame, path: str, sort_by: Sequence[str] = (), parts: int | None = None, mode: str = "errorifexists") -> None:
    """Writes Parquet clustered by a key: ranges in files and order within, so that minima and maxima are tight."""
    if sort_by:
        df = df.repartitionByRange(parts, *sort_by) if parts else df.repartitionByRange(*sort_by)
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def combine(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
