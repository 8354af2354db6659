"""Text sources: lines, separated tokens, metrics in Prometheus' text format, and JSON run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sample of a labelled counter: name{labels} value.
SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)\{([^}]*)\}\s+([0-9.eE+-]+)"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """line: one row for each line of text files."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "line")


def tokens(df: DataFrame, column: str = "line", separator: str = ",") -> DataFrame:
    """value: one row for each token between separators."""
    import re

    return df.select(F.explode(F.split(column, re.escape(separator))).alias("value"))


def metrics(df: DataFrame, column: str = "line", name: str | None = None) -> DataFrame:
    """name, api, bucket and value of the counter samples among lines; comments and other lines are none."""
    d = df.where(F.col(column).rlike(SAMPLE))
    labels = F.regexp_extract(column, SAMPLE, 2)
    d = d.select(F.regexp_extract(column, SAMPLE, 1).alias("name"), F.regexp_extract(labels, r'api="([^"]*)"', 1).alias("api"),
                 F.regexp_extract(labels, r'bucket="([^"]*)"', 1).alias("bucket"), F.regexp_extract(column, SAMPLE, 3).cast("double").alias("value"))
    return d if name is None else d.where(F.col("name") == name)


def request_kind(api: str = "api"):
    """read, write, delete, metadata or other, by a request's name."""
    a = F.lower(api)
    return (F.when(a.rlike("^(get|select)object"), "read").when(a.rlike("^(put|copy|complete|new|upload|post)"), "write").when(a.rlike("^delete"), "delete")
            .when(a.rlike("^(head|list|get|stat)"), "metadata").otherwise("other"))


def request_diff(before: DataFrame, after: DataFrame, bucket: str | None = None) -> DataFrame:
    """kind, requests: what counters grew by between two snapshots of ``metrics``; one that is new grew from 0."""
    key = ["name", "api", "bucket"]
    b, a = (d.groupBy(*key).agg(F.max("value").alias(n)) for d, n in ((before, "b"), (after, "a")))
    d = b.join(a, key, "full_outer").withColumn("grown", F.greatest(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), F.lit(0.0)))
    d = d if bucket is None else d.where(F.col("bucket") == bucket)
    return d.groupBy(request_kind().alias("kind")).agg(F.sum("grown").alias("requests"))


def run_diffs(snapshots: DataFrame) -> DataFrame:
    """system, run, kind, requests: what counters grew by since the run before of the same system.

    snapshots: system, run, api, bucket, value, runs in order of their names. A system's first run has none before it and no
    row; a counter that the run before lacks grew from 0. Only the list of runs is numbered in one window.
    """
    from pyspark.sql import Window

    s = snapshots.groupBy("system", "run", "api", "bucket").agg(F.max("value").alias("value"))
    order = Window.partitionBy("system").orderBy("run")
    runs = s.select("system", "run").distinct().select("system", "run", F.lead("run").over(order).alias("_next"), F.lag("run").over(order).alias("_last"))
    # each sample counts for its own run and is taken off in the next one; a counter that shrank was reset
    t = s.join(runs, ["system", "run"])
    sides = F.array(F.struct(F.when(F.col("_last").isNotNull(), F.col("run")).alias("at"), F.col("value").alias("now"), F.lit(None).cast("double").alias("was")),
                    F.struct(F.col("_next").alias("at"), F.lit(None).cast("double").alias("now"), F.col("value").alias("was")))
    t = t.select("system", "api", "bucket", F.inline(sides)).where("at is not null")
    grown = t.groupBy("system", "at", "api", "bucket").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    grown = grown.withColumn("grown", F.greatest(F.lit(0.0), F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
    return grown.groupBy("system", F.col("at").alias("run"), request_kind().alias("kind")).agg(F.sum("grown").alias("requests"))


def run_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Step logs of runs, nested tasks included, one row a step file."""
    return spark.read.option("multiLine", "true").json(list(paths)).withColumn("file", F.input_file_name())
