"""A catalog of Parquet files from their footers, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN = "struct<path_in_schema:string,name:string,compressed_size:bigint>"
GROUP = f"struct<id:int,num_rows:bigint,total_byte_size:bigint,columns:array<{COLUMN}>,stats:map<string,struct<min:string,max:string,nulls:bigint>>>"
FOOTER = f"full_path string, size_bytes long, num_rows long, num_row_groups int, num_columns int, row_groups array<{GROUP}>"


def _opened(path: str):
    """A file's bytes at random access by Arrow's own filesystems, which read no more than the footer."""
    from urllib.parse import unquote

    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{unquote(path.removeprefix('file:'))}")
    return system.open_input_file(inner)


def _footers(rows):
    import io

    import pandas as pd
    import pyarrow.parquet as pq

    for batch in rows:
        out = []
        contents = batch["content"] if "content" in batch else [None] * len(batch)
        for path, size, content in zip(batch["path"], batch["length"], contents, strict=True):
            with _opened(path) if content is None else io.BytesIO(content) as file:
                meta = pq.ParquetFile(file).metadata
                out.append((path, size, meta.num_rows, meta.num_row_groups, meta.num_columns, [_group(g, meta.row_group(g)) for g in range(meta.num_row_groups)]))
        yield pd.DataFrame(out, columns=["full_path", "size_bytes", "num_rows", "num_row_groups", "num_columns", "row_groups"])


def _group(number: int, group) -> dict:
    columns, stats = [], {}
    for c in range(group.num_columns):
        chunk = group.column(c)
        columns.append({"path_in_schema": chunk.path_in_schema, "name": chunk.path_in_schema.split(".")[0], "compressed_size": chunk.total_compressed_size})
        s = chunk.statistics
        if s is not None and s.has_min_max:
            stats[chunk.path_in_schema] = {"min": str(s.min), "max": str(s.max), "nulls": s.null_count}
    return {"id": number, "num_rows": group.num_rows, "total_byte_size": group.total_byte_size, "columns": columns, "stats": stats}


def footer_stats(spark: SparkSession, *paths: str, pattern: str = "*.parquet") -> DataFrame:
    """A row for each file: sizes, rows, and its row groups with column sizes, minima and maxima.

    Spark lists the files and deals them to the executors, which read the footers alone. Only in a store that Arrow can't
    open by its address does Spark read the whole files for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths))
    scheme = paths[0].split(":", 1)[0] if "://" in paths[0] else "file"
    columns = ["path", "length"] if scheme in ("file", "s3", "gs", "hdfs", "abfs", "abfss") else ["path", "length", "content"]
    return files.select(*columns).mapInPandas(_footers, FOOTER)


def row_groups(footers: DataFrame) -> DataFrame:
    """A row for each row group: full_path, rg_id, num_rows, size_bytes (compressed), stats."""
    g = footers.select("full_path", F.explode("row_groups").alias("g"))
    size = F.aggregate("g.columns", F.lit(0).cast("long"), lambda a, c: a + c["compressed_size"])
    return g.select("full_path", F.col("g.id").alias("rg_id"), F.col("g.num_rows").alias("num_rows"), size.alias("size_bytes"), F.col("g.stats").alias("stats"), F.col("g.columns").alias("columns"))


def selected_size(groups: DataFrame, columns: list[str]) -> DataFrame:
    """Adds selected_bytes, the compressed bytes of some columns of each row group."""
    chosen = F.filter("columns", lambda c: c["name"].isin(columns))
    return groups.withColumn("selected_bytes", F.aggregate(chosen, F.lit(0).cast("long"), lambda a, c: a + c["compressed_size"]))


def catalog(footers: DataFrame, depth: int = 1, exclude: str | None = None) -> DataFrame:
    """dataset, num_files, total_rows, total_size_bytes and averages; a dataset is the path's ``depth``-th folder or file name
    from the end. Paths that match the regular expression ``exclude`` don't count."""
    f = footers if exclude is None else footers.where(~F.col("full_path").rlike(exclude))
    name = F.regexp_replace(F.element_at(F.split("full_path", "/"), -depth), r"\.parquet$", "")
    return f.groupBy(name.alias("dataset")).agg(
        F.count("*").alias("num_files"), F.sum("num_rows").alias("total_rows"), F.sum("size_bytes").alias("total_size_bytes"),
        F.avg("num_rows").alias("avg_rows_per_file"), F.avg("size_bytes").alias("avg_size_per_file"))


def search(footers: DataFrame, pattern: str) -> DataFrame:
    """Files whose path matches a regular expression."""
    return footers.where(F.col("full_path").rlike(pattern))


def save(footers: DataFrame, path: str) -> None:
    footers.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOOTER).json(path)


def folder_summary(spark: SparkSession, path: str, delete: bool = False) -> dict[str, float]:
    """files, bytes and average bytes of data below a folder of any store; then deletes it if asked to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    files = size = 0
    if fs.exists(where):
        found = fs.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName()[0] not in "_.":  # marks of writers
                files, size = files + 1, size + f.getLen()
        if delete:
            fs.delete(where, True)
    return {"files": files, "bytes": size, "avg_bytes": size / files if files else 0.0}
