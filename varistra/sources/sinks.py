"""Sinks: parquet tables, typed JSON lines, staged publishing, key-value settings, manifests, caches."""

from __future__ import annotations

import json
import platform

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varistra.sources.readers import fingerprint


def serving_table(df: DataFrame, name: str, key: str, buckets: int = 16) -> None:
    """K1, K4: a table bucketed and sorted by its key, so lookups skip row groups and joins by key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def clean_number(c: Column, digits: int = 6) -> Column:
    """Null for NaN and infinities, else rounded."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.round(c, digits))


def typed_lines(df: DataFrame, key: str, aliases: dict[str, str] | None = None, longest_key: int = 2048) -> DataFrame:
    """K7: one JSON text a row: nulls, NaN and infinities left out, floats to 6 places; over-long or null keys are left out."""
    columns = [(clean_number(F.col(c)) if t in ("double", "float") else F.col(c)).alias((aliases or {}).get(c, c)) for c, t in df.dtypes]
    return df.filter(F.col(key).isNotNull() & (F.octet_length(F.col(key).cast("string")) <= longest_key)).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").text(path)


def publish(df: DataFrame, path: str, key: str, least: int = 1) -> int:
    """K8: write beside the target, check count, uniqueness and nulls of the key on what was written, then swap; returns the rows."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    P = jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    n, distinct, keys = spark.read.parquet(staged).agg(F.count(F.lit(1)), F.countDistinct(key), F.count(key)).first()
    if n < least or distinct != n or keys != n:
        raise ValueError(f"not published: {n} rows, {keys} keys, {distinct} distinct")
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(P(old), True)
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    if not fs.rename(P(staged), P(path)):
        fs.rename(P(old), P(path))
        raise OSError(f"{path} couldn't be replaced")
    fs.delete(P(old), True)
    return n


def insert_absent(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key isn't there yet (one each); returns those appended."""
    spark = new.sparkSession
    rows = new.filter(F.col(key).isNotNull()).dropDuplicates([key])
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    return rows


def settings(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """K3, K5: (key, value): settings as JSON texts."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(values.items())], "key string, value string")


def settings_of(df: DataFrame, key: str) -> DataFrame:
    """K3, K5: (key, value): each row's other columns as a JSON text."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))


def materialise_views(spark: SparkSession, views: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """K6: write each view under its name, with a header for CSV; returns the paths."""
    out = []
    for name, df in views.items():
        df.createOrReplaceTempView(name)
        w = spark.table(name).write.mode("overwrite")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out


def label_arrays(long: DataFrame, ids: DataFrame, key: str, head: str, value: str) -> DataFrame:
    """K9: (head, labels): a head's values in the order of ids(key, place); missing ones null."""
    grid = ids.crossJoin(F.broadcast(long.select(head).distinct())).join(long, [key, head], "left")  # ids by heads, which is the output
    return grid.groupBy(head).agg(F.sort_array(F.collect_list(F.struct("place", value))).alias("x")).select(head, F.transform("x", lambda e: e[value]).alias("labels"))


def manifest(tables: dict[str, DataFrame], config: dict[str, object]) -> dict[str, object]:
    """Content hashes, settings and environment of a run."""
    return {"tables": {k: fingerprint(df, df.columns) for k, df in sorted(tables.items())}, "config": config, "python": platform.python_version()}


def item_files(df: DataFrame, path: str, key: str) -> None:
    """Each row as JSON in a file of its own, under a folder named by its key; tasks write their own rows."""
    (df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).repartition(F.col(key)).write.option("maxRecordsPerFile", 1).partitionBy(key).mode("overwrite").text(path))
