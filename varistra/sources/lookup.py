"""A table for look-ups: sorted by its key into files, with secondary indexes, so that a query opens only files that can match.

A manifest has each file's smallest and largest key, a row a file; a secondary index is a narrow table (value, file) sorted
by value, with a manifest of its own. A look-up reads the manifests once, then index files and table files that it needs.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varistra.sources import shared


def write_indexed(df: DataFrame, path: str, key: str, indexed: dict[str, Column] | None = None, rows_per_file: int = 1_000_000) -> None:
    """K4: df under path, in files of about rows_per_file rows by ranges of key, with an index for each named expression.

    Null keys and null index values are kept and never found by a look-up; repeated keys may stand in two files."""

    def ranged(rows: DataFrame, by: str, where: str) -> None:
        files = max(1, -(-rows.count() // rows_per_file))
        rows.repartitionByRange(files, by).sortWithinPartitions(by).write.parquet(where)

    spark = df.sparkSession
    ranged(df, key, f"{path}/table")
    table = spark.read.schema(df.schema).parquet(f"{path}/table")
    manifest(table, key, f"{path}/manifest/table")
    for name, value in (indexed or {}).items():
        narrow = table.select(value.alias("value"), F.col("_metadata.file_name").alias("file")).filter("value is not null").distinct()
        narrow, _ = shared.stored(narrow, "index")
        ranged(narrow, "value", f"{path}/index/{name}")
        manifest(spark.read.schema(narrow.schema).parquet(f"{path}/index/{name}"), "value", f"{path}/manifest/{name}")
    about = {"key": key, "table": json.loads(df.schema.json()), "indexes": sorted(indexed or {})}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")


def manifest(rows: DataFrame, key: str, path: str) -> None:
    """(file, lo, hi, n) of each file of rows."""
    found = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    found.coalesce(1).write.parquet(path)


class Ranges:
    """Files by their ranges of keys."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(path)
        self.schema = T.StructType([T.StructField("value", rows.schema["lo"].dataType), T.StructField("file", T.StringType())])
        self.files = sorted(((r.lo, r.hi, r.file) for r in rows.filter("lo is not null").collect()), key=lambda x: x[:2])  # a row a file
        self.lows, self.highs = [f[0] for f in self.files], [f[1] for f in self.files]

    def matching(self, lo, hi) -> list[str]:
        """Ranges are sorted and meet in single keys at most, so those that overlap lo to hi stand together."""
        return [f for _, _, f in self.files[bisect_left(self.highs, lo) : bisect_right(self.lows, hi)]]


class IndexedTable:
    """Opens what ``write_indexed`` has written; ``opened`` lists the files that the last look-up chose."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.opened = spark, path, []
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.key, self.schema = about["key"], T.StructType.fromJson(about["table"])
        self.ranges = {name: Ranges(spark, f"{path}/manifest/{name}") for name in ["table", *about["indexes"]]}

    def _read(self, schema: T.StructType, folder: str, files: list[str]) -> DataFrame:
        self.opened += [f"{folder}/{f}" for f in files]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}/{f}" for f in files])

    def between(self, lo, hi) -> DataFrame:
        """Rows whose key is from lo to hi."""
        self.opened = []
        return self._read(self.schema, "table", self.ranges["table"].matching(lo, hi)).filter(F.col(self.key).between(lo, hi))

    def by_index(self, name: str, lo, hi) -> DataFrame:
        """Rows of those files that hold an index value from lo to hi; the caller filters the rows themselves."""
        self.opened = []
        ranges = self.ranges[name]
        found = self._read(ranges.schema, f"index/{name}", ranges.matching(lo, hi)).filter(F.col("value").between(lo, hi))
        files = sorted(r.file for r in found.select("file").distinct().collect())  # as many as files at most
        return self._read(self.schema, "table", files)

    def prefixed(self, name: str, prefix: str) -> DataFrame:
        """The same for index values that begin with prefix."""
        return self.by_index(name, prefix, prefix + "\U0010ffff")


_PREPARED: dict[tuple, IndexedTable] = {}


def prepared(df: DataFrame, name: str, key: str, indexed: dict[str, Column] | None = None, rows_per_file: int = 1_000_000) -> IndexedTable:
    """The indexed form of a stored table, made at its first use in this application and kept in the shared folder."""
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, name, key, *sorted(df.inputFiles()))
    if at not in _PREPARED:
        path = shared.scratch(spark, f"indexed-{name.replace('/', '-')[-40:]}")
        write_indexed(df, path, key, indexed, rows_per_file)
        _PREPARED[at] = IndexedTable(spark, path)
    return _PREPARED[at]
