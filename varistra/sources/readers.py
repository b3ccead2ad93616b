"""Sources: text tables, JSON and zipped JSON sets, Arrow and tensor files, catalogs."""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The scan reads only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_schema(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and types, from the footer alone."""
    return dict(spark.read.parquet(path).dtypes)


def annotations(spark: SparkSession, path: str, key: str, need: DataFrame, columns: list[str]) -> DataFrame:
    """S3: the rows of a table whose key is needed, pruned to the columns that it has."""
    df = spark.read.parquet(path)
    return df.select(key, *[c for c in columns if c in df.columns]).join(need.select(key), key, "left_semi")


def wide_csv(spark: SparkSession, path: str, ids: list[str], name: str, value: str, most_columns: int = 100_000) -> DataFrame:
    """A wide numeric matrix with a header in long form; blanks and NaN are left out."""
    df = spark.read.option("header", True).option("maxColumns", most_columns).csv(path)
    rest = [c for c in df.columns if c not in ids]
    quoted = ", ".join("'{}', `{}`".format(c.replace("\\", "\\\\").replace("'", "\\'"), c.replace("`", "``")) for c in rest)
    long = df.selectExpr(*[f"`{i}`" for i in ids], f"stack({len(rest)}, {quoted}) as (`{name}`, `raw`)")
    number = F.col("raw").try_cast("double")
    return long.select(*ids, name, number.alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))


def delimited(spark: SparkSession, path: str, sep: str, columns: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """Separated text, all as strings; with ``columns`` the file has no header."""
    r = spark.read.option("sep", sep).option("inferSchema", False)
    if comment:
        r = r.option("comment", comment)
    return r.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else r.option("header", True).csv(path)


SETS = "array<struct<complex_id: bigint, complex_name: string, subunits: array<struct<swissprot: struct<gene_name: string>>>>>"


def gene_sets(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(set_id, set_name, gene): nested JSON sets with at least ``least`` named members; genes in capitals."""
    rows = spark.read.schema("complex_id bigint, complex_name string, subunits array<struct<swissprot: struct<gene_name: string>>>").option("multiLine", True).json(path)
    genes = F.array_distinct(F.filter(F.transform("subunits", lambda s: F.upper(F.trim(s["swissprot"]["gene_name"]))), lambda g: g.isNotNull() & (g != "")))
    return rows.select(F.col("complex_id").alias("set_id"), F.col("complex_name").alias("set_name"), genes.alias("genes")).filter(F.size("genes") >= least).select("set_id", "set_name", F.explode("genes").alias("gene"))


def zipped_sets(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """(set_id, set_name, gene): JSON lists in ZIP files, one organism, members split at ``;``."""

    def unzip(frames):
        import zipfile

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        for x in json.loads(z.read(name)):
                            yield pd.DataFrame([(x.get("ComplexID"), x.get("ComplexName"), x.get("Organism"), x.get("subunits(Gene name)"))], columns=["set_id", "set_name", "organism", "genes"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "set_id long, set_name string, organism string, genes string")
    items = F.explode(F.array_distinct(F.filter(F.transform(F.split("genes", ";"), lambda g: F.upper(F.trim(g))), lambda g: g != "")))
    return rows.filter(F.col("organism") == organism).select("set_id", "set_name", items.alias("gene"))


def arrow_ipc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files, batch by batch."""

    def run(batches):
        import pyarrow as pa

        names = None
        for batch in batches:
            for content in batch.column(0):
                source = pa.BufferReader(content.as_buffer())
                try:
                    reader = pa.ipc.open_file(source)
                    found = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    found = pa.ipc.open_stream(pa.BufferReader(content.as_buffer()))
                for b in found:
                    names = names or [c.strip().split()[0].strip("`") for c in schema.split(",")]
                    yield b.select(names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def tensor_chunks(spark: SparkSession, path: str, name: str = "activations") -> DataFrame:
    """(chunk, offset, v): rows of a named tensor in files with a JSON header (length first, as safetensors has it)."""

    def run(frames):
        import numpy as np
        import pandas as pd

        kinds = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}
        for frame in frames:
            for file, raw in zip(frame["path"], frame["content"]):
                n = int.from_bytes(raw[:8], "little")
                about = json.loads(raw[8 : 8 + n])[name]
                a, b = about["data_offsets"]
                body = raw[8 + n + a : 8 + n + b]
                if about["dtype"] == "BF16":
                    flat = (np.frombuffer(body, "<u2").astype("<u4") << 16).view("<f4")
                else:
                    flat = np.frombuffer(body, kinds[about["dtype"]]).astype("<f4")
                rows = flat.reshape(about["shape"][0], -1)
                chunk = file.rsplit("/", 1)[1].rsplit(".", 1)[0]
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    yield pd.DataFrame({"chunk": chunk, "offset": range(at, at + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "chunk string, offset long, v array<float>")


def gather(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of chunks by an index (id, chunk, offset)."""
    return index.join(chunks, ["chunk", "offset"]).select("id", "v")


def census(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(family, type, columns): how many columns of each type a family has; '' for the rest."""
    from varistra.operators.schema import family

    rows = [((family(c, prefixes) or ("", ""))[0], t) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "family string, type string").groupBy("family", "type").agg(F.count(F.lit(1)).alias("columns"))


def cached(spark: SparkSession, path: str, fingerprint: str, make) -> DataFrame:
    """The table stored under this fingerprint of its inputs, else made and stored."""
    at = f"{path}/{fingerprint}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A content hash that doesn't depend on the order of rows."""
    h: Column = F.xxhash64(*columns).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.lit("x"), *columns)).alias("x")).first()
    return f"{r.n}-{r.s}-{r.x}"


def vocabulary(spark: SparkSession, heads: dict[str, dict]) -> DataFrame:
    """heads' settings as rows; a missing setting is null."""
    rows = [(k, v.get("n_classes"), v.get("kind"), v.get("category"), v.get("display_name"), v.get("group")) for k, v in sorted(heads.items())]
    return spark.createDataFrame(rows, "head string, n_classes int, kind string, category string, display_name string, group string")


def vocabulary_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON files, one head a line."""
    return spark.read.schema("head string, n_classes int, kind string, category string, display_name string, `group` string").json(path)
