"""WARC archives and the resolution of revisits.

``write_archives`` writes a response record for each page, one archive for each task. ``read_records`` reads records
of a folder of archives. ``resolve`` shuffles the records' headers (never payloads) by payload digest and finds, of
equal payloads, the response that the others revisit. ``rewrite`` deals the decisions by archive, reads each archive
once and writes it anew with fresh headers: responses keep their payload, revisits only refer to it.

Archives are WARC 1.1, one gzip member to a record. Record ids are ``urn:page:<page_id>``. Besides the standard
fields a record has ``WARC-Payload-Length``, the bytes of its full payload, so a revisit tells that too.

Defined results. A null html counts as an empty payload, a null url as an empty target. Null page_ids are smaller
than any other and their records' id is ``urn:page:none``. Of repeated rows of one page_id one is the response.
Payloads under ``min_bytes`` are all responses. Control characters in urls are percent-encoded. Other columns are
ignored, whatever their names. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistra.llm import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, archive string, record int"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(text: str | None) -> int | None:
    name = (text or "").rpartition(":")[2].rstrip(">")
    return None if name in ("", "none") else int(name)


def safe_url(url: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def response(page_id: int | None, url: str, digest: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    return pack(fields, http + payload)


def revisit(page_id: int | None, url: str, digest: str, size: int, target_id: int | None, target_url: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target_id)), ("WARC-Refers-To-Target-URI", target_url), ("WARC-Refers-To-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    return pack(fields, http)


def members(stream, chunk: int = 1 << 20):
    """The bytes of each gzip member of an open archive."""
    inflate, held = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        held.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(held)
            inflate, held = zlib.decompressobj(31), []
        if not data:
            data = stream.read(chunk)
    if any(held):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, out: str) -> str:
    """A response record for each of pages(page_id, url, html), in archives under the shared folder out; returns out."""

    def run(batches):
        import pyarrow as pa

        name, n = f"{out}/part-{TaskContext.get().partitionId():06d}.warc.gz", [0]

        def write(f):
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    payload = html or b""
                    f.write(response(page_id, safe_url(url), digest_of(payload), payload))
                    n[0] += 1

        common.put_file(name, write)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n[0]], pa.int64())], ["archive", "records"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write_list(chosen.mapInArrow(run, "archive string, records long"), out)
    return out


def _write_list(archives: DataFrame, out: str) -> None:
    """The list of archives of a folder, a table beside them; writing it runs the tasks."""
    archives.filter("records > 0").write.mode("overwrite").parquet(f"{out}/list")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """A row for each record of a folder of archives."""
    archives = spark.read.parquet(f"{out}/list").select("archive")

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                where, path = common.store(archive)
                rows = []
                with where.open_input_stream(path, compression=None) as f:
                    for at, raw in enumerate(members(f)):
                        x, block = parse(raw)
                        kind, digest, size = x["WARC-Type"], x["WARC-Payload-Digest"].removeprefix("sha1:"), int(x["WARC-Payload-Length"])
                        if kind == "response" and len(block.partition(b"\r\n\r\n")[2]) != size:
                            raise ValueError(f"{archive}: a payload isn't as long as its header says")
                        rows.append((page_of(x["WARC-Record-ID"]), kind, x["WARC-Target-URI"], digest, size, page_of(x.get("WARC-Refers-To")), archive, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    return archives.repartition(n).mapInArrow(run, RECORD)


def resolve(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records with the decision for each: response (refers_to null) or revisit of the record with the largest page_id of the same digest and size."""
    keyed = records.drop("record_type", "refers_to").withColumn("salt", F.pmod(F.xxhash64("archive", "record"), F.lit(common.SALTS)).cast("int"))
    large = keyed.filter(F.col("payload_bytes") >= min_bytes)
    best = F.max(F.struct("page_id", "archive", "record", "url"))
    parts = large.groupBy("payload_digest", "payload_bytes", "salt").agg(best.alias("best"))
    tops = parts.groupBy("payload_digest", "payload_bytes").agg(F.max("best").alias("best"), F.collect_list("salt").alias("salts"))  # at most SALTS rows to a digest
    tops = tops.select("payload_digest", "payload_bytes", "best", F.explode("salts").alias("salt"))
    both = keyed.join(tops.hint("merge"), ["payload_digest", "payload_bytes", "salt"], "left")
    first = F.col("best").isNull() | ((F.col("best.archive") == F.col("archive")) & (F.col("best.record") == F.col("record")))
    return both.select("archive", "record", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("best.page_id")).alias("refers_to"), F.when(~first, F.col("best.url")).alias("refers_url"))


def rewrite(spark: SparkSession, decisions: DataFrame, source: str, out: str) -> str:
    """The archives of source again, deduplicated, under out; decisions are those of resolve. Returns out."""

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

        todo = rows()
        row = next(todo, None)
        while row is not None:
            archive, n = row[0], [0]
            name = f"{out}/{archive.rsplit('/', 1)[1]}"

            def write(f):
                nonlocal row
                where, path = common.store(archive)
                with where.open_input_stream(path, compression=None) as old:
                    for at, raw in enumerate(members(old)):
                        if row is None or row[:2] != (archive, at):
                            raise ValueError(f"{archive}: no decision for record {at}")
                        x, block = parse(raw)
                        page_id, url, digest = page_of(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["WARC-Payload-Digest"].removeprefix("sha1:")
                        if row[2] == "response":
                            f.write(response(page_id, url, digest, block.partition(b"\r\n\r\n")[2]))
                        else:
                            f.write(revisit(page_id, url, digest, int(x["WARC-Payload-Length"]), row[3], row[4] or ""))
                        n[0] += 1
                        row = next(todo, None)

            common.put_file(name, write)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n[0]], pa.int64())], ["archive", "records"])

    n = max(1, min(spark.read.parquet(f"{source}/list").count(), 4 * spark.sparkContext.defaultParallelism))  # a decision is small, its payload isn't: no merging of these partitions
    dealt = decisions.repartition(n, "archive").sortWithinPartitions("archive", "record").select("archive", "record", "record_type", "refers_to", "refers_url")
    _write_list(dealt.mapInArrow(run, "archive string, records long"), out)
    return out


def deduplicate(pages: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Archives of pages under out, without repeated payloads, and the rows of their records."""
    spark = pages.sparkSession
    crawl = write_archives(pages, f"{out}/crawl")
    rewrite(spark, resolve(read_records(spark, crawl), min_bytes), crawl, f"{out}/archives")
    common.remove(spark, crawl)
    return read_records(spark, f"{out}/archives")
