"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by id. Each range is a shard whose task appends one gzip member a record and starts a new file as soon as the
compressed size reaches the limit, so a row of the written data is one file. Headers and digests are made anew from the payload: equal
input gives equal bytes. Files are written by Spark's writer under a temporary name, with its commit protocol, so a lost executor's file is
written again; then the manifest (file, records, bytes, SHA-256) is written beside them, and one rename publishes the folder. Readers
take published folders only.

Of records with equal payloads of at least `least` bytes, that with the smallest page_id is the response and the others revisit it.

Defined results: a null html is an empty payload, a null url an empty target. Repeated rows that share the smallest page_id are all
responses; a null page_id is larger than any other. Only page_id, url and html are read. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes at which a file is closed.
ROLL_BYTES = 8 << 20
#: Raw bytes of payload that a sorted shard should hold.
SHARD_BYTES = 64 << 20
#: The one date in all headers, so that archives don't depend on the time of writing.
DATE = "2024-01-01T00:00:00Z"
#: An empty gzip member; Spark's text writer ends each of its rows, here files, with it.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes given to the decompressor at once.
FED = 64 << 10

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP header, so also the length of its payload, but not the payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # line ends in a url would end the header
    target = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
               ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    view, start = memoryview(data), 0
    while start < len(data):
        unpack, parts, at = zlib.decompressobj(wbits=31), [], start
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            parts.append(unpack.decompress(view[at:at + FED]))
            at += len(view[at:at + FED])
        yield start, b"".join(parts)
        start = at - len(unpack.unused_data)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def read_record(content: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url; the payload's digest is computed again."""
    fields, block = parsed(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"broken payload of {fields['WARC-Record-ID']}")
    number = [int(x) if x else None for x in (fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID"))]
    return number[0], size, digest, fields["WARC-Type"], number[1], fields["WARC-Target-URI"]


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest and refers_to of each page whose payload a page with a smaller id has too."""
    keys = pages.filter(F.length("payload") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
    return keys.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def files(batches: Iterator[pd.DataFrame], roll_bytes: int) -> Iterator[pd.DataFrame]:
    """A row for each archive file of a sorted shard. A revisit's mark stands before the pages it belongs to."""
    members_, size, mark = [], 0, None
    for batch in batches:
        for page_id, digest, refers_to, url, payload in batch.itertuples(index=False):
            page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
            if payload is None:
                mark = page_id, digest, refers_to
                continue
            revisit = mark is not None and mark[:2] == (page_id, digest)
            members_.append(gzip.compress(record(page_id, url, payload, mark[2] if revisit else None, revisit), 6, mtime=0))
            size += len(members_[-1])
            if size >= roll_bytes:
                yield pd.DataFrame({"value": [b"".join(members_)]})
                members_, size = [], 0
    if members_:
        yield pd.DataFrame({"value": [b"".join(members_)]})


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files into folder, which must not exist, and returns the manifest."""
    spark, rows = pages.sparkSession, pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    total = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    marks = revisits(rows, least).select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = marks.unionByName(rows.select("page_id", "digest", F.lit(None).cast("bigint").alias("refers_to"), "url", "payload"))
    shards = (both.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("page_id").asc_nulls_last(), "digest")
              .sortWithinPartitions(F.col("page_id").asc_nulls_last(), "digest", F.col("payload").isNotNull(), "url"))
    written = shards.select("page_id", "digest", "refers_to", "url", "payload").mapInPandas(lambda batches: files(batches, roll_bytes), "value binary")
    temporary = f"{folder}._temporary-{uuid.uuid4().hex}"
    (written.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(temporary))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    # names only, which hold the shard and the file's number in it
    parts = sorted(f.getPath().getName() for f in fs.listStatus(path(temporary)) if f.getPath().getName().startswith("part-") and f.getLen())
    for name in parts:
        fs.rename(path(f"{temporary}/{name}"), path(f"{temporary}/{archive_name(name)}"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(temporary)
    manifest = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest.write.json(f"{temporary}/manifest")
    if not fs.rename(path(temporary), path(folder)):
        raise FileExistsError(folder)
    return read_manifest(spark, folder)


def archive_name(part: str) -> str:
    """shard-<number>-<file>.warc.gz from a name such as part-00003-<uuid>-c001.txt."""
    fields = part.removesuffix(".txt").split("-")
    return f"shard-{fields[1]}-{fields[-1].removeprefix('c')}.warc.gz"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, bytes long, sha256 string").json(f"{folder}/manifest")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the published archive, with its file and the offset of its gzip member."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                rows = [(*read_record(text), path, offset) for offset, text in members(content) if text]
                columns = [x.split(" ")[0] for x in RECORD.split(", ")]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", "content").mapInPandas(each, RECORD)
