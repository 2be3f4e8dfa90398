"""WARC archives with an index written first.

Writing leaves one index row for each record (file, offset, length, URL, digest). Reading selects index
rows, sorts them by file and offset, joins neighbouring byte ranges into one read each, and parses the
records out of what was read; nothing is scanned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import remove_at_exit, shared_folder, stored

#: A file is closed once it holds so many bytes.
FILE_BYTES = 64 << 20
#: Neighbouring ranges with at most so many bytes between them are read at once, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
#: Reads are spread over tasks by stretches of a file of this size.
STRETCH_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
])
READ_SCHEMA = T.StructType([*INDEX_SCHEMA.fields, T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType())])


def record_id(page_id: int | None, digest: str) -> str:
    """A stable URN of a record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), payload, and the payload's length by the HTTP header of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = lambda part: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}
    fields = named(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, payload, int(named(http)["content-length"])


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        out, name, place = None, "", 0
        for batch in batches:
            rows = {k: [] for k in INDEX_SCHEMA.names}
            for page_id, url, html, digest, first in zip(*(batch.column(k) for k in ("page_id", "url", "html", "digest", "first")), strict=True):
                page_id, digest, first = page_id.as_py(), digest.as_py(), first.as_py()
                refers_to = first if first is not None and first != page_id else None
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data = gzip.compress(record_bytes(page_id, url.as_py() or "", payload, digest, refers_to), 4, mtime=0)
                if out is None:
                    # A name of its own for each attempt: files of lost attempts are in no index and never read.
                    name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                for k, v in zip(INDEX_SCHEMA.names, (name, place, len(data), url.as_py(), digest, page_id, "response" if refers_to is None else "revisit", refers_to), strict=True):
                    rows[k].append(v)
                place += len(data)
                if place >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(rows, schema=_arrow(INDEX_SCHEMA))
        if out is not None:
            out.close()

    return write


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def write_archive(pages: DataFrame, folder: str, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into WARC files under ``folder``; the index is stored beside them and returned.

    Of pages with equal payloads of at least ``min_payload`` bytes, the one with the smallest id is a response
    and the others revisit it. A null payload is empty. A null id is never referred to while there is another;
    where all ids of a payload are null, all of them are responses. Rows equal to the response in id and payload
    (repeated rows) are responses too. A null URL is written as an empty one.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html")).withColumn("sha1", F.sha1("html"))
    # Only ids and digests are shuffled, and of these only the rows that revisit another come back to the pages.
    ids = stored(rows.filter(F.octet_length("html") >= min_payload).select("page_id", "sha1"), "ids")
    firsts = stored(ids.filter("page_id is not null").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")), "firsts")
    several = firsts.filter("pages > 1").select("sha1", "first")
    named = ids.join(several, "sha1").filter("page_id <> first").groupBy("page_id", "sha1").agg(F.min("first").alias("first"))
    nameless = ids.filter("page_id is null").select("sha1").distinct().join(firsts.select("sha1", "first"), "sha1").select(F.lit(None).cast("long").alias("page_id"), "sha1", "first")
    revisits = stored(named.union(nameless), "revisits").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first")
    to_base32 = F.pandas_udf(lambda s: s.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode()), T.StringType())
    placed = rows.join(revisits, rows.page_id.eqNullSafe(revisits["_page"]) & (rows.sha1 == revisits["_sha1"]), "left")
    _make_folder(spark, f"{folder}/records")
    index = placed.select("page_id", "url", "html", to_base32("sha1").alias("digest"), "first").mapInArrow(_writer(f"{folder}/records"), INDEX_SCHEMA)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def coalesced(rows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges joined into reads: (first row, last row + 1, offset, length)."""
    out, first = [], 0
    while first < len(rows):
        begin, end = rows[first][0], sum(rows[first])
        last = first + 1
        while last < len(rows) and rows[last][0] - end <= GAP_BYTES and max(end, sum(rows[last])) - begin <= READ_BYTES:
            end = max(end, sum(rows[last]))
            last += 1
        out.append((first, last, begin, end - begin))
        first = last
    return out


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        name, source = "", None
        for batch in batches:
            rows = batch.to_pylist()
            begin = 0
            while begin < len(rows):  # the rows of one file stand together
                end = begin
                while end < len(rows) and rows[end]["file"] == rows[begin]["file"]:
                    end += 1
                if rows[begin]["file"] != name:
                    name = rows[begin]["file"]
                    source = filesystem.open_input_file(f"{base}/{name}")
                for first, last, offset, length in coalesced([(x["offset"], x["length"]) for x in rows[begin:end]]):
                    data = source.read_at(length, offset)
                    got = rows[begin + first : begin + last]
                    for x in got:
                        fields, x["payload"], x["payload_bytes"] = parse(gzip.decompress(data[x["offset"] - offset : x["offset"] - offset + x["length"]]))
                        x["record_type"], x["digest"] = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    yield pa.RecordBatch.from_pylist(got, schema=_arrow(READ_SCHEMA))
                begin = end

    return read


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The selected index rows with the payloads of their records; a revisit's own payload is empty.

    Type and digest are those of the records' own headers.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    return index.withColumn("stretch", stretch).repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch").mapInArrow(_reader(f"{folder}/records"), READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, read the records back through the index, and describe each page.

    Size and digest of a response are computed from the payload that was read back; a revisit has them from its own
    headers. A record whose payload does not match its headers fails the job.
    """
    folder = shared_folder(pages.sparkSession)
    index = write_archive(pages, folder)
    remove_at_exit(pages.sparkSession, folder)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, named, size, payload in zip(*(batch.column(c).to_pylist() for c in ("record_type", "digest", "payload_bytes")), batch.column("payload"), strict=True):
                data = payload.as_buffer()
                if kind == "response" and (data.size, found := base64.b32encode(hashlib.sha1(data).digest()).decode()) != (size, named):
                    raise ValueError(f"payload of {data.size} bytes and digest {found} under headers that say {size} and {named}")
            yield batch.select(["page_id", "payload_bytes", "digest", "record_type", "refers_to", "url"]).rename_columns(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return read_archive(index, folder).mapInArrow(digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
