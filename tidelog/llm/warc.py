"""A WARC writer whose archives are compressed record by record with a dictionary of their own.

Each archive starts with a skippable frame that holds a Zstandard dictionary, built from the first
records that go into it; every record is then a frame of its own, a warcinfo first. Records whose
payload another one already holds are revisits of it. Each attempt of a task writes archives of its own
names, and the stored list that the tasks return says which attempt counts, so what a lost or repeated
attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import shared_path, small, stored

MIN_PAYLOAD = 100
#: Bytes of records that train an archive's dictionary, of the dictionary, and of records in an archive.
SAMPLE_BYTES, DICT_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 48 << 20
#: Most digests of repeated payloads, of some 80 bytes each, that a join may broadcast.
BROADCAST_DIGESTS = 200_000
#: The first bytes of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
PLAN = "page_id long, url string, html string, payload_digest string, record_type string, refers_to long"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with payload_digest, record_type and refers_to.

    Of the records with equal payloads of at least 100 bytes the smallest page_id is the response; rows
    that share that page_id are all responses, and so is a row whose group has no page_id at all. Null
    html is empty.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    pages = pages.withColumn("payload_digest", F.sha2(raw, 256))
    repeated = pages.where(F.octet_length("html") >= MIN_PAYLOAD).groupBy("payload_digest")
    repeated = repeated.agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    repeated = stored(repeated, "payloads")
    out = pages.join(small(repeated, repeated.count(), BROADCAST_DIGESTS), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


#: The date of records whose capture time isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
_SOFTWARE = b"software: tidelog\r\nformat: WARC File Format 1.1\r\n"


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*head, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    """The warcinfo record that opens an archive."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date)]
    return _record([*head, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], _SOFTWARE)


def record_id(page_id: int | None, place: str) -> str:
    """A name no other record has: where a record stands makes those of equal or no page_id differ."""
    return f"<urn:page:{'' if page_id is None else page_id}:{place}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, place: str = "0", date: str = NO_DATE
) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload and not the payload."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, place)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    head += [("WARC-Target-URI", target or "about:blank")] if url is not None else []
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record([*head, ("Content-Type", "application/http; msgtype=response")], block)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; too few of them are themselves the dictionary."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archives(records: Iterator[bytes]) -> Iterator[list]:
    """Runs of records of about ARCHIVE_BYTES, each as (records of the sample, iterator of the rest)."""
    for first in records:
        sample, size = [first], len(first)
        for r in records:
            sample.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break

        def rest(size: int = size) -> Iterator[bytes]:
            while size < ARCHIVE_BYTES and (r := next(records, None)) is not None:
                size += len(r)
                yield r

        yield [sample, rest()]


def write_archives(plan: DataFrame, folder: str, date: str = NO_DATE, info: bool = False) -> DataFrame:
    """Write plan (as of plan_records) and return the stored (archive, n_records, n_bytes); n_records leaves the warcinfo out.

    With ``info`` each archive opens with a warcinfo record.

    A null page_id or url is left out of its record's headers, an empty url is about:blank, and null html is the
    empty payload (plan_records sees to it). Rows with the same or no page_id are records of different ids.
    An empty plan gives no archives. Rows of a task are taken in the order of page_id, digest and url, so a
    task that is run again writes the same archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = _file_system(folder)
        out.create_dir(at, recursive=True)
        context, told, n_seen = TaskContext.get(), [], 0
        part = f"part-{context.partitionId():06d}"

        def rows() -> Iterator[bytes]:
            nonlocal n_seen
            for b in batches:
                for p, u, h, d, k, to in zip(*(c.to_pylist() for c in b.columns)):
                    n_seen += 1
                    yield record_bytes(p, u, h.encode("utf-8", "surrogatepass"), d, k, to, f"{part}-{n_seen}", date)

        records = rows()
        for i, (sample, rest) in enumerate(_archives(records)):
            name = f"{at}/{part}-{i:04d}-{context.taskAttemptId()}.warc.zst"
            trained = train(sample)
            pack, n = zstandard.ZstdCompressor(level=3, dict_data=trained), 0
            with out.open_output_stream(name, compression=None) as f:  # else pyarrow goes by the name
                raw = trained.as_bytes()
                f.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
                if info:
                    f.write(pack.compress(info_bytes(f"{part}-{i:04d}.warc.zst", date)))
                for group in (sample, rest):
                    for r in group:
                        f.write(pack.compress(r))
                        n += 1
                size = f.tell()
            told.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    ordered = plan.sortWithinPartitions("page_id", "payload_digest", "url")
    return stored(ordered.mapInArrow(run, "archive string, n_records long, n_bytes long"), "archives")


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder; Hadoop's names of the S3 client mean S3."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder)


def parse_archive(raw: bytes) -> Iterator[dict]:
    """The records of one archive, its warcinfo first, each with its headers and its block."""
    magic, n = struct.unpack_from("<II", raw)
    if magic != DICT_MAGIC:
        raise ValueError("an archive must start with its dictionary")
    trained = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(raw[8 + n :], read_across_frames=True), 1 << 20)
    while stream.readline():
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b": ")
            head[k.decode()] = v.decode()
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head | {"block": block}


def _page(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(tail) if tail else None


def read_archives(spark, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """A row for each page's record in the archives of a folder; a revisit has a null payload, and so has a null url.

    ``listed``, as of write_archives, says which of the archives count; without it all do.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if listed is not None:
        name = F.element_at(F.split("path", "/"), -1)
        wanted = listed.select(F.element_at(F.split("archive", "/"), -1).alias("_name"))
        files = files.join(small(wanted, wanted.count(), BROADCAST_DIGESTS), name == F.col("_name"), "left_semi")
    files = files.select("content")
    names = [f.split(" ")[0] for f in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows(raw: bytes) -> Iterator[tuple]:
        for r in parse_archive(raw):
            if r["WARC-Type"] == "warcinfo":
                continue
            http, _, payload = r["block"].partition(b"\r\n\r\n")
            stated = int(http.rpartition(b"Content-Length: ")[2])
            revisit = r["WARC-Type"] == "revisit"
            digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
            if not revisit and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{r['WARC-Record-ID']}: its payload isn't what its header says")
            yield (_page(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), None if revisit else payload, stated, digest, r["WARC-Type"], _page(r.get("WARC-Refers-To")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size > 8 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(run, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and return the records read back from them."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return read_archives(spark, folder, write_archives(plan_records(pages), folder, info=True))


def archive_digest(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back; null html is 0 bytes, a null page_id stays null."""
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
