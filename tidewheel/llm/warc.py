"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a
skippable frame at the head of each archive, so an archive is read without
anything else and any record can be decompressed by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import small_side, stored
from tidewheel.session import scratch_path

# Fixed values of the archive format.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE = 1_000              # records that the dictionary is built from, about
SAMPLE_BYTES = 16_384       # and how much of each
DICTIONARY = 65_536
ARCHIVE_BYTES = 256 << 20   # a task starts a new archive beyond this
READ = 1 << 20


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the headers of the payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, *, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` is the page that others with its payload revisit.

    Only digests that occur twice are joined back, so payloads are not shuffled
    while those are few.
    """
    data = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = stored(base.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("digest", "first"), "shared-payloads")
    return base.join(small_side(shared), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.octet_length("payload") >= least_bytes, F.col("first")).alias("first"))


def build_dictionary(rows: DataFrame, n_rows: int, date: str) -> bytes:
    """A Zstandard dictionary of about SAMPLE records, at most four times as many, drawn by a hash; empty if there are none.

    ``rows`` are those of ``roles``.  Samples are records as they are archived, headers
    and revisits included; of a payload, SAMPLE_BYTES bytes.
    """
    million = 1_000_000
    share = min(million, int(million * SAMPLE / max(n_rows, 1)) + 1)
    drawn = rows.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(million)) < share).limit(4 * SAMPLE).select(
        "page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "digest", "first")
    samples = [record(r["page_id"], r["url"], bytes(r["payload"]), base64.b32encode(r["digest"]).decode(), r["first"],
                      r["first"] is not None and r["first"] != r["page_id"], date) for r in drawn.collect()]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(samples)[-DICTIONARY:]


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder``, a place all executors share; returns (path, records, bytes) per archive.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with
    the smallest id is a response and others revisit it; a row that repeats
    that id is a response too.  A null payload is empty, a null url is blank.  A
    row without id revisits like any other, and is a response where no row with
    its payload has an id.  An archive that a lost task leaves is in no
    returned row.
    """
    rows = roles(pages, id_col=id_col, payload_col=payload_col, least_bytes=least_bytes)
    dictionary = build_dictionary(rows, pages.count(), date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        context, out, done = TaskContext.get(), None, []
        name, n, size, k = "", 0, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, first = (batch.column(c)[row].as_py() for c in range(5))
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{k}.warc.zst"
                    out, n, k = fs.open_output_stream(f"{top}/{name}"), 0, k + 1
                    size = out.write(SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary)
                revisit = first is not None and first != page
                size += out.write(squeeze.compress(record(page, url, payload, base64.b32encode(digest).decode(), first, revisit, date)))
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done], pa.int64()),
                                              pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _records(stream: pyarrow.NativeFile) -> Iterator[bytes]:
    """Records of one archive, a frame at a time."""
    head = stream.read(8)
    if len(head) < 8 or head[:4] != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    dictionary = stream.read(int.from_bytes(head[4:], "little"))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = stream.read(READ)
    while data:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or stream.read(READ)
                break
            data = stream.read(READ)
            if not data:
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes]:
    """(page_id, url, payload bytes, digest, type, refers_to, payload) of a record, its digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    http, _, payload = rest[:int(f["Content-Length"])].partition(b"\r\n\r\n")
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    if f["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None
    return (page(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(_fields(http)["Content-Length"]), digest, f["WARC-Type"],
            page(f.get("WARC-Refers-To")), payload)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) from the rows of ``write_archives``."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(at) as stream:
                    for data in _records(stream):
                        rows.append(parse(data))
                        held += len(data)
                        if held > READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_folder(pages: DataFrame) -> str:
    """A new folder below the shared one, as a URI."""
    path = scratch_path(pages.sparkSession, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
