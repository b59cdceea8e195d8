"""WARC archives with a Zstandard dictionary per file, and back.

Every file starts with a skippable frame that holds its dictionary, which is trained on the file's own
first records (``SAMPLE_BYTES`` at most; where these are too few to train on, they are the dictionary).
Then comes one Zstandard frame per record, so any record can be read on its own. Of pages with equal
payloads the one with the smallest id is archived as response, the others as revisits without payload.

Null pages have an empty payload, and empty payloads are equal to each other. Rows that repeat the
smallest id are all responses. A row without an id revisits those with one; among rows without any, all
are responses. Missing urls leave out the target header; control characters in urls are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import shared_folder, stored
from chatloom.llm.files import WholeFile, place

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 256 << 20
READ_BYTES = 32 << 10
LEVEL = 3
FILES = "path string, n_records bigint"


def with_originals(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the smallest page id with the same payload, where it is another.

    Only ids and digests move to find the copies; equal digests are counted together before they move,
    and the join on digests is one that Spark can split where a payload has very many copies.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    slim = rows.select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = stored(firsts.filter("n > 1 and first is not null").select("digest", "first"), "copied-pages")
    later = slim.join(copied, "digest").filter("page_id is null or page_id > first")
    later = later.select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("digest") == F.col("later_digest"))
    return rows.join(later, same, "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def record_uri(page_id: int | None, payload_sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{payload_sha1.hex()}')}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def escaped(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record with an HTTP block."""
    payload = html.encode()
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_uri(page_id, sha1), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = escaped(url)
    head["WARC-Payload-Digest"] = f"sha1:{base32(sha1)}"
    head["WARC-Block-Digest"] = f"sha1:{base32(hashlib.sha1(block).digest())}"
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        head["WARC-Profile"] = REVISIT_PROFILE
        head["WARC-Refers-To"] = record_uri(refers_to, sha1)
        head["X-Refers-To-Page-ID"] = str(refers_to)
    head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """Trained on the samples, or made of them where training finds too little in them."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except (zstandard.ZstdError, MemoryError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL) -> DataFrame:
    """Archives of ``page_id, url, html, refers_to`` in ``folder``; one row per file, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, written = TaskContext.get().partitionId(), []
        records = (
            record(*row, date)
            for batch in batches
            for at in range(0, batch.num_rows, 200)
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns))
        )
        ahead = next(records, None)
        while ahead is not None:
            samples, size = [], 0
            while ahead is not None and size < SAMPLE_BYTES:
                samples.append(ahead)
                size += len(ahead)
                ahead = next(records, None)
            learnt = dictionary(samples)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=learnt, write_checksum=True)
            file = WholeFile(folder, f"pages-{part:06d}-{len(written):05d}.warc.zst")
            with file as out:
                raw = learnt.as_bytes()
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
                n = 0
                for one in samples:
                    out.write(compressor.compress(one))
                    n += 1
                while ahead is not None and size < FILE_BYTES:
                    out.write(compressor.compress(ahead))
                    size, n, ahead = size + len(ahead), n + 1, next(records, None)
            written.append((file.uri, n))
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*written), (pa.string(), pa.int64()))], names=["path", "n_records"])

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, FILES), "archives")


def records_of(uri: str) -> Iterator[bytes]:
    """The records of an archive, one after the other; only the one at hand is in memory."""
    import zstandard

    store, path = place(uri)
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} does not start with a dictionary")
        raw = stream.read(size)
        trained = raw[:4] == struct.pack("<I", 0xEC30A437)
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        left, frame, got = b"", reader.decompressobj(), []
        while True:
            piece = left or stream.read(READ_BYTES)
            if not piece:
                if got:
                    raise ValueError(f"{uri} ends inside a record")
                return
            got.append(frame.decompress(piece))
            left = b""
            if frame.eof:
                left = frame.unused_data
                yield b"".join(got)
                frame, got = reader.decompressobj(), []


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record: what its headers say, checked against the payload of responses."""

    schema = ROWS + (", payload binary" if with_payload else "")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
    names = [column.split()[0] for column in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in records_of(path):
                    warc, http, payload = parsed(raw)
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"{path}: payload of {warc['WARC-Record-ID']} does not have its digest")
                    number = lambda key: int(warc[key]) if key in warc else None
                    row = (number("X-Page-ID"), warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, warc["WARC-Type"], number("X-Refers-To-Page-ID"))
                    rows.append((*row, payload) if with_payload else row)
                    size += len(payload)
                    if len(rows) >= 5_000 or with_payload and size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    # a number keeps Spark from merging these few small rows: each stands for a file to read
    spread = files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to archives (in a new shared folder by default) and read back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_originals(pages), folder))
