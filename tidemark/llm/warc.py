"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Archives are written by tasks straight into a folder that all machines share and read back with
Spark's own file reader. A payload of at least DEDUP_BYTES that several pages share is stored once,
with the page of the largest id; the other pages get revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, utf8
from tidemark.session import shared_dir, written

MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DEDUP_BYTES = 1000
#: Bytes of blocks in one archive, about; a single larger record still makes one archive.
ARCHIVE_BYTES = 32_000_000
#: Bytes read of an archive at a time.
PART_BYTES = 1 << 20
#: Records and bytes of them that an archive's dictionary is trained on, and its size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 2_000_000, 32_768
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No wall clock in replayable output.
DATE = "1970-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
FIELDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


class Malformed(ValueError):
    """An archive that breaks the format; the message has the place."""


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page: str) -> str:
    return f"<urn:uuid:{hashlib.md5(page.encode()).hexdigest()}>"


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 response, or a revisit with the response's HTTP header and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page), "WARC-Date": DATE, "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)), "X-Page-ID": _clean(page),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": _clean(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    samples, size = [], 0
    for r in records[:: max(1, len(records) // SAMPLES)]:
        if size > SAMPLE_BYTES:
            break
        samples.append(r[:65_536])
        size += len(samples[-1])
    d = dictionary(samples)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(c.compress, records)])


def parse(raw: bytes, at: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of one decoded record, with its lengths and digests checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed(f"{at}: no WARC version and header")
    fields: dict[str, str] = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if not colon:
            raise Malformed(f"{at}: header line without a colon")
        fields[k.strip()] = v.strip()
    if gone := [k for k in REQUIRED if k not in fields]:
        raise Malformed(f"{at}: no {', '.join(gone)}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Malformed(f"{at}: the block's length isn't its Content-Length")
    block = rest[:-4]
    if (d := fields.get("WARC-Block-Digest")) and d != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Malformed(f"{at}: the block's digest differs")
    return fields, block


class _Bytes:
    """What is still to be read of a stream, a part of it at a time."""

    def __init__(self, stream: BinaryIO, part: int = PART_BYTES) -> None:
        self.stream, self.part, self.held, self.at, self.done = stream, part, bytearray(), 0, 0

    def has(self, n: int) -> bool:
        """Whether n more bytes are there, after reading on if need be."""
        while len(self.held) - self.at < n:
            if not (more := self.stream.read(max(self.part, n - len(self.held) + self.at))):
                return False
            if self.at:  # only what follows is kept; what moves is less than was read
                del self.held[: self.at]
                self.at = 0
            self.held += more
        return True

    def take(self, n: int) -> bytes:
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at, self.done = self.at + n, self.done + n
        return out

    def look(self, at: int, n: int) -> int:
        """The little-endian number in n bytes, `at` bytes ahead."""
        return int.from_bytes(self.held[self.at + at : self.at + at + n], "little")


def frame_size(b: _Bytes) -> int | None:
    """Bytes of the Zstandard frame that starts here, from its header and the headers of its blocks; None if it is cut short."""
    if not b.has(5):
        return None
    flags = b.look(4, 1)
    single, sizes = flags >> 5 & 1, (1 if flags >> 5 & 1 else 0, 2, 4, 8)
    at = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + sizes[flags >> 6]
    while True:
        if not b.has(at + 3):
            return None
        block = b.look(at, 3)
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * (flags >> 2 & 1)
            return at if b.has(at) else None


def frames(stream: bytes | BinaryIO, at: str = "archive") -> Iterator[bytes]:
    """Each record's bytes: the dictionary first, then one frame per record until the end.

    Work grows with the archive's size, and memory with its largest record.
    """
    b = _Bytes(io.BytesIO(stream) if isinstance(stream, bytes) else stream)
    if not b.has(8) or b.look(0, 4) != MAGIC:
        raise Malformed(f"{at}: no leading dictionary frame")
    size = b.look(4, 4)
    if not b.has(8 + size):
        raise Malformed(f"{at}: the dictionary is cut short")
    content = b.take(8 + size)[8:]
    if content[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompress(content)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    while b.has(1):
        pos = b.done
        if not b.has(4) or b.look(0, 4) != ZSTD_MAGIC:
            raise Malformed(f"{at}, byte {pos}: no frame")
        if (n := frame_size(b)) is None:
            raise Malformed(f"{at}, byte {pos}: the frame is cut short")
        try:
            z = d.decompressobj()
            out = z.decompress(b.take(n))
        except zstandard.ZstdError as e:
            raise Malformed(f"{at}, byte {pos}: {e}") from e
        if not z.eof:
            raise Malformed(f"{at}, byte {pos}: the frame is cut short")
        yield out


def payload_of(fields: dict[str, str], block: bytes, at: str) -> tuple[int | None, str | None, bytes]:
    """(bytes, hex SHA-1, payload): a revisit's are those that its headers state of the response, null where they don't."""
    response = fields["WARC-Type"] == "response"
    head, sep, body = block.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    length = int(names[b"content-length"]) if names.get(b"content-length", b"").isdigit() else len(body) if response else None
    if response and not sep:
        raise Malformed(f"{at}: no HTTP header")
    stated = fields.get("WARC-Payload-Digest", "")
    if stated and not stated.startswith("sha1:"):
        raise Malformed(f"{at}: a payload digest other than SHA-1")
    digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else hashlib.sha1(body).hexdigest() if response else None
    # a payload that was sent in chunks or compressed is kept, and digested by its writer, in one of several forms
    plain = b"transfer-encoding" not in names and b"content-encoding" not in names
    if response and plain and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise Malformed(f"{at}: the payload's length or digest differs")
    return length, digest, body


def row_of(raw: bytes, at: str) -> tuple:
    """FIELDS of one record. Only a response or revisit of HTTP has a payload; any other record has nulls there."""
    fields, block = parse(raw, at)
    kind = fields["WARC-Type"]
    page, url, refers_to = fields.get("X-Page-ID"), fields.get("WARC-Target-URI", ""), fields.get("X-Refers-To-Page-ID")
    if kind not in ("response", "revisit") or not fields.get("Content-Type", "").startswith("application/http"):
        return page, url, None, None, kind, refers_to, None
    n, digest, body = payload_of(fields, block, at)
    return page, url, n, digest, kind, refers_to, body if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", dedup_bytes: int = DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row of pages and returns the manifest: path, records, bytes.

    Null html is an empty payload, a null url an empty one. A null key is written as the empty
    string and never becomes the response of a group that has a key. Rows with the response's own
    key stay responses. No rows make no archive. A task that runs again writes the same file names.
    """
    rows = pages.select(col(key).alias("k"), F.coalesce(col(url).cast("string"), F.lit("")).alias("u"), F.coalesce(col(html), F.lit("")).cast("binary").alias("p"))
    rows = rows.withColumns({"d": F.sha1("p"), "n": F.octet_length("p")})
    able = F.col("n") >= dedup_bytes
    # written, so that payloads meet it by a broadcast or on two plain exchanges, which AQE splits at a hot payload
    shared = written(rows.where(able).groupBy("d").agg(F.max("k").alias("r"), F.count("*").alias("c")).where("c > 1").select("d", "r"), "warc-shared")
    marked = rows.where(able).join(shared, "d", "left").withColumn("ref", F.when(~F.col("k").eqNullSafe(F.col("r")), F.col("r").cast("string")))
    columns = [F.coalesce(F.col("k").cast("string"), F.lit("")).alias("k"), "u", "p", "d", "ref"]
    # null, empty and short payloads never are revisits and go around the join
    marked = marked.select(*columns).unionByName(rows.where(~able).withColumn("ref", F.lit(None).cast("string")).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            path = f"{folder}/part-{task:06d}-{made:05d}.warc.zst"
            raw = archive(held)
            _put(path, raw)
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(raw)]})
            made, held, size = made + 1, [], 0
            return out

        for b in batches:
            for k, u, p, d, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                held.append(record(k, u, p, d, ref))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    # in order, so that a task that runs again cuts its archives at the same records
    return marked.sortWithinPartitions("k", "u", "d").mapInArrow(run, "path string, records long, bytes long")


def _put(path: str, raw: bytes) -> None:
    """The whole file or none of it: written beside its place, then moved there."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    beside = f"{place.rpartition('/')[0]}/_{uuid.uuid4().hex}-{place.rpartition('/')[2]}"
    with store.open_output_stream(beside, compression=None) as f:
        f.write(raw)
    store.move(beside, place)


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and rest.startswith("/") and not rest.startswith("//"):  # Spark writes file:/place
        path = f"{scheme}://{rest}"
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_stream(place, compression=None)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the folder's *.warc.zst files, checked as it is read; an archive that breaks the format fails the read.

    Files are streamed, so a large archive needs no more memory than its largest record. Records
    that are no HTTP response or revisit have null payload fields, and those of other writers a
    null page_id. An empty folder has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)))
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with _open(path) as stream:
                    for i, raw in enumerate(frames(stream, path)):
                        rows.append(row_of(raw, f"{path}, record {i}"))
                        size += len(raw)
                        if size > 8_000_000 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # only the paths come from Spark's reader, which also deals the files to tasks by their sizes
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    return files.mapInArrow(run, FIELDS)


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages into folder (a new shared one if None) and returns what the archives then hold."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    spark.createDataFrame([], "path string, records long, bytes long").write.mode("append").parquet(f"{folder}/manifest")
    write_archives(pages, folder, **options).write.mode("append").parquet(f"{folder}/manifest")
    return read_archives(spark, folder)
