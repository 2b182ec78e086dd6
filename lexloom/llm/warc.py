"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent frames, each holding whole records, and a footer in a skippable frame: the seek table
of the public seekable format (compressed and raw size of every frame). An index table maps each record to file, frame
and offset in the frame, so one record needs one range read. Tasks name files by attempt, and the index, written once
by Spark's committer, lists those of the attempts that count: what a lost executor left behind is never read.
Files go through pyarrow's file systems to a folder that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize, new_folder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, READERS = 256 << 10, 16 << 20, 20_000
RECORD_URN = "<urn:lexloom:page:%s>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, frame int, frame_offset long, frame_bytes long, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or with refers_to a revisit record, which keeps the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Record-ID: " + RECORD_URN % page_id, f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", "WARC-Refers-To: " + RECORD_URN % refers_to]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])


def _page(urn: str | None) -> int | None:
    x = urn[len(RECORD_URN) - 3 : -1] if urn else "None"
    return None if x == "None" else int(x)


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset as a row, and where the next one starts. The digest of a response is that of its bytes,
    compared with its header; a revisit's digest and length are those its headers give."""
    end = raw.index(b"\r\n\r\n", at)
    if raw[at : at + 8] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    h = _headers(raw[at:end])
    start, n = end + 4, int(h["Content-Length"])
    http_end = raw.index(b"\r\n\r\n", start) + 4
    payload = raw[http_end : start + n]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and payload_digest(payload) != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't have its digest")
    row = {
        "page_id": _page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": int(_headers(raw[start : http_end - 4])["Content-Length"]),
        "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": _page(h.get("WARC-Refers-To")),
        "payload": payload if h["WARC-Type"] == "response" else None,
    }
    return row, start + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, from the last bytes of a file of that size."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", tail[len(tail) - 9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    if at + 17 + 8 * n != size:
        raise ValueError("the seek table does not fit the file")
    return out


class _Bundles:
    """Writes records to bundle files and notes where each one went."""

    def __init__(self, folder: str, name: str, level: int, frame_bytes: int, bundle_bytes: int):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path)
        self.name, self.packer, self.k = name, zstandard.ZstdCompressor(level=level), 0
        self.out, self.rows, self.ready = None, [], []
        self.raw, self.inside = bytearray(), []

    def add(self, page_id: int | None, rec: bytes) -> None:
        self.inside.append((page_id, len(self.raw), len(rec)))
        self.raw += rec
        if len(self.raw) >= self.frame_bytes:
            self.frame()

    def frame(self) -> None:
        if not self.inside:
            return
        if self.out is None:
            self.file = f"{self.name}-{self.k:05d}.warc.zst"
            self.out, self.at, self.frames = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None), 0, []
        packed = self.packer.compress(bytes(self.raw))
        self.out.write(packed)
        self.rows += [(p, self.file, len(self.frames), self.at, len(packed), o, n) for p, o, n in self.inside]
        self.frames.append((len(packed), len(self.raw)))
        self.at += len(packed)
        self.raw, self.inside = bytearray(), []
        if self.at >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        self.frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.ready, self.rows, self.out, self.k = self.ready + self.rows, [], None, self.k + 1

    def take(self) -> list[tuple]:
        out, self.ready = self.ready, []
        return out


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), *((x, pa.int64()) for x in ("frame_offset", "frame_bytes", "offset", "length"))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def mark_revisits(df: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """df with `refers to`: the largest id among the rows of equal payload of at least min_bytes, null at that row.

    Only the payloads that occur more than once are joined back: broadcast where their table is below Spark's threshold,
    else by shuffle with skew splitting. Null payloads are empty. Rows that share the largest id all stay responses, as
    do rows of a group whose ids are all null; other rows with a null id refer to the largest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    key = F.unhex(F.sha2(payload, 256))
    many = df.filter(F.octet_length(payload) >= min_bytes).groupBy(key.alias("many key")).agg(F.max(id_col).alias("many last"), F.count(F.lit(1)).alias("n"))
    many = materialize(many.filter("n > 1").drop("n"), "warc-copies")
    rows = df.join(many, F.when(F.octet_length(payload) >= min_bytes, key) == F.col("many key"), "left")
    own = F.col(id_col).eqNullSafe(F.col("many last"))
    return rows.withColumn("refers to", F.when(~own, F.col("many last"))).drop("many key", "many last")


def write_archives(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write each row as a record into bundles under folder, a path of the shared storage; the index table. A frame ends
    with the record that takes it to frame_bytes, a bundle with the frame that takes it to bundle_bytes (compressed).

    One record per row, repeated rows too. Null payloads are empty, null urls leave the header out, null ids read back as
    null. A record longer than a frame has a frame of its own. An empty table writes no file. Other columns are not kept.
    """
    marked = mark_revisits(df, id_col=id_col, payload_col=payload_col, min_bytes=min_bytes)
    rows = marked.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"), F.col("refers to").cast("long").alias("ref"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        b = _Bundles(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}", level, frame_bytes, bundle_bytes)
        for batch in batches:
            for page_id, url, payload, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b.add(page_id, record(page_id, url, payload, ref))
            if found := b.take():
                yield _index_batch(found)
        b.close()
        if found := b.take():
            yield _index_batch(found)

    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the files that the index lists, frame by frame: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and with payloads also payload (null for revisits).

    A task for each file, up to READERS tasks. A file that is missing, cut or damaged fails the job: nothing is skipped. An
    empty index gives no rows; files and records that it doesn't list are not read, rows that it repeats are read once.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds = pa.schema(kinds + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{file}") as f:
                    size = f.size()
                    n = struct.unpack("<I", f.read_at(9, size - 9)[:4])[0]
                    for offset, packed, raw_size in read_seek_table(f.read_at(9 + 8 * n, size - 9 - 8 * n), size):
                        raw, at, rows = unpack.decompress(f.read_at(packed, offset), max_output_size=raw_size), 0, []
                        while at < len(raw):
                            row, at = parse_record(raw, at)
                            rows.append(row)
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = index.select("file").distinct()
    return files.repartition(max(1, min(files.count(), READERS)), "file").mapInArrow(read, schema)  # a number of its own keeps small partitions apart


def fetch(index: DataFrame, folder: str, page_id: int) -> list[dict]:
    """The records of one id, each by a single range read of its frame."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    out = []
    for r in index.filter(F.col("page_id") == page_id).collect():
        with fs.open_input_file(f"{path}/{r['file']}") as f:
            raw = zstandard.ZstdDecompressor().decompress(f.read_at(r["frame_bytes"], r["frame_offset"]))
        out.append(parse_record(raw, r["offset"])[0])
    return out


def archive_round_trip(df: DataFrame, **names) -> DataFrame:
    """write_archives() into a new folder of the shared storage, then read_archives()."""
    folder = new_folder(df.sparkSession, "warc")
    return read_archives(write_archives(df, folder, **names), folder)
