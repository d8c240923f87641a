"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by index.

The writer streams the records of a partition into one gzip stream per file, as many crawlers do. Such a file can
only be read from its start. The normaliser inflates each file once, as a stream, rewrites every record as a gzip
member of its own and writes a sidecar index (a JSON line per record: offset and length of its member). The reader
takes the index rows and fetches each record by its range. Each holds one record at a time, whatever a file's size.

Files go to the shared folder through pyarrow's file systems. Their names hold the task's attempt, and only names
that a successful attempt returned are read on, so lost executors and repeated tasks leave results whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_spread

#: Bytes that are read at once, and rows of an index.
PIECE, INDEX_ROWS = 1 << 20, 500
#: Repeated payloads (about 100 bytes each) that are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
# Fixed values of the formats: the revisit profile of WARC 1.1 and the date of all records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with an HTTP message as block, or a revisit with that message's header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    member = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield member.decompress(piece)
            piece = b""
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed archive; holds one record and a piece."""
    held, more = bytearray(), True

    def fill() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while more:
        while (end := held.find(b"\r\n\r\n")) < 0 and (more := fill()):
            pass
        if end < 0:
            if held.strip():
                raise ValueError("an archive ends within a record's header")
            return
        whole = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
        while len(held) < whole:
            if not fill():
                raise ValueError("an archive ends within a record's block")
        yield bytes(held[:whole])
        del held[:whole]


def stream(path: str) -> Iterator[bytes]:
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        while piece := f.read(PIECE):
            yield piece


def _create(path: str):
    system, where = fs.FileSystem.from_uri(path)
    system.create_dir(where.rpartition("/")[0], recursive=True)
    return system.open_output_stream(where, compression=None)  # else a name in .gz is packed once more


def _per_task(f: Callable[[str, Iterator[pa.RecordBatch]], list[tuple]], kinds: list[tuple[str, pa.DataType]]):
    """mapInArrow function: f gets a file name that only this attempt uses, and the batches; it returns rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = f(f"part-{task.partitionId():06d}-{task.taskAttemptId()}", batches)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def write_archives(df: DataFrame, root: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 6, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write each row as a record into gzip files (one stream each) under root; returns path, records by file.

    A null payload is empty. Of the rows with equal payloads of at least min_bytes, that with the smallest id is the
    response and the others are revisits of it; rows that repeat the smallest id with the same payload are responses
    too, and a null id is a revisit wherever another id has its payload. Empty partitions write no file; an empty table
    writes none. Payloads stay where they are read unless more of them repeat than can be broadcast; the rows of a hot
    payload are split then.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    key = F.sha2("payload", 256)
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.unhex(key).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    groups, rows = ws.stage(groups, "repeats"), rows.withColumn("key", F.unhex(key))
    if groups.count() <= broadcast_groups:
        rows = rows.join(F.broadcast(groups), "key", "left")
    else:
        rows = join_spread(rows, groups, ["key"], "n", rows.count(), F.col("id"), "left")
    rows = rows.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(name: str, batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        path, out, n = f"{root}/{name}.warc.gz", None, 0
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _create(path)
                out.write(packer.compress(record_bytes(page_id, url, payload, refers_to)))
                n += 1
        if not out:
            return []
        out.write(packer.flush())
        out.close()
        return [(path, n)]

    return rows.mapInArrow(_per_task(write, [("path", pa.string()), ("records", pa.int64())]), "path string, records long")


def normalise(files: DataFrame, root: str, level: int = 6) -> DataFrame:
    """Rewrite each file of a path column: every record its own member, beside it an index; returns path, index, records."""

    def rewrite(name: str, batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        done = []
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, at, n = f"{root}/{name}-{len(done)}.warc.gz", 0, 0
                with _create(path) as out, _create(f"{path}.idx.json") as index:
                    for record in split_records(inflate(stream(source))):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        said = headers(record[: record.index(b"\r\n\r\n")])
                        out.write(member)
                        index.write(json.dumps({"path": path, "offset": at, "length": len(member), "record_id": said["warc-record-id"], "type": said["warc-type"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                done.append((path, f"{path}.idx.json", n))
        return done

    return files.select("path").mapInArrow(_per_task(rewrite, [("path", pa.string()), ("index", pa.string()), ("records", pa.int64())]), "path string, index string, records long")


INDEX = "path string, offset long, length long, record_id string, type string"
INDEX_KINDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])


def read_index(done: DataFrame) -> DataFrame:
    """The rows of the index files that a column index names, and of no other file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, where = fs.FileSystem.from_uri(path)
                with system.open_input_stream(where, compression=None) as raw, io.TextIOWrapper(raw, "utf-8") as lines:
                    while held := list(islice(lines, INDEX_ROWS)):
                        yield pa.RecordBatch.from_pylist([json.loads(line) for line in held], INDEX_KINDS)

    return done.select("index").mapInArrow(rows, INDEX)


def _page(text: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", text or "")
    return int(found[1]) if found else None


def read_archives(index: DataFrame) -> DataFrame:
    """Fetch the record of each index row: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload is null for a revisit; its digest and its bytes are those that the record states of the full payload. The
    payload of a response is held against its digest.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    if f:
                        f.close()
                    system, where = fs.FileSystem.from_uri(path)
                    name, f = path, system.open_input_file(where)
                f.seek(offset)
                record = zlib.decompress(f.read(length), 31)
                end = record.index(b"\r\n\r\n")
                said = headers(record[:end])
                block = record[end + 4 : end + 4 + int(said["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = said["warc-payload-digest"].removeprefix("sha1:")
                revisit = said["warc-type"] == "revisit"
                if not revisit and payload_digest(payload) != digest:
                    raise ValueError(f"the payload of {said['warc-record-id']} differs from its digest")
                rows.append((_page(said["warc-record-id"]), said["warc-target-uri"], said["warc-type"], _page(said.get("warc-refers-to")), int(headers(http)["content-length"]), digest, None if revisit else payload))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
        if f:
            f.close()

    return index.select("path", "offset", "length").mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(df: DataFrame, **options) -> DataFrame:
    """Write, normalise and index df's rows; returns the index (one row per record) of the archives in the shared folder."""
    spark = df.sparkSession
    ws = Workspace(spark, "warc")
    files = ws.stage(write_archives(df, f"{ws.path}/monolithic", ws, **options), "files")
    n = max(files.count(), 1)
    done = ws.stage(normalise(files.repartition(n), f"{ws.path}/archives"), "normalised")
    ws.drop("monolithic")
    if done.limit(1).count() == 0:
        return spark.createDataFrame([], INDEX)
    return read_index(done.repartition(n))
