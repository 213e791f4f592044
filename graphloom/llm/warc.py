"""WARC archives: a writer with revisit records and a splittable reader of gzip members.

Writer: one gzip member per record, one file per task (a new one from FILE_BYTES on), through the file
system of the target folder. Only files that the manifest names count, so a task that runs twice does
no harm. Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest id
is the response; the others are revisits that refer to it.

Reader: tasks get byte ranges of the files. A task looks for gzip magic from its start on, takes a
position for a record only if inflating it gives a WARC header, and owns every record that starts in its
range, wherever it ends. Records must follow each other without a gap, from a file's first byte to its last,
and each task checks that where its last record ends the next one starts: a file of another size than the
manifest's, a damaged or truncated member, bytes between members and a response that differs from its
digest raise, so nothing is lost in silence.

Archives of others: header names may have any case; warcinfo, request, metadata, resource and conversion
records are returned with their block as payload; a response without an HTTP Content-Length has the length
that it has; without a SHA-1 of the payload in the header it is computed; ids that aren't ours are returned
as the URIs that they are. `listed` makes a manifest of a folder's files.

Folders are opened through pyarrow: local paths, hdfs:// and s3:// (also as s3a:// and s3n://) work.

Defined results: a null payload counts as empty; a record without id is a revisit if an equal payload
has an id, else a response; records with one id and payload are all responses, as are payloads below
the limit; a null URL becomes an empty one; an empty table gives no file and no records; only the three
named columns are used, so extra columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.hot import join_hot
from graphloom.session import scratch, written

FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
#: How every record begins.
HEADER = b"WARC/1."
URN = "urn:graphloom:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str | None, url: str | None, payload: bytes, date: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if record_id is None else urllib.parse.quote(record_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{urllib.parse.quote(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def referred(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages (id, url, payload) with `refers_to`: the id of the response that a page revisits, else null."""
    digest = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    # counted and reduced in the tasks first; only payloads that repeat go on
    groups = pages.select(digest.alias("digest"), "id").where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first is not null"), "repeats")
    found = join_hot(pages.withColumn("digest", digest), groups, "digest", "n", "id")
    return found.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder or file."""
    scheme, _, rest = uri.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes the archive and returns its manifest (path, size, records), itself kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        out, path, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row_id, address, html, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(row_id.as_py(), address.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", date, refers.as_py())) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        paths, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "size", "records"])

    three = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = referred(three, least_bytes).select(F.col("id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return written(rows.mapInArrow(run, "path string, size long, records long"), "manifest")


def _pieces(file, window: memoryview, base: int, at: int, size: int) -> Iterator[bytes | memoryview]:
    """The file's bytes from base + at on: those of the window first, then read in pieces."""
    yield window[at : at + 4096]
    for k in range(at + 4096, len(window), READ_BYTES):
        yield window[k : k + READ_BYTES]
    k = base + max(len(window), at)
    while k < size:
        piece = file.read_at(min(READ_BYTES, size - k), k)
        k += len(piece)
        yield piece


def _member(pieces: Iterator[bytes | memoryview]) -> tuple[bytes, int] | None:
    """The record of the gzip member that these bytes start with and the member's length; none if it is no record.

    A record that can't be inflated to its end raises.
    """
    inflate, out, known, fed = zlib.decompressobj(31), b"", False, 0
    parts: list[bytes] = []
    try:
        for piece in pieces:
            fed += len(piece)
            if known:
                parts.append(inflate.decompress(piece))
            else:
                # the header decides whether this is a record; magic inside compressed bytes fails here
                out += inflate.decompress(piece, 1024)
                if not HEADER.startswith(out[: len(HEADER)]):
                    return None
                if known := len(out) >= len(HEADER):
                    parts = [out, inflate.decompress(inflate.unconsumed_tail) if inflate.unconsumed_tail else b""]
            if inflate.eof:
                return (b"".join(parts), fed - len(inflate.unused_data)) if known else None
    except zlib.error as e:
        if known:
            raise ValueError(f"a damaged record: {e}") from e
        return None
    if known:
        raise ValueError("a record is cut off")
    return None


def records_in(file, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Inflated records that start in [begin, end) of a file of `size` bytes; raises where one is missing."""
    data = file.read_at(min(end + len(MAGIC) - 1, size) - begin, begin)
    view, at, due = memoryview(data), data.find(MAGIC), 0 if begin == 0 else None
    while at >= 0:
        found = _member(_pieces(file, view, begin, at, size))
        if found is None:
            at = data.find(MAGIC, at + 1)
            continue
        if due is not None and at != due:
            break
        yield found[0]
        due = at + found[1]
        at = data.find(MAGIC, due) if due < len(data) else -1
    if due is not None and begin + due < size and (begin + due < end or _member(_pieces(file, view, begin, due, size)) is None):
        raise ValueError(f"no record at byte {begin + due}")


def parsed(raw: bytes) -> tuple[dict[str, str], int | None, bytes]:
    """WARC headers (lower-case names), length of the full payload (none if unknown), and the payload that the record holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    if fields.get("warc-type") not in ("response", "revisit") or not block.startswith(b"HTTP/"):
        return fields, len(block), block
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        return fields, len(payload), payload
    stated = _fields(http).get("content-length", "")
    return fields, int(stated) if stated.isdigit() else None, payload


def _fields(head: bytes) -> dict[str, str]:
    """Header fields below the first line, by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "url", "record_type", "refers_to", "payload_digest")] + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])


def _id(value: str | None) -> str | None:
    """The id in a record's URI: ours bare, others whole."""
    bare = (value or "").removeprefix("<").removesuffix(">")
    return (urllib.parse.unquote(bare[len(URN) :]) if bare.startswith(URN) else bare) or None


def _row(raw: bytes, payloads: bool) -> tuple:
    fields, length, payload = parsed(raw)
    stated = fields.get("warc-payload-digest", "")
    digest = stated[5:] if stated.lower().startswith("sha1:") else None
    kind = fields.get("warc-type")
    if kind != "revisit":
        real = payload_digest(payload)
        if kind == "response" and digest not in (None, real):
            raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't match its digest")
        digest = real
    return (_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _id(fields.get("warc-refers-to")), digest, length, payload if payloads else None)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest (path, size) of the archives in a folder that has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", F.col("length").alias("size"))


def read(spark: SparkSession, manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the files of a manifest (path, size): headers, full length and, if asked, payloads."""
    steps = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.where("size > 0").select("path", "size", F.explode(steps).alias("begin"))
    parts = max(1, min(100_000, manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1))
    ranges = ranges.repartition(int(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(folder)
        for batch in batches:
            for path, size, begin in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, held = [], 0
                with system.open_input_file(_system(path)[1]) as file:
                    if file.size() != size:
                        raise ValueError(f"{path}: {file.size()} bytes, {size} in the manifest")
                    try:
                        for raw in records_in(file, begin, min(begin + range_bytes, size), size):
                            rows.append(_row(raw, payloads))
                            held += len(rows[-1][-1] or b"") + 200
                            if held > 8 << 20:
                                yield _batch(rows)
                                rows, held = [], 0
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, _ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ROW.names)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for an archive, shared by driver and executors."""
    return scratch(spark, "warc")
