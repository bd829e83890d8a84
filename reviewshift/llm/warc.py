"""WARC archives: writing with revisit records, and a salvage reader.

Archives are files of one gzip member a record (as in .warc.gz), written by Spark's text sink under
its own file names: its committer leaves whole files only, whichever executor is lost, on any store
that Spark writes to. A file holds records up to a bound in bytes, or one greater record, so that
the reader, which takes whole files, can take them. The sink puts a separator behind every row. The
last byte of a member is the high byte of its
size, 0 for records below 16 MB (a larger one gets an empty member behind it), so rows leave that
byte out and the separator supplies it.

The reader takes gzip members and plain records. A record counts if its header can be read, its
block has the stated length and end, and its payload the stated digest. After a failed check the
reader searches for the next gzip magic or version line from which a record can be read, goes on
there, and reports the bytes between as a gap. Inside a member it does the same over the unpacked
bytes, also of a member that is cut off or damaged, as far as it unpacks. ``offset`` and ``size``
count bytes of the file (of the whole member, or of its part up to its last good record if it does
not unpack to its end), ``unpacked_offset`` and ``unpacked_size`` those of the member unpacked.

Defined results: null payloads are empty. A payload of at least ``MIN_REVISIT`` bytes is a response
in the rows of the smallest id that has it (each of them, if rows repeat) and a revisit elsewhere;
null ids are larger than others. Null ids and urls leave their header fields out. Columns beside
id, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_path

MIN_REVISIT, FILE_BYTES = 100, 32_000_000
DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
PIECE = 1 << 16  # bytes of a member that are unpacked at once
NEXT = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else None),
              ("WARC-Target-URI", re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None),
              ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Profile", PROFILE if refers_to is not None else None),
              ("WARC-Refers-To", f"<urn:page:{refers_to}>" if refers_to is not None else None),
              ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    """``data`` as gzip whose last byte is 0."""
    def one(part: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(part) + c.flush()

    out = one(data)
    return out if out[-1] == 0 else out + one(b"")


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    first = (rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
             .agg(F.min("page_id").alias("first_id")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Archives of a record per row of ``pages``, of at most ``file_bytes`` bytes or one record each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.large_binary()).cast(pa.binary())], names=["archive"])

        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                i, url, payload, digest, refers = (b.column(c)[k].as_py() for c in range(5))
                own = member(record(i, url, (payload or "").encode(), digest, refers))[:-1]
                if held and size + len(own) >= file_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(own)
                size += len(own) + 1
        if held:
            yield archive()

    # a row is a whole file: members with the separator between them, and the sink's behind the last
    (plan(pages, **columns).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path))


class Bad(Exception):
    """A check that failed at a place in an archive."""


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The plain record at ``at`` and where it ends."""
    head_end = data.find(END, at)
    if not data.startswith(VERSION, at) or head_end < 0:
        raise Bad("no header")
    lines = data[at:head_end].split(b"\r\n")
    if not all(b":" in line or line[:1] in b" \t" for line in lines[1:]):
        raise Bad("header is broken off")
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace")
              for k, _, v in (line.partition(b":") for line in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise Bad("no length")
    start = head_end + len(END)
    end = start + int(fields["content-length"])
    if data[end:end + len(END)] != END:
        raise Bad("block does not end where its length says")
    block = data[start:end]
    http, cut, payload = block.partition(END)
    if not fields.get("content-type", "").startswith("application/http") or not cut:
        http, payload = b"", block
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    kind = fields.get("warc-type", "")
    if algorithm == "sha256" and kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest.lower():
        raise Bad("payload does not have its digest")
    size = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http) if kind == "revisit" else None
    number = {n: m and int(m[1]) for n in ("warc-record-id", "warc-refers-to")
              for m in [re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(n, ""))]}
    return {"record_type": kind, "page_id": number["warc-record-id"], "refers_to": number["warc-refers-to"],
            "uri": fields.get("warc-target-uri"), "payload_digest": digest.lower() or None,
            "payload_bytes": int(size[1]) if size else len(payload),
            "payload": None if kind == "revisit" else payload}, end + len(END)


def unpacked(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at ``at`` unpacks to, as far as it does; where it ends (None if it does
    not unpack to its end) and the reason."""
    unpack, out, done, view = zlib.decompressobj(31), [], at, memoryview(data)
    while done < len(data) and not unpack.eof:
        part, before = view[done:done + PIECE], unpack.copy()
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            # a call that fails gives nothing back: bytes go in one by one up to the damage
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i:i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, "member does not unpack"
        done += len(part)
    if not unpack.eof:
        return b"".join(out), None, "member is cut off"
    return b"".join(out), done - len(unpack.unused_data), ""


def taken(data: bytes, at: int, size: int) -> int:
    """Where the bytes of the member at ``at`` end that its first ``size`` unpacked bytes are from."""
    unpack, done, got, piece = zlib.decompressobj(31), at, 0, PIECE
    while got < size:
        part, before = memoryview(data)[done:done + piece], unpack.copy()
        try:
            got += len(unpack.decompress(part, size - got))
        except zlib.error:
            # the damage is in this piece, behind the bytes that are looked for
            unpack, piece = before, 1
            continue
        done += len(part) - len(unpack.unconsumed_tail)
    return done


def rows_of(plain: bytes) -> Iterator[dict]:
    """Records of an unpacked member, and the gaps between them."""
    at, gap, reason = 0, None, ""
    while at < len(plain):
        try:
            row, end = parse(plain, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            found = plain.find(VERSION, at + 1)
            at = found if found >= 0 else len(plain)
            continue
        if gap is not None:
            yield {"kind": "gap", "unpacked_offset": gap, "unpacked_size": at - gap, "reason": reason}
            gap = None
        yield {"kind": "record", "unpacked_offset": at, "unpacked_size": end - at, **row}
        at = end
    if gap is not None:
        yield {"kind": "gap", "unpacked_offset": gap, "unpacked_size": len(plain) - gap, "reason": reason}


def read_at(data: bytes, at: int) -> tuple[list[dict], int, dict | None]:
    """Records and gaps of the gzip member or the plain record at ``at``, where they end, and the
    gap that starts there if the member does not unpack to its end."""
    if not data.startswith(MAGIC, at):
        row, end = parse(data, at)
        return [{"kind": "record", **row}], end, None
    plain, end, reason = unpacked(data, at)
    rows = list(rows_of(plain))
    if rows and all(r["kind"] == "gap" for r in rows):
        raise Bad(reason or rows[0]["reason"])
    if end is not None:
        return rows, end, None
    if not rows:
        raise Bad(reason)
    if rows[-1]["kind"] == "gap":
        rows.pop()
    good = rows[-1]["unpacked_offset"] + rows[-1]["unpacked_size"]
    return rows, taken(data, at, good), {"reason": reason, "unpacked_offset": good, "unpacked_size": len(plain) - good}


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one archive with their offsets, and the gaps between them."""
    at, gap, why = 0, None, {}
    while at < len(data):
        try:
            rows, end, broken = read_at(data, at)
        except Bad as e:
            if gap is None:
                gap, why = at, {"reason": str(e)}
            found = NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "size": at - gap, **why}
            gap = None
        for row in rows:
            yield {"offset": at, "size": end - at, **row}
        at = end
        if broken:
            gap, why = end, broken
            found = NEXT.search(data, end)
            at = found.start() if found else len(data)
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "size": len(data) - gap, **why}


ROW = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("uri", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("unpacked_offset", T.LongType()), T.StructField("unpacked_size", T.LongType())])
ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()])
                   for f in ROW])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of ROW for all archives below ``path``: records, and gaps with their reason. A file is
    read by one task and has to fit its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for row in salvage(data.as_py()):
                    rows.append({"file": name.as_py(), **row} if payloads else {"file": name.as_py(), **row, "payload": None})
                    held += len(rows[-1].get("payload") or b"")
                    if len(rows) >= 500 or held >= FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROW)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back without payloads. A gap in an
    archive just written is an error, not a missing row."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write(pages, path, **columns)
    damaged = F.raise_error(F.concat(F.lit("damaged archive: "), F.col("file"), F.lit(", "), F.coalesce("reason", F.lit(""))))
    return read(spark, path, payloads=False).withColumn("kind", F.when(F.col("kind") == "record", F.col("kind")).otherwise(damaged))
