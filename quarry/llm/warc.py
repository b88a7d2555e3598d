"""WARC archives: a writer of gzip members, and a reader that splits archives by byte ranges.

Writing: every task writes one archive, a gzip member for each record. Pages with equal payloads have one
response; the others are revisits that refer to it. Reading: an archive is cut into byte ranges without
looking inside. A task scans its range for the gzip magic, takes a candidate for a member only if its
decoded head is a WARC record's, and owns the records that start inside its range; the last may end beyond
it. No index is needed, and any range can be read again after a lost executor.

Archives lie in the shared folder and are reached through Arrow's file systems, so its scheme may be any
that Arrow knows on the cluster (file, hdfs, s3, gs). A retried write gives the same file under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, staged_path, table

# Fixed values of the format.
MAGIC, VERSION, REVISIT = b"\x1f\x8b\x08", b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a range, bytes read at a time, and copies of the table of repeated payloads against skew.
RANGE, BLOCK, SALTS = 16 << 20, 1 << 20, 16
DATE = "1970-01-01T00:00:00Z"
#: What a record starts with, and what stands for a member that breaks off.
MARK, BROKEN = b"WARC/", "broken"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def _safe(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:unknown")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or where first is given a revisit of it; uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_first(pages: DataFrame, payload: Column, least_revisit: int = 0) -> DataFrame:
    """Adds _first: for a page whose payload an earlier page has, the smallest id with it, else null.

    Repeated payloads alone are joined, by digest and salt, so a payload that holds any part of all rows is
    dealt to SALTS tasks at least; it is an outer join on its left side, so adaptive execution splits these
    further where they are large. Null ids are no payload's first.
    """
    keyed = pages.withColumn("_digest", F.sha1(payload)).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    large = F.octet_length(payload) >= least_revisit
    firsts = keyed.filter(large).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    firsts = firsts.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])))
    joined = keyed.join(firsts, ["_digest", "_salt"], "left")
    return joined.withColumn("_first", F.when(large & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_digest", "_salt")


def write_archives(pages: DataFrame, folder: str, *, payload: str = "html", least_revisit: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, payload) and return a table of archives: path, size, records.

    A null payload is empty. Rows that repeat the smallest id of a payload are all responses; so are all rows
    of a payload whose ids are null. An empty table may write no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        context, out, records, size = TaskContext.get(), None, 0, 0
        name = f"part-{context.partitionId():06d}.warc.gz"
        own = f"{root}/.{name}.{context.taskAttemptId()}"
        for batch in batches:
            for row in batch.to_pylist():
                out = out or files.open_output_stream(own)
                data = row["payload"] or b""
                packed = member(record(row["page_id"], row["url"], data, base32_sha1(data), row["_first"]))
                out.write(packed)
                records, size = records + 1, size + len(packed)
        if out:
            out.close()
            files.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], names=["path", "size", "records"])

    rows = with_first(pages.select("page_id", "url", F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")), F.col("payload"), least_revisit)
    return stage(rows.select("page_id", "url", "payload", "_first").mapInArrow(write, "path string, size long, records long"), "archives")


class _Window:
    """Bytes of a file from a place on, read as they are asked for; what lies before is dropped."""

    def __init__(self, file, at: int):
        self.file = file
        self.to(at)

    def to(self, at: int) -> None:
        """Start afresh at a place."""
        self.at, self.data, self.over = at, b"", False
        self.file.seek(at)

    def next(self) -> bool:
        """Drop what is held and take the next block in its place."""
        self.at += len(self.data)
        self.data = b"" if self.over else self.file.read(BLOCK)
        self.over = not self.data
        return not self.over

    def more(self) -> bool:
        got = b"" if self.over else self.file.read(BLOCK)
        self.over = not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data, self.at = self.data[to - self.at :], to


def _decode(window: _Window, at: int) -> tuple[bytes, int] | str | None:
    """The record in the member at a place and where the member ends, None if none starts there, or BROKEN if one does and can't be decoded to its end.

    Once its head is known to be a record's, a member is decoded block by block, and no block is held twice.
    """
    probe, head = zlib.decompressobj(31), b""
    window.drop(at)
    feed = window.data
    while len(head) < len(MARK) and not probe.eof:
        try:
            head += probe.decompress(feed, len(MARK) - len(head))
        except zlib.error:
            return None
        if len(head) < len(MARK) and not probe.eof:
            before = len(window.data)
            if not window.more():
                return None
            feed = window.data[before:]
    if head != MARK:
        return None
    unpacker = zlib.decompressobj(31)
    try:
        found = [unpacker.decompress(window.data)]
    except zlib.error:
        return BROKEN
    while not unpacker.eof:
        if not window.next():
            return BROKEN
        try:
            found.append(unpacker.decompress(window.data))
        except zlib.error:
            return BROKEN
    end = window.at + len(window.data) - len(unpacker.unused_data)
    window.drop(end)
    return b"".join(found), end


def members(file, start: int, end: int, *, broken: bool = False) -> Iterator[tuple[int, bytes | None]]:
    """Place and content of the records whose member starts in [start, end).

    With broken, also None for what starts like a record's member but can't be decoded to its end: a damaged member,
    or, where a range starts inside a record that holds such bytes as they are, these.
    """
    window, at = _Window(file, start), start
    while at < end:
        found = window.data.find(MAGIC, at - window.at)
        if found < 0:
            at = max(at, window.at + len(window.data) - len(MAGIC) + 1)
            window.drop(at)
            if not window.more():
                return
            continue
        at = window.at + found
        if at >= end:
            return
        got = _decode(window, at)
        if isinstance(got, tuple):
            yield at, got[0]
            at = got[1]
            continue
        if got is BROKEN and broken:
            yield at, None
        at += 1
        if window.at > at:  # the member broke off after its head
            window.to(at)


def headers(head: bytes) -> dict[str, str]:
    """Header fields by their name in small letters; the space after the colon may be missing, folded lines are joined, the first of a name counts, and other lines are left out."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    pairs = [line.partition(":") for line in lines[1:]]
    return {name.strip().lower(): value.strip() for name, colon, value in reversed(pairs) if colon}


def _blank(data: bytes) -> tuple[bytes, bytes]:
    """What comes before and after the first empty line; all and nothing where there is none."""
    found = re.search(rb"\r?\n\r?\n", data)
    return (data[: found.start()], data[found.end() :]) if found else (data, b"")


def parse(data: bytes | None) -> dict:
    """A record's fields. A response's payload is what follows its HTTP head, a revisit's is None and as long as its HTTP head says, if it does; records of other types have their block as payload.

    A record that can't be decoded, has no type or no length, or is shorter than it says comes back with its error.
    """
    none = dict.fromkeys(_FIELDS)
    if data is None:
        return none | {"error": "damaged member"}
    head, rest = _blank(data)
    own = headers(head)
    kind, length = own.get("warc-type", "").lower(), own.get("content-length", "")
    page = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d{1,18})>", x)) else None
    about = none | {"page_id": page(own.get("warc-record-id")), "record_type": kind or None, "refers_to": page(own.get("warc-refers-to")), "url": own.get("warc-target-uri")}
    if not kind or not re.fullmatch(r"[0-9]{1,18}", length):
        return about | {"error": "no type" if not kind else "no length"}
    if len(rest) < int(length):
        return about | {"error": f"{len(rest)} of {length} bytes"}
    block = rest[: int(length)]
    inner, payload = _blank(block) if kind in ("response", "revisit") and block.startswith(b"HTTP/") else (b"", block)
    if kind == "revisit":
        size = headers(inner).get("content-length", "")
        digest = re.sub("(?i)^sha1:", "", own.get("warc-payload-digest", ""))
        return about | {"payload_bytes": int(size) if re.fullmatch("[0-9]{1,18}", size) else None, "payload_digest": digest or None}
    return about | {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload}


_FIELDS = {
    "page_id": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_type": ("string", pa.string()),
    "refers_to": ("long", pa.int64()), "url": ("string", pa.string()), "payload": ("binary", pa.binary()), "error": ("string", pa.string()),
}


def read_archives(archives: DataFrame, *, range_bytes: int = RANGE, fields: tuple[str, ...] = tuple(_FIELDS), types: tuple[str, ...] | None = None) -> DataFrame:
    """Records of a table of archives (path, size), read by byte ranges of range_bytes, which are dealt a task each.

    Records of every type come back unless types names some. Damaged records come back with what is known of them and
    an error, so that they can be counted; without the field error they are left out. Archives of no bytes and an empty
    table give no rows; a record's null page id or url come back as null and a placeholder; bytes that are no record's
    are skipped.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                files, path = _filesystem(part["path"])
                with files.open_input_file(path) as file:
                    rows, held = [], 0
                    for _, data in members(file, part["start"], part["start"] + range_bytes, broken="error" in fields):
                        row = parse(data)
                        if (row["error"] is None or "error" in fields) and (types is None or row["record_type"] in types or row["record_type"] is None):
                            rows.append(row)
                            held += len(data or b"")
                        if held > 16 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    yield pack(rows)

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], _FIELDS[f][1]) for f in fields], names=list(fields))

    ranges = archives.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    total = archives.agg(F.sum("size")).first()[0] or 0
    many = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // range_bytes) + 1)
    return ranges.select("path", "start").repartition(many, "path", "start").mapInArrow(read, ", ".join(f"{f} {_FIELDS[f][0]}" for f in fields))


def op7_warc(spark, sf_dir):
    """Every page's record, read back from archives.

    A null html is an empty payload; of pages with equal payloads the smallest id is the response, and rows that
    repeat it are responses too; pages with null ids revisit it; an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_archives(pages, staged_path(spark, "warc"))
    return read_archives(archives, fields=("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


QUERIES = {"op7_warc": op7_warc}
