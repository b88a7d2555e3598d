"""Archives that others wrote: any header style and record type, and members that are damaged."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello"


def made(head, block, version="WARC/1.0", line="\r\n"):
    return (version + line + line.join(head) + line + line + block + line + line).encode()


RECORDS = {
    "warcinfo": (made(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields", "Content-Length: 11"], "software: x"), ("warcinfo", 11, None)),
    "small letters": (made(["warc-type: response", "warc-target-uri: http://a/", f"content-length: {len(HTTP)}"], HTTP), ("response", 5, None)),
    "no space": (made(["WARC-Type:response", "WARC-Target-URI:http://a/", f"Content-Length:{len(HTTP)}"], HTTP), ("response", 5, None)),
    "revisit": (made(["WARC-Type: revisit", "WARC-Refers-To: <urn:page:7>", "WARC-Payload-Digest: SHA1:ABC", "Content-Length: 0"], ""), ("revisit", None, None)),
    "request": (made(["WARC-Type: request", "Content-Length: 18"], "GET / HTTP/1.1\r\n\r\n"), ("request", 18, None)),
    "no type": (made(["Content-Length: 0"], ""), (None, None, "no type")),
    "no length": (made(["WARC-Type: metadata"], ""), ("metadata", None, "no length")),
    "short": (made(["WARC-Type: resource", "Content-Length: 99"], "abc"), ("resource", None, "7 of 99 bytes")),
    "folded": (made(["WARC-Type: resource", "X-Long: a", "\tb", "no colon", "Content-Length: 3"], "abc"), ("resource", 3, None)),
    "bare lines": (made(["WARC-Type: resource", "Content-Length: 3"], "abc", line="\n"), ("resource", 3, None)),
}


@pytest.mark.parametrize("name", RECORDS)
def test_records_of_others(name):
    data, (kind, size, error) = RECORDS[name]
    got = warc.parse(data)
    assert (got["record_type"], got["payload_bytes"], got["error"]) == (kind, size, error)
    if name == "revisit":
        assert got["refers_to"] == 7 and got["payload_digest"] == "ABC" and got["payload"] is None


def test_damaged_members_are_counted(spark, tmp_path):
    whole = [gzip.compress(d) for d, _ in RECORDS.values()]
    draw = random.Random(3)
    large = made(["WARC-Type: resource", "Content-Length: 300000"], "".join(chr(draw.randint(33, 122)) for _ in range(300_000)))
    broken = bytearray(gzip.compress(large))
    broken[len(broken) // 2 : len(broken) // 2 + 40] = bytes(40)
    cut = gzip.compress(large)[:-5000]
    raw = b"junk" + whole[0] + b"\x1f\x8b\x08no member" + whole[1] + bytes(broken) + b"".join(whole[2:]) + cut
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(raw)
    table = spark.createDataFrame([(str(path), len(raw))], "path string, size long")
    for size in (len(raw) + 1, 1000, 77):
        rows = warc.read_archives(table, range_bytes=size).collect()
        errors = sorted(r.error for r in rows if r.error)
        assert errors == ["7 of 99 bytes", "damaged member", "damaged member", "no length", "no type"] and len(rows) == len(RECORDS) + 2
    assert warc.read_archives(table, fields=("record_type", "url"), types=("response",)).count() == 2
    assert {r[0] for r in warc.read_archives(table, fields=("record_type",)).collect()} == {"warcinfo", "response", "revisit", "request", "resource"}
    assert io.BytesIO(raw).read(4) == b"junk" and warc.read_archives(table.filter(F.lit(False))).count() == 0
