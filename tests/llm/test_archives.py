import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snapfeed.llm import archives


def pages(llm, rows, extra=True):
    df = llm.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({"value": F.lit("x"), "payload": F.lit("x"), "date": F.lit("x")}) if extra else df


def rows():
    rng = random.Random(2)
    bodies = ["", None, "plain", "a\nb\n\nc\r\n\r\nd\r\n\r\n\r\n", "\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é漢\n" * 400,
              "http://x 0.0.0.0 20200101000000 text/html 5\nhello" * 30, "z" * 300000, "HTTP/1.1 200 OK\r\nX-Page-Id: 77\r\n\r\nbody"]
    out = [(i, f"http://h{i % 5}.example/{i}?q= a\tb", rng.choice(bodies) if i > 11 else bodies[i % 11]) for i in range(60)]
    return out + [(100, None, "z" * 300000), (101, "", "é漢\n" * 400), (102, "u", "é漢\n" * 400), (102, "u", "é漢\n" * 400), (None, "v", "é漢\n" * 400), (None, "w", None)]


def brute(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and b in last and i != last[b]
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(llm, scratch, version):
    own = rows()
    archives.write_arc(pages(llm, own).repartition(3), f"{scratch}/arc", version)
    back = archives.read_arc(llm, f"{scratch}/arc").collect()
    assert sorted((str(r["page_id"]), r["payload"]) for r in back) == sorted((str(i), h or "") for i, _, h in own)
    assert {r["version"] for r in back} == {version} and all(" " not in r["url"] for r in back)
    archives.convert(llm, f"{scratch}/arc", f"{scratch}/warc")
    out = archives.read_warc(llm, f"{scratch}/warc").collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == brute(own)
    ids = {(r["page_id"], r["payload_digest"]): r["record_id"] for r in out if r["record_type"] == "response"}
    for r in out:
        assert r["declared_digest"] == r["payload_digest"] and r["date"].endswith("Z")
        if r["record_type"] == "revisit":
            assert r["payload"] == "" and r["refers_to_id"] == ids[r["refers_to"], r["payload_digest"]]


def test_files_are_valid(llm, scratch):
    """A plain reader that knows only declared lengths reads the files too."""
    archives.write_arc(pages(llm, rows()).coalesce(1), f"{scratch}/arc", 1)
    archives.convert(llm, f"{scratch}/arc", f"{scratch}/warc")
    n = 0
    for p in Path(scratch, "warc").glob("part-*.gz"):
        data = gzip.decompress(p.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
            assert data[length:length + 4] == b"\r\n\r\n"
            data, n = data[length + 4:], n + 1
    assert n == len(rows())


def test_hand_written_arc():
    block = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\nmissing\n"
    lines = (b"filedesc://old.arc 0.0.0.0 19990101000000 text/plain 76\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n"
             b"http://a.example/ 1.2.3.4 19990102030405 text/html %d\n%s\nnot a header\n"
             b"http://b.example/ 1.2.3.4 19990102030406 text/plain 4\nab\nc\nhttp://c.example/ 1.2.3.4 19990102030407 text/plain 99\ncut" % (len(block), block)).split(b"\n")
    out = list(archives.arc_records(iter(lines)))
    assert [(r["url"], r["payload"], r["status"]) for r in out] == [("http://a.example/", b"missing\n", "404"), ("http://b.example/", b"ab\nc", "")]


def test_empty_table(llm, scratch):
    archives.write_arc(pages(llm, []), f"{scratch}/arc", 1)
    archives.convert(llm, f"{scratch}/arc", f"{scratch}/warc")
    assert archives.read_warc(llm, f"{scratch}/warc").count() == 0


def test_conversion_keeps_every_byte(llm, scratch):
    """Status, headers and payloads of any encoding come out as they went in."""
    blocks = [b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\ncaf\xe9", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + b"\xe9\xff\x00" * 500,
              b"20200101 a.example A 1.2.3.4\n", b"HTTP/1.1 301 Moved\r\nLocation: /x\r\n\r\n", b"HTTP/1.0 200 OK\r\n\r\n" + "\u6f22".encode("utf-16")]
    about = b"1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://o.arc 0.0.0.0 19990101000000 text/plain %d\n%s\n" % (len(about), about)
    for i, b in enumerate(blocks):
        data += b"http://a.example/%d 1.2.3.4 1999010203040%d %s %d\n%s\n" % (i, i, b"text/dns" if i == 2 else b"text/html", len(b), b)
    Path(scratch, "arc").mkdir()
    Path(scratch, "arc", "old.arc.gz").write_bytes(gzip.compress(data))
    archives.convert(llm, f"{scratch}/arc", f"{scratch}/warc")
    found = {}
    for p in Path(scratch, "warc").glob("part-*.gz"):
        left = gzip.decompress(p.read_bytes())
        while left:
            head, _, left = left.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            found[fields[b"WARC-Target-URI"][-1:]] = (left[:n], fields)
            left = left[n + 4:]
    assert {k: v[0] for k, v in found.items()} == {b"%d" % i: b for i, b in enumerate(blocks)}
    for i, b in enumerate(blocks):
        payload = b.partition(b"\r\n\r\n")[2] if b.startswith(b"HTTP") else b
        fields = found[b"%d" % i][1]
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(payload).hexdigest().encode()
        assert fields[b"WARC-Type"] == (b"resource" if i == 2 else b"response") and fields[b"WARC-Date"] == b"1999-01-02T03:04:0%dZ" % i
    assert found[b"2"][1][b"Content-Type"] == b"text/dns"
    back = {r["url"][-1]: r for r in archives.read_warc(llm, f"{scratch}/warc").collect()}
    assert all(r["declared_digest"] == r["payload_digest"] for r in back.values())


def test_a_plain_file_that_would_be_split_is_refused(llm, scratch):
    own = [(i, "u", "x" * 5000) for i in range(60)]
    archives.write_arc(pages(llm, own).coalesce(1), f"{scratch}/arc", 1, codec=None)
    assert archives.read_arc(llm, f"{scratch}/arc").count() == 60
    before = llm.conf.get("spark.sql.files.maxPartitionBytes")
    llm.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        with pytest.raises(ValueError, match="would be split"):
            archives.read_arc(llm, f"{scratch}/arc")
        archives.write_arc(pages(llm, own).coalesce(1), f"{scratch}/gz", 1)
        assert archives.read_arc(llm, f"{scratch}/gz").count() == 60
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", before)
