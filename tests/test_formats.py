"""The plain-Python layers: records, headers, digests, URLs, HTTP, sequences."""

import base64
import gzip
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from warcloom.errors import ArchiveError
from warcloom.functions import digests, hashes, urls
from warcloom.operators import http1
from warcloom.sources import codecs, sequences
from warcloom.sources import warcio as w

TWO = b"WARC/1.1\r\nContent-Length: 12\r\n\r\nHello world!\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def scan(data, codec="identity", **k):
    return list(w.read_records(io.BytesIO(data), codec, **k))


def kind(data, codec="identity"):
    with pytest.raises(ArchiveError) as e:
        scan(data, codec)
    return e.value.kind


def test_positions_and_blocks():
    a, b = scan(TWO)
    assert (a.position, a.block, b.position, b.block) == (0, b"Hello world!", 48, b"")
    assert [r.position for r in scan(TWO, include_block=False)] == [0, 48]
    assert scan(b"") == []


def test_bad_input():
    assert kind(b"CDX\r\n") == "UnknownHeader"
    assert kind(b"\x1f\x8babc") == "UnexpectedCompression"
    assert kind(TWO[:20]) == "UnexpectedEof"
    assert kind(TWO[:40]) == "UnexpectedEof"
    assert kind(TWO.replace(b"world!\r\n\r\n", b"world!xxxx")) == "InvalidRecordBoundary"
    assert kind(b"WARC/1.1\r\nA: b\r\n\r\n\r\n\r\n") == "InvalidContentLength"
    assert kind(b"WARC/1.1\r\nContent-Length: +1\r\n\r\nx\r\n\r\n") == "InvalidContentLength"
    assert kind(b"WARC/1.1\r\nA: " + b"x" * 40_000 + b"\r\n\r\n") == "HeaderTooBig"
    assert w.detect(b"WARC") is None and w.detect(b"AAAAA") == "unknown" and w.detect(b"\x28\xb5") is None


@pytest.mark.parametrize("codec,dictionary,packed", [("identity", None, False), ("gzip", None, False), ("zstd", None, False), ("zstd", b"abc" * 99, False), ("zstd", b"abc" * 99, True)])
def test_generated_archive(codec, dictionary, packed):
    out, at, blocks = io.BytesIO(), [], []
    writer = w.Writer(out, codec, "low", dictionary, packed)
    for r in range(100):
        rng = random.Random(r)
        n = rng.randint(100 + 1234 * r, 199 + 1234 * r)
        block = bytes(255 if k % 10 == 9 else 0 for k in range(n)) if rng.random() < 0.5 else rng.randbytes(n)
        label = digests.show("sha1", hashes.digest("sha1", block))
        h = w.Header.new(n, "resource")
        h.fields += [("WARC-Block-Digest", label), ("WARC-Target-URI", "urn:example:test")]
        at.append(writer.write(h, block))
        blocks.append(block)
    rows = scan(out.getvalue(), codec)
    assert [r.position for r in rows] == at and [r.block for r in rows] == blocks
    assert not any(r.rat_fault for r in rows)
    assert all(digests.parse(w.get(r.header.fields, "warc-block-digest"))[1] == hashes.digest("sha1", r.block) for r in rows)
    f = io.BytesIO(out.getvalue())
    f.seek(at[40])
    assert next(w.read_records(f, codec, dictionary=dictionary, position=at[40])).block == blocks[40]


def test_rat_fault_and_trailing_member():
    assert [r.rat_fault for r in scan(gzip.compress(TWO), "gzip")] == [True, True]
    parts = gzip.compress(TWO[:48]) + gzip.compress(TWO[48:])
    assert [(r.position, r.rat_fault) for r in scan(parts + gzip.compress(b""), "gzip")] == [(0, False), (len(gzip.compress(TWO[:48])), False)]
    split = gzip.compress(TWO[:30]) + gzip.compress(TWO[30:48]) + gzip.compress(TWO[48:])
    assert [r.block for r in scan(split, "gzip")] == [b"Hello world!", b""]


def test_headers():
    assert w.header_end(b"") is None and w.header_end(b"a") is None
    for data, end in ((b"\r\nrest", 2), (b"q\r\n\r\nrest", 5), (b"q\r\nrs\r\n\r\nrest", 9), (b"q\nr\n\nrest", 5)):
        assert w.header_end(data) == end
    assert w.field_pairs(b"one:1\r\ntwo:\r\nthree:3\r\nbad line\r\nfour:v\r\n") == [(b"one", b"1"), (b"two", b""), (b"three", b"3")]
    assert w.field_pairs(b"n: v  \r\n") == [(b"n", b"v  ")]
    assert w.remove_line_folding(b"one\r\n  two\n \tthree") == b"one two three"
    h = w.Header.parse(b"WARC/1.1\r\nA: 1\r\nB: 2\r\na: 3\r\n\r\n")
    assert h.fields == [("B", "2"), ("a", "3")] and w.get(h.fields, "A") == "3"
    assert w.Header.parse(b"WARC/1.1\r\nA: 1\r\na: 3\r\n\r\n", "all").fields == [("A", "1"), ("a", "3")]
    data = b"WARC/1.1\r\nWARC-Record-ID: <example:123456>\r\nContent-Length: 0\r\n\r\n"
    assert w.Header.parse(data).serialize() == data
    with pytest.raises(ArchiveError):
        w.Header("WARC/1.1", [("a b", "c")]).validate()
    with pytest.raises(ArchiveError):
        w.Writer(io.BytesIO()).write(w.Header("WARC/1.1", [("Content-Length", "3")]), b"xx")


def test_digests():
    raw = "b1946ac92492d2347c6235b4d2611184"
    for label in (f"md5:{raw}", "MD5:WGKGVSJESLJDI7DCGW2NEYIRQQ======", "md5:wgkgvsjesljdi7dcgw2neyirqq"):
        assert digests.parse(label) == ("md5", bytes.fromhex(raw))
    sha = "sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"
    assert digests.show(*digests.parse(sha.replace("sha1", "Sha-1"))) == sha
    assert hashes.digest("sha1", b"abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq").hex() == "84983e441c3bd26ebaae4aa1f95129e5e54670f1"
    assert hashes.crc32c(b"123456789") == 0xE3069283
    long = random.Random(1).randbytes(70_001)
    assert hashes.crc32c(long) == hashes._crc_small(long, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert hashes.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashes.blake3(bytes(i % 251 for i in range(3072))).hex().startswith("b98cb0ff3623be03326b373de6b90952")
    assert hashes.xxh3_64(b"Hello world!") == 1867774166239376822
    for bad in ("md5", "none:00", "md5:xyz", "sha-224:00"):
        with pytest.raises(ArchiveError):
            digests.parse(bad)
    m = hashes.MultiHasher(["md5", "sha1"])
    m.update(b"a"), m.update(b"b")
    assert m.finish()["md5"] == hashes.digest("md5", b"ab") and m.finish()["md5"] == hashes.digest("md5", b"")


def test_blake3_of_many_inputs(monkeypatch):
    """Short inputs are hashed together: steps of numpy are counted by depth, not by input."""
    data = [bytes(k % 251 for k in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 7168, 31_744)]
    steps, compress = [], hashes._compress
    monkeypatch.setattr(hashes, "_compress", lambda cv, *rest: steps.append(1) or compress(cv, *rest))
    got = hashes.blake3_each(data * 40)
    assert len(steps) < 40
    assert got == [hashes.blake3(x) for x in data] * 40 == hashes.blake3_each(data * 40, most=1)
    assert got[10].hex().startswith("b98cb0ff3623be03326b373de6b90952")
    assert hashes.blake3_each([]) == []



def test_url_paths():
    for a, b in (("", ""), (" ", "_"), (".", "_"), ("..", "__"), ("/", "%2F"), ("nul", "_nul"), ("nul.tar.gz", "_nul.tar.gz"), ("?", "%3F"), ("ÿ", "%C3%BF"), ("a" * 300, "a" * 200)):
        assert urls.escape_component(a) == b
    assert urls.path_components("urn:example:test") == ["urn", "example%3Atest"]
    assert urls.path_components("http://EX.com:80/a/../b%20c?q#f") == ["http", "ex.com", "b c", "q"]
    assert urls.parse("http://") is None and urls.parse("no url") is None and urls.parse("http://1.2.3.4.5/") is None
    assert urls.is_ip("::1") and not urls.is_ip("fe80::1%eth0") and not urls.is_ip("10.0.0.256")


def test_http():
    assert http1.parse_header(b"HTTP/1.1 200\r\n\r\n").status_code == 200
    assert http1.parse_header(b"http/1.1 200 OK\r\n\r\n").reason == b"OK"
    with pytest.raises(ArchiveError):
        http1.parse_header(b"ICY 200 OK\r\n\r\n")
    get = b"GET /index.html HTTP/1.1\r\nHost: a\r\nX: y\r\n\r\n"
    assert http1.parse_header(get).header_bytes() == get
    two = b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\nHello world!HTTP/1.1 404 \r\n\r\nNot found."
    m, n = http1.decode(two)
    assert m.body == b"Hello world!" and http1.decode(two[n:])[0].body == b"Not found."
    assert http1.chunk_encode([b"Hello world!"]) == b"c\r\nHello world!\r\n0\r\n\r\n"
    body = gzip.compress(b"Hello world!")
    sent = http1.encode(http1.Message.response(200, fields=[("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], body=body, trailers=[("my-field", "1")]), chunked=True, chunk=2)
    m, n = http1.decode(sent + b"HTTP/1.1 204 x\r\n\r\n")
    assert m.body == b"Hello world!" and m.trailers == [("my-field", "1")] and n == len(sent)
    assert http1.decode(b"HTTP/1.1 200 x\r\nContent-Length: 99\r\n\r\nshort")[0].body == b"short"
    with pytest.raises(ArchiveError) as e:
        http1.decode(b"HTTP/1.1 200 x\r\nContent-Encoding: foo\r\n\r\nx")
    assert e.value.kind == "UnsupportedContentEncoding"


def test_codecs():
    for name in ("gzip", "deflate", "zstd", "identity"):
        assert codecs.decompress(name, codecs.compress(name, b"Hello world")) == b"Hello world"
    assert codecs.decompress("gzip", gzip.compress(b"Hello") + gzip.compress(b"world")) == b"Helloworld"
    assert codecs.of_file("A.WARC.GZ") == "gzip"
    with pytest.raises(ArchiveError):
        codecs.of_file("a.txt")
    with pytest.raises(ArchiveError):
        codecs.read_dictionary(io.BytesIO(b"12345678"))


def test_sequences():
    assert list(sequences.read_items(b"\x1e123\n\x1e456\n", "json-seq")) == [123, 456]
    assert list(sequences.read_items(bytes.fromhex("187b1901c8"), "cbor-seq")) == [123, 456]
    with pytest.raises(ArchiveError):
        list(sequences.read_items(b"\x19\x01", "cbor-seq"))
    value = sequences.message_value("BlockChunk", {"data": b"\x00\xff"}, True)
    assert value == {"BlockChunk": {"data": base64.b64encode(b"\x00\xff").decode()}} and sequences.message_of(value) == ("BlockChunk", {"data": b"\x00\xff"})


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text() | st.binary(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(values)
def test_cbor_round_trip(v):
    assert sequences.cbor_decode(sequences.cbor_encode(v))[0] == v


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.sampled_from(["identity", "gzip", "zstd"]))
def test_archive_round_trip(blocks, codec):
    out = io.BytesIO()
    writer = w.Writer(out, codec)
    at = [writer.write(w.Header("WARC/1.0", [("Content-Length", str(len(b)))]), b) for b in blocks]
    assert [(r.position, r.block) for r in scan(out.getvalue(), codec)] == list(zip(at, blocks))
