"""Scans, filters, verification, extraction and messages on a small archive."""

import os

import pytest

from warcloom.errors import ParseError
from warcloom.functions import fields as fl
from warcloom.functions.register import register_functions
from warcloom.operators import extract as ex
from warcloom.operators import verify as ve
from warcloom.plans import verbs
from warcloom.sources import messages as ms
from warcloom.sources.archive import read_archive, record_index, write_archive
from warcloom.sources.warcio import Header, Writer

DATE = "2024-01-01T00:00:00Z"


def record(typ, rid, block=b"x", **more):
    base = {"WARC-Record-ID": f"<urn:{rid}>", "WARC-Type": typ, "WARC-Date": DATE, "Content-Length": str(len(block))}
    base |= {k.replace("_", "-"): v for k, v in more.items()}
    return Header("WARC/1.1", [(k, v) for k, v in base.items() if v is not None]), block


@pytest.fixture
def archive(spark, tmp_path):
    def make(*records, name="a.warc.gz", codec="gzip"):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        with open(folder / name, "wb") as f:
            writer = Writer(f, codec)
            for h, b in records:
                writer.write(h, b)
        return str(folder)

    return make


def problems(spark, folder, **k):
    return {(r.record_id[5:-1], r.kind, r.arg) for r in ve.verify(read_archive(spark, folder), **k).collect()}


RULES = [
    (record("resource", 1, WARC_Target_URI="http://a/", WARC_Date=None), ("RequiredFieldMissing", "WARC-Date")),
    (record("odd", 1), ("UnknownRecordType", "odd")),
    (record("metadata", 1, WARC_Date="2025"), ("InvalidDate", "WARC-Date")),
    (record("metadata", 1, Content_Type="a b"), ("InvalidMediaType", "Content-Type")),
    (record("warcinfo", 1, WARC_Concurrent_To="<urn:1>"), ("ProhibitedField", "WARC-Concurrent-To")),
    (record("metadata", 1, WARC_IP_Address="1.2.3.999"), ("InvalidIpAddress", "WARC-IP-Address")),
    (record("warcinfo", 1, WARC_IP_Address="::1"), ("ProhibitedField", "WARC-IP-Address")),
    (record("warcinfo", 1, WARC_Refers_To="<urn:1>"), ("ProhibitedField", "WARC-Refers-To")),
    (record("metadata", 1, WARC_Refers_To_Target_URI="http://a/"), ("ProhibitedField", "WARC-Refers-To-Target-URI")),
    (record("revisit", 1, WARC_Target_URI="http://a/", WARC_Refers_To_Target_URI="nope"), ("InvalidUrl", "WARC-Refers-To-Target-URI")),
    (record("revisit", 1, WARC_Target_URI="http://a/", WARC_Refers_To_Date="2024-13-01"), ("InvalidDate", "WARC-Refers-To-Date")),
    (record("resource", 1), ("RequiredFieldMissing", "WARC-Target-URI")),
    (record("resource", 1, WARC_Target_URI="<http://a/>"), ("BadSpecUri", "WARC-Target-URI")),
    (record("resource", 1, WARC_Target_URI="::"), ("InvalidUrl", "WARC-Target-URI")),
    (record("metadata", 1, WARC_Truncated="odd"), ("InvalidTruncatedReason", "odd")),
    (record("warcinfo", 1, WARC_Target_URI="http://a/"), ("ProhibitedField", "WARC-Target-URI")),
    (record("metadata", 1, WARC_Filename="x"), ("ProhibitedField", "WARC-Filename")),
    (record("metadata", 1, WARC_Profile="<http://a/>"), ("BadSpecUri", "WARC-Target-URI")),
    (record("metadata", 1, WARC_Segment_Origin_ID="<urn:1>"), ("ProhibitedField", "WARC-Segment-Origin-ID")),
    (record("metadata", 1, WARC_Segment_Number="+1"), ("ParseInt", "WARC-Segment-Number")),
    (record("continuation", 1, WARC_Target_URI="http://a/", WARC_Segment_Number="1", WARC_Segment_Origin_ID="<urn:1>", WARC_Segment_Total_Length="1"), ("InvalidSegment", None)),
    (record("metadata", 1, WARC_Block_Digest="md5:" + "0" * 32), ("DigestMismatch", None)),
    (record("metadata", 1, WARC_Block_Digest="odd:00"), ("UnknownDigest", "odd:00")),
    (record("metadata", 1, WARC_Warcinfo_ID="<urn:9>"), ("ReferencedRecordMissing", "<urn:9>")),
    (record("resource", 1, b"x", WARC_Target_URI="http://a/", WARC_Payload_Digest="md5:" + "0" * 32), ("PayloadDigestMismatch", None)),
]


def test_rules_all_at_once(spark, archive):
    """One archive with a record for each rule: every rule is broken by its own record, and a clean record by none."""
    rows = []
    for k, (r, _) in enumerate(RULES):
        fields = [(n, f"<urn:{k + 100}>" if n == "WARC-Record-ID" else v) for n, v in r[0].fields]
        rows.append((Header("WARC/1.1", fields), r[1]))
    clean = record("resource", 1, b"abc", WARC_Target_URI="http://a/", WARC_Block_Digest="sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5")
    found = problems(spark, archive(clean, *rows))
    for k, (_, (kind, arg)) in enumerate(RULES):
        assert (str(k + 100), kind, arg) in found, (k, kind, arg)
    assert not any(f[0] == "1" for f in found)


def test_segments_references_and_files(spark, archive):
    total = {"WARC_Segment_Origin_ID": "<urn:1>", "WARC_Target_URI": "http://a/"}
    archive(record("resource", 1, b"abc", WARC_Target_URI="http://a/", WARC_Segment_Number="1"), record("continuation", 2, b"de", WARC_Segment_Number="2", **total))
    folder = archive(record("continuation", 5, b"xyz", WARC_Segment_Number="5", WARC_Segment_Total_Length="9", **total), record("metadata", 6, WARC_Refers_To="<urn:2>"), name="b.warc", codec="identity")
    found = problems(spark, folder)
    assert ("1", "MissingSegment", "3") in found and ("1", "MismatchedSegmentLength", None) in found
    assert not any(k == "ReferencedRecordMissing" for _, k, _ in found)  # the target is in the other file
    assert not problems(spark, folder, exclude=("segment",))
    with pytest.raises(ValueError):
        problems(spark, folder, exclude=("nothing",))


def test_state_spans_runs(spark, archive, tmp_path):
    state = str(tmp_path / "state")
    folder = archive(record("metadata", 1, WARC_Refers_To="<urn:2>"))
    assert {p.kind for p in ve.verify(read_archive(spark, folder), state_path=state).collect()} == {"ReferencedRecordMissing"}
    later = archive(record("metadata", 2), name="z.warc.gz")
    assert ve.verify(read_archive(spark, f"{later}/z.warc.gz"), state_path=state).count() == 0


def test_scan_options(spark, archive, tmp_path):
    folder = archive(*(record("resource", k, b"b" * k, WARC_Target_URI="http://a/") for k in range(7)))
    r = read_archive(spark, folder)
    at = r.orderBy("record_index").collect()
    assert [x.content_length for x in at] == list(range(7))
    assert read_archive(spark, f"{folder}/a.warc.gz", position=at[3].position).first().content_length == 3
    assert verbs.get_record(spark, f"{folder}/a.warc.gz", at[3].position, "<urn:4>").isEmpty()
    assert all(x.block is None for x in read_archive(spark, folder, includeBlock="false").collect())
    record_index(spark, folder).write.parquet(str(tmp_path / "index"))
    assert sorted(x.record_index for x in read_archive(spark, folder, index=str(tmp_path / "index"), recordsPerSplit=3).collect()) == list(range(7))
    with open(f"{folder}/a.warc.gz", "ab") as f:
        f.write(b"\x1f\x8bjunk")
    rows = read_archive(spark, folder, mode="PERMISSIVE").collect()
    assert len(rows) == 8 and [x._error.kind for x in rows if x._error] == ["UnknownHeader"]
    with pytest.raises(Exception, match="no archive record|UnknownHeader"):
        read_archive(spark, folder).count()


def test_filters(spark):
    rows = [([("n", v)],) for v in ("cat", "dog", "bird", "cat-and-dog")]
    df = spark.createDataFrame([([{"name": n, "value": v} for n, v in f[0]],) for f in rows], "fields array<struct<name: string, value: string>>")
    value = lambda **k: [r[0][0].value for r in df.where(fl.field_filter("fields", **k)).collect()]
    assert value(include=["n:dog"], exclude=["n:cat"]) == ["dog"]
    assert value(include_pattern=[r"N:\bdog\b"], exclude_pattern=[r"n:\bcat\b"]) == ["dog"]
    assert value(include=["N"]) == ["cat", "dog", "bird", "cat-and-dog"] and value(include=["m"]) == []
    for bad in (r"n:(?=a)", r"n:(a)\1", "n:a++"):
        with pytest.raises(ParseError):
            fl.field_filter("fields", include_pattern=[bad])


def test_extract_tree(spark, archive, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    folder = archive(
        record("response", 1, http, WARC_Target_URI="http://a/x", Content_Type="application/http;msgtype=response"),
        record("resource", 2, b"two", WARC_Target_URI="http://a/x"),
        record("resource", 3, b"two", WARC_Target_URI="http://a/x"),
        record("resource", 4, b"deep", WARC_Target_URI="http://a/x/y"),
        record("conversion", 5, b"conv", WARC_Target_URI="http://a/c", WARC_Truncated="length"),
        record("resource", 6, b"seg", WARC_Target_URI="http://a/s", WARC_Segment_Number="1"),
    )
    out = tmp_path / "out"
    out.mkdir()
    done = ex.write_tree(read_archive(spark, folder), str(out), continue_on_error=True).collect()
    tree = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(out) for f in fs}
    assert tree["http/a/x"] == b"hi" and tree["http/a/x⬧d/y"] == b"deep" and tree["http/a/c⬧conversion⬧truncated"] == b"conv"
    assert len(tree) == 4 and sorted(tree.values()).count(b"two") == 1
    assert [r.error for r in done if r.error] == ["UnsupportedSegmentedRecord"]
    with pytest.raises(Exception, match="segment"):
        ex.extracted(read_archive(spark, folder)).count()


@pytest.mark.parametrize("fmt", ["json-seq", "jsonl", "cbor-seq"])
def test_messages_round_trip(spark, archive, tmp_path, fmt):
    r = read_archive(spark, archive(*(record("resource", k, os.urandom(k * 3000), WARC_Target_URI="http://a/é") for k in range(4))))
    m = ms.to_messages(r, extract=True)
    ms.write_messages(m, str(tmp_path / "m"), fmt, single=True)
    back = ms.read_messages(spark, str(tmp_path / "m"), fmt=fmt).orderBy("record_index").collect()
    want = r.orderBy("record_index").collect()
    assert [(b.fields, bytes(b.block)) for b in back] == [(x.fields, bytes(x.block)) for x in want]
    write_archive(ms.read_messages(spark, str(tmp_path / "m"), fmt=fmt), str(tmp_path / "w"), "zstandard", files=1)
    assert read_archive(spark, str(tmp_path / "w")).count() == 4


def test_import_errors():
    head = b'{"Header": {"fields": [], "version": "WARC/1.0"}}\n{"BlockChunk":{"data":"YQ=="}}\n'
    run = lambda end: list(ms.records_of(head + end, "jsonl", "f"))
    assert run(b'{"BlockEnd":{"crc32":3904355907,"crc32c":null,"xxh3":null}}')[0][6] == b"a"
    for end, kind in ((b'{"BlockEnd":{"crc32":1}}', "ChecksumMismatch"), (b'{"BlockEnd":{}}', "Sequence"), (b"", "UnexpectedEof"), (b'{"Header":{}}', "Sequence")):
        with pytest.raises(ParseError) as e:
            run(end)
        assert e.value.kind == kind


def test_sql_functions(spark, tmp_path):
    register_functions(spark)
    row = spark.sql("SELECT http_decode(encode('HTTP/1.1 200 OK\\r\\n\\r\\nhi', 'utf-8')).status_code AS c, url_path_components('http://a/b') AS p, ip_is_valid('1.1.1.1') AS i, hex(blake3(encode('', 'utf-8'))) AS h").first()
    assert row.c == 200 and row.p == ["http", "a", "b"] and row.i and row.h.startswith("AF1349B9")
    data = spark.sql("SELECT * FROM warc_records(encode('WARC/1.1\\r\\nContent-Length: 1\\r\\n\\r\\nx\\r\\n\\r\\n', 'utf-8'), 'identity')").collect()
    assert [bytes(r.block) for r in data] == [b"x"]


def test_lookup_is_pushed_and_filters_stay_native(spark, archive):
    r = read_archive(spark, archive(record("resource", 1, WARC_Target_URI="http://a/")))
    plan = r.where(fl.field_filter("fields", include=["WARC-Type:resource"]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_empty_archive(spark, archive):
    r = read_archive(spark, archive())
    assert r.count() == 0 and ve.verify(r).count() == 0 and ms.to_messages(r).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_problem_json(spark):
    df = spark.createDataFrame([("a", "InvalidSegment", None, None, None, None), ("b", "RequiredFieldMissing", 'x"y', None, None, None), ("c", "MismatchedSegmentLength", None, None, "1", "2"), ("d", "MissingSegment", "3", None, None, None)], "record_id string, kind string, arg string, algorithm string, expected string, actual string")
    assert [r[0] for r in df.select(ve.to_json_text(df)).collect()] == ['{"record_id":"a","kind":"InvalidSegment"}', '{"record_id":"b","kind":{"RequiredFieldMissing":"x\\"y"}}', '{"record_id":"c","kind":{"MismatchedSegmentLength":{"expect":1,"actual":2}}}', '{"record_id":"d","kind":{"MissingSegment":3}}']
