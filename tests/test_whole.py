"""Queries do the whole job: every rule, every record and every byte of a result."""

import json
import os

import pytest
from test_catalogue import TABLES
from test_spark import archive, problems, record  # noqa: F401

from warcloom.operators import verify as ve
from warcloom.plans import catalogue
from warcloom.sources.archive import read_archive

needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def test_continuation_needs_total_length(spark, archive):  # noqa: F811
    folder = archive(record("continuation", 1, WARC_Target_URI="http://h/", WARC_Segment_Origin_ID="<urn:0>", WARC_Segment_Number="2"))
    assert ("1", "RequiredFieldMissing", "WARC-Segment-Total-Length") in problems(spark, folder)


def test_segment_number_zero_is_none(spark, archive):  # noqa: F811
    """Segments are numbered from 1: a record with number 0 leaves no gap after it and adds nothing to the length."""
    part = {"WARC_Target_URI": "http://h/", "WARC_Segment_Origin_ID": "<urn:1>", "WARC_Segment_Total_Length": "3"}
    rows = [record("continuation", 5, b"zzzz", WARC_Segment_Number="0", **part), record("resource", 1, b"a", WARC_Target_URI="http://h/", WARC_Segment_Number="1"), record("continuation", 2, b"bc", WARC_Segment_Number="2", **part)]
    assert not {k for _, k, _ in problems(spark, archive(*rows))} & {"MissingSegment", "MismatchedSegmentLength"}


def test_payload_of_a_segmented_record(spark, archive):  # noqa: F811
    folder = archive(record("response", 1, WARC_Target_URI="http://h/", WARC_Segment_Number="1", WARC_Payload_Digest="md5:" + "0" * 32))
    assert ("1", "ParsePayload", "UnsupportedSegmentedRecord") in problems(spark, folder)


@needs_tables
def test_verify_scans_once(spark):
    """The records are read by the survey alone; every problem comes from the table that it wrote."""
    plan = ve.verify(read_archive(spark, catalogue._written(spark, TABLES, "gzip")))._jdf.queryExecution().optimizedPlan().toString()
    assert "warc" not in plan.lower().split("relation")[0] and "PythonMapInArrow" not in plan and plan.count("RelationV2") == 0


def sql_rows(sql: str, tables: str = TABLES) -> list[tuple]:
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet'")
    return sorted(con.sql(sql).fetchall())


@needs_tables
def test_url_paths_of_all_records(spark):
    """A record without target URI has an empty path; no record is left out."""
    want = sql_rows(f"WITH {catalogue._REC} SELECT page_id, CASE WHEN warc_target_uri IS NULL THEN '' ELSE array_to_string({catalogue._PATH}, '/') END FROM rec")
    got = sorted((r.page_id, r.path) for r in catalogue.QUERIES["url_path_components"](spark, TABLES).collect())
    assert got == want and any(p == "" for _, p in got)


@needs_tables
def test_export_without_blocks_is_whole(spark):
    """Both messages of each record, with all of their fields in order."""
    got = sorted((r.page_id, r.kind, r.head) for r in catalogue.QUERIES["export_no_block"](spark, TABLES).collect())
    dumps = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    want = []
    for row in sql_rows(f"WITH {catalogue._REC} SELECT page_id, file, position, {', '.join(catalogue._COLUMNS.values())} FROM rec"):
        page, file, position, *values = row
        fields = [[n.lower() if page % 2 else n, v] for n, v in zip(catalogue._COLUMNS, values) if v is not None]
        want.append((page, "Metadata", dumps({"Metadata": {"file": file, "position": position}})))
        want.append((page, "Header", dumps({"Header": {"version": "WARC/1.1", "fields": fields}})))
    assert got == sorted(want)


@needs_tables
def test_stream_reports_all_problems(spark):
    """Arriving files give the problems of all rules, and those of the state over all of them, as one batch would."""
    got = catalogue.QUERIES["warc_stream_arrivals"](spark, TABLES)
    want = ve.verify(read_archive(spark, catalogue._written(spark, TABLES, "gzip"))).select("record_id", "kind", "arg")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    assert {"DigestMismatch", "ReferencedRecordMissing", "InvalidTruncatedReason"} <= {r.kind for r in got.collect()}
