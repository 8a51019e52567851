"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from warcloom.plans import catalogue

TABLES = "/root/testdata/sf0.001"
SOME = ("list_default_fields", "list_json", "header_serialize", "filter_combined", "get_by_position_and_id", "get_by_position", "digest_test_vectors", "digest_mismatch", "media_type_parse", "u64_strict", "url_path_components", "extract_classify", "path_conflict_plan", "export_no_block", "verify_summary", "verify_segment_header", "verify_refers_to_uri", "verify_refers_to_date", "verify_own_segments", "verify_payload_digest", "rat_fault_by_file", "multi_input_union", "warc_stream_arrivals", "verify_missing_segment", "verify_segment_length", "export_messages", "warc_roundtrip_zstandard", "warc_index_splits", "import_export_cbor_seq", "http_decode_chunked_gzip")


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, TABLES).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
