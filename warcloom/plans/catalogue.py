"""Queries over a synthetic archive made from the tables `pages` and `conversations`, with DuckDB SQL for the same rows.

Every page is a record with header fields by its number, some of them broken on purpose, so that each operator and each
rule has rows that pass and rows that don't. The Spark side goes through the library's operators; the SQL side states the
expected rows on plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, fields as fl
from ..functions.urls import ip_is_valid, url_path_components
from ..model import BINARY
from ..operators import extract as ex
from ..operators import http1
from ..operators import verify as ve
from ..scratch import new_folder
from ..sources import messages as ms
from ..sources.archive import read_archive, record_index, write_archive
from . import verbs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The fields of a page's record: name, SQL for its value (null: absent). Both engines run this text.
_N = "(SELECT count(*) FROM pages)"
_TYPE = """CASE WHEN page_id % 37 = 5 THEN 'profile' WHEN page_id % 37 = 6 THEN 'Response' WHEN page_id % 8 = 0 THEN 'warcinfo' WHEN page_id % 8 = 1 THEN 'response'
  WHEN page_id % 8 = 2 THEN 'resource' WHEN page_id % 8 = 3 THEN 'request' WHEN page_id % 8 = 4 THEN 'metadata' WHEN page_id % 8 = 5 THEN 'revisit' WHEN page_id % 8 = 6 THEN 'conversion' ELSE 'continuation' END"""
_FIELDS = {
    "WARC-Record-ID": "CASE WHEN page_id % 97 <> 13 THEN concat('<urn:page:', page_id, '>') END",
    "WARC-Type": _TYPE,
    "WARC-Date": "CASE WHEN page_id % 41 = 7 THEN '2024' WHEN page_id % 41 = 8 THEN NULL WHEN page_id % 41 = 9 THEN '2024-02-30T00:00:00Z' ELSE concat('2024-01-', right(concat('0', 1 + page_id % 28), 2), 'T00:00:00Z') END",
    "Content-Length": "concat('', octet_length(BYTES(html)))",
    "Content-Type": "CASE WHEN page_id % 29 = 3 THEN 'bad type' WHEN page_id % 3 = 0 THEN 'application/http; msgtype=response' WHEN page_id % 3 = 1 THEN 'text/html;charset=utf-8' END",
    "WARC-Target-URI": "CASE WHEN page_id % 23 = 1 THEN NULL WHEN page_id % 19 = 4 THEN concat('<', url, '>') ELSE url END",
    "WARC-Refers-To": f"CASE WHEN page_id % 5 = 2 THEN concat('<urn:page:', (page_id * 7) % ({_N} + 20), '>') END",
    "WARC-Concurrent-To": f"CASE WHEN page_id % 7 = 3 THEN concat('<urn:page:', (page_id * 3) % ({_N} + 10), '>') END",
    "WARC-Truncated": "CASE WHEN page_id % 17 = 2 THEN 'length' WHEN page_id % 17 = 3 THEN 'bogus' END",
    "WARC-IP-Address": "CASE WHEN page_id % 13 = 1 THEN concat('10.0.0.', page_id % 300) END",
    "WARC-Filename": "CASE WHEN page_id % 31 = 4 THEN 'x.warc.gz' END",
    "WARC-Profile": "CASE WHEN page_id % 43 = 3 THEN '<http://profile.example/>' END",
    "WARC-Block-Digest": "CASE WHEN page_id % 12 = 0 THEN concat('md5:', md5(concat(html, 'x'))) WHEN page_id % 6 = 0 THEN concat('md5:', md5(html)) END",
    "WARC-Payload-Digest": "CASE WHEN page_id % 7 = 2 THEN concat('md5:', md5(CASE WHEN page_id % 5 = 0 THEN concat(html, 'y') ELSE html END)) END",
    "WARC-Refers-To-Target-URI": "CASE WHEN page_id % 9 = 4 THEN url WHEN page_id % 9 = 5 THEN 'nope' END",
    "WARC-Refers-To-Date": "CASE WHEN page_id % 11 = 6 THEN '2024-01-05T00:00:00Z' WHEN page_id % 11 = 7 THEN '2024-13-05T00:00:00Z' END",
    "WARC-Segment-Total-Length": "CASE WHEN page_id % 80 = 31 THEN 'x' WHEN page_id % 16 = 15 THEN concat('', octet_length(BYTES(html)) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) WHEN page_id % 61 = 8 THEN '5' END",
    "WARC-Segment-Number": "CASE WHEN page_id % 71 = 15 THEN '0' WHEN page_id % 47 = 3 THEN 'one' WHEN page_id % 8 = 7 THEN concat('', 1 + page_id % 3) END",
    "WARC-Segment-Origin-ID": "CASE WHEN page_id % 8 = 7 AND page_id % 16 <> 7 THEN concat('<urn:page:', page_id - 1, '>') WHEN page_id % 53 = 2 THEN '<urn:x>' END",
}
_COLUMNS = {n: n.lower().replace("-", "_") for n in _FIELDS}
_FILE, _BASE = "concat('pages-', page_id % 4, '.warc')", "page_id, url, html"


def _duck(sql: str) -> str:
    return sql.replace("BYTES(html)", "encode(html)")


_REC = f"""rec AS (
  SELECT {_BASE}, {_FILE} AS file, page_id // 4 AS record_index, octet_length(encode(html)) AS n_bytes, page_id % 50 = 49 AS rat_fault,
    (sum(octet_length(encode(html)) + 512) OVER (PARTITION BY page_id % 4 ORDER BY page_id) - octet_length(encode(html)) - 512)::BIGINT AS position,
    {", ".join(f"{_duck(v)} AS {_COLUMNS[n]}" for n, v in _FIELDS.items())} FROM pages
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as records: the schema of a scan, with page_id beside it."""
    from pyspark.sql import Window as W

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = pages.count()
    value = lambda v: F.expr(v.replace(_N, str(n)).replace("BYTES(html)", "html"))
    # every second record writes its names in lower case
    name = lambda x: F.when(F.col("page_id") % 2 == 1, x.lower()).otherwise(x)
    pairs = F.array(*[F.struct(name(k).alias("name"), value(v).cast("string").alias("value")) for k, v in _FIELDS.items()])
    size = F.octet_length("html").cast("long")
    w = W.partitionBy(F.col("_id") % 4).orderBy("_id")
    # positions are summed up over ids and sizes alone; a query that doesn't ask for them has no join
    places = pages.select(F.col("page_id").alias("_id"), size.alias("_size")).select("_id", "_size", (F.sum(F.col("_size") + 512).over(w) - F.col("_size") - 512).alias("position"))
    places = places.groupBy("_id", "_size").agg(F.max("position").alias("position"))
    pages = pages.withColumn("_n", size)
    pages = pages.join(places, (F.col("page_id") == F.col("_id")) & (F.col("_n") == F.col("_size")), "left")
    return pages.select(
        "page_id", F.expr(_FILE).alias("file"), "position", F.expr("page_id div 4").alias("record_index"), F.lit("WARC/1.1").alias("version"),
        F.filter(pairs, lambda f: f["value"].isNotNull()).alias("fields"), size.alias("content_length"), F.col("html").cast("binary").alias("block"), (F.col("page_id") % 50 == 49).alias("rat_fault"),
    )


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def over_records(name: str, sql: str | None, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query of the records; sql goes on from the common table rec."""
    query(name, None if sql is None else f"WITH {_REC}{sql if sql.startswith(',') else ' ' + sql}")(lambda spark, d: build(records(spark, d)))


def get(name: str) -> Column:
    return fl.field_or_empty("fields", name)


# ---- list: projection

over_records("list_default_fields", "SELECT position, coalesce(warc_record_id, '') AS record_id, coalesce(warc_type, '') AS warc_type, coalesce(content_type, '') AS content_type, coalesce(warc_target_uri, '') AS target_uri FROM rec", lambda r: verbs.list_records(r, names=("position", "record_id", "warc_type", "content_type", "target_uri")))
over_records("list_custom_fields", "SELECT file, position, coalesce(warc_date, '') AS warc_date, coalesce(content_length, '') AS length FROM rec", lambda r: verbs.list_records(r, (":file", ":position", "warc-DATE", "Content-Length"), ("file", "position", "warc_date", "length")))
over_records("list_missing_field_empty", "SELECT page_id, '' AS nothing FROM rec", lambda r: r.select("page_id", get("X-None").alias("nothing")))
over_records("list_json", """SELECT page_id, '[' || position || ',' || to_json(coalesce(warc_type, ''))::VARCHAR || ']' AS text FROM rec""", lambda r: verbs.list_as_json(r, (":position", "WARC-Type")).join(r.select("page_id", "file", "record_index"), ["file", "record_index"]).select("page_id", "text"))
over_records("field_get_first_icase", "SELECT page_id, warc_type AS v FROM rec", lambda r: r.select("page_id", fl.get_field("fields", "wArC-tYpE").alias("v")))
over_records("field_get_all", "SELECT page_id, CASE WHEN warc_ip_address IS NULL THEN 'b' ELSE warc_ip_address || ',b' END AS v FROM rec", lambda r: r.select("page_id", F.concat_ws(",", fl.get_all_fields(fl.append_field("fields", "warc-ip-address", "b"), "WARC-IP-Address")).alias("v")))
over_records("field_contains_count", f"SELECT page_id, warc_profile IS NOT NULL AS has, {' + '.join(f'({c} IS NOT NULL)::INT' for c in _COLUMNS.values())} AS n FROM rec", lambda r: r.select("page_id", fl.has_field("fields", "WARC-Profile").alias("has"), fl.n_fields("fields").alias("n")))
over_records("field_insert_remove", "SELECT page_id, 'new' AS v, 0 AS gone FROM rec", lambda r: r.select("page_id", fl.get_field(fl.insert_field("fields", "WARC-TYPE", "new"), "WARC-Type").alias("v"), F.size(fl.get_all_fields(fl.remove_field("fields", "warc-date"), "WARC-Date")).alias("gone")))
over_records("header_serialize", "SELECT page_id, md5('WARC/1.1' || chr(13) || chr(10) || list_aggregate(list_transform(list_filter([" + ", ".join(f"CASE WHEN page_id % 2 = 1 THEN '{n.lower()}' ELSE '{n}' END || ': ' || {c}" for n, c in _COLUMNS.items()) + "], lambda x: x IS NOT NULL), lambda x: x || chr(13) || chr(10)), 'string_agg', '') || chr(13) || chr(10)) AS h FROM rec", lambda r: r.select("page_id", F.md5(fl.serialize_header("version", "fields")).alias("h")))

# ---- filters

for _name, _rules, _where in (
    ("filter_include_name", {"include": ["WARC-Profile"]}, "warc_profile IS NOT NULL"),
    ("filter_include_value", {"include": ["WARC-Type:response"]}, "warc_type = 'response'"),
    ("filter_exclude_name", {"exclude": ["WARC-Truncated"]}, "warc_truncated IS NULL"),
    ("filter_exclude_value", {"exclude": ["WARC-Type:request"]}, "warc_type IS DISTINCT FROM 'request'"),
    ("filter_include_regex", {"include_pattern": [r"WARC-Target-URI:/(en|fr)/\d+"]}, r"regexp_matches(coalesce(warc_target_uri, ''), '/(en|fr)/\d+')"),
    ("filter_exclude_regex", {"exclude_pattern": [r"WARC-Type:^re"]}, "NOT regexp_matches(warc_type, '^re')"),
    ("filter_combined", {"include": ["WARC-Type:response", "WARC-Filename"], "include_pattern": ["Content-Type:html"], "exclude": ["WARC-Truncated:bogus"], "exclude_pattern": ["WARC-Target-URI:#top$"]}, "(warc_type = 'response' OR warc_filename IS NOT NULL OR coalesce(content_type LIKE '%html%', false)) AND warc_truncated IS DISTINCT FROM 'bogus' AND NOT coalesce(regexp_matches(warc_target_uri, '#top$'), false)"),
):
    over_records(_name, f"SELECT page_id, file FROM rec WHERE {_where}", lambda r, k=_rules: r.where(fl.field_filter("fields", **k)).select("page_id", "file"))

# ---- lookup: an archive is written and indexed; the record is read at its position in its file

_WANTED = "<urn:page:17>"


def _lookup(spark: SparkSession, d: str, rid: str | None) -> DataFrame:
    folder = _written(spark, d, "gzip")
    at = record_index(spark, folder).where(F.col("record_id") == _WANTED).first()
    return verbs.get_record(spark, at.file, at.position, rid).select(get("WARC-Record-ID").alias("record_id"), get("WARC-Type").alias("warc_type"), F.md5("block").alias("block_md5"))


_HIT = f"SELECT coalesce(warc_record_id, '') AS record_id, coalesce(warc_type, '') AS warc_type, md5(html) AS block_md5 FROM rec WHERE warc_record_id = '{_WANTED}'"
query("get_by_position", f"WITH {_REC} {_HIT}")(lambda spark, d: _lookup(spark, d, None))
query("get_by_position_and_id", f"WITH {_REC} {_HIT}")(lambda spark, d: _lookup(spark, d, _WANTED))
query("get_id_mismatch", "SELECT 0::BIGINT AS n")(lambda spark, d: _lookup(spark, d, "<urn:page:2>").agg(F.count("*").alias("n")))

# ---- digests

for _alg in ("md5", "sha1", "sha256"):
    over_records(f"digest_{_alg}", f"SELECT page_id, {_alg}(html) AS v FROM rec", lambda r, a=_alg: r.select("page_id", F.lower(F.hex(digests.digest(a, "block"))).alias("v")))
for _alg in ("sha512", "crc32c", "xxh3", "sha3-256", "sha3-512", "blake2s", "blake2b", "blake3"):
    over_records(f"digest_{_alg.replace('-', '_')}", None, lambda r, a=_alg: r.select("page_id", F.lower(F.hex(digests.digest(a, "block"))).alias("v")))
over_records("digest_crc32", None, lambda r: r.select("page_id", digests.crc32("block").alias("v")))
over_records("checksums_one_pass", None, lambda r: r.select("page_id", digests.checksums("block").alias("s")).select("page_id", "s.*"))
over_records("digest_parse_hex", "SELECT page_id, 'md5' AS algorithm, md5(html) AS v FROM rec", lambda r: r.select("page_id", digests.digest_parse(F.concat(F.lit("MD5:"), F.md5("block"))).alias("d")).select("page_id", "d.algorithm", F.lower(F.hex("d.value")).alias("v")))
over_records("digest_hex_format", "SELECT page_id, 'sha256:' || sha256(html) AS v FROM rec", lambda r: r.select("page_id", digests.digest_format(F.lit("sha256"), digests.digest("sha256", "block")).alias("v")))
over_records("digest_base32_round_trip", "SELECT page_id, sha1(html) AS v FROM rec", lambda r: r.select("page_id", digests.digest_parse(digests.digest_format(F.lit("sha1"), digests.digest("sha1", "block"))).alias("d")).select("page_id", F.lower(F.hex("d.value")).alias("v")))
over_records("digest_mismatch", "SELECT coalesce(warc_record_id, '') AS record_id, 'md5' AS algorithm, md5(html || 'x') AS expected, md5(html) AS actual FROM rec WHERE page_id % 12 = 0", lambda r: ve.digest_problems(r, ("block-digest",)).select("record_id", "algorithm", "expected", "actual"))


# Published test vectors of the digests that SQL lacks (FIPS 180-4 and 202, RFC 7693, the CRC catalogue's check values, the
# reference vectors of BLAKE3 and XXH3; a CRC-32C digest has its lowest byte first)
_VECTORS = (
    ("sha512", "abc", "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"),
    ("sha3-256", "abc", "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"),
    ("sha3-512", "abc", "b751850b1a57168a5693cd924b6b096e08f621827444f70d884f5d0240d2712e10e116e9192af3c91a7ec57647e3934057340b4cf408d5a56592f8274eec53f0"),
    ("blake2s", "abc", "508c5e8c327c14e2e1a72ba34eeb452f37458b209ed63a294d999b4c86675982"),
    ("blake2b", "abc", "ba80a53f981c4d0d6a2797b69f12f6e94c212f14685ac4b74b12bb6fdbffa2d17d87c5392aab792dc252d5de4533cc9518d38aa8dbf1925ab92386edd4009923"),
    ("blake3", "abc", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"),
    ("blake3", "", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
    ("crc32c", "123456789", "839206e3"),
    ("crc32", "123456789", "cbf43926"),
    ("xxh3", "", "2d06800538d394c2"),
    ("xxh3", "abc", "78af5f94892f3950"),
)


@query("digest_test_vectors", f"SELECT * FROM (VALUES {', '.join(repr(v) for v in _VECTORS)}) t(algorithm, input, v)")
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([v[:2] for v in _VECTORS], "algorithm string, input string")
    data = F.encode("input", "UTF-8")
    v = F.when(F.col("algorithm") == "crc32", F.lower(F.lpad(F.hex(digests.crc32(data)), 8, "0")))
    for a in sorted({x[0] for x in _VECTORS} - {"crc32"}):
        v = v.when(F.col("algorithm") == a, F.lower(F.hex(digests.digest(a, data))))
    return rows.select("algorithm", "input", v.alias("v"))


# ---- scalar functions

_TC = r"[0-9A-Za-z!#$%&''*+\-.^_`|~]+"
over_records("media_type_parse", rf"SELECT page_id, regexp_extract(content_type, '^([^/]+)/', 1) AS typ, regexp_extract(content_type, '/([^; ]+)', 1) AS subtyp, regexp_extract(content_type, '=(.*)$', 1) AS first_parameter FROM rec WHERE regexp_matches(content_type, '^{_TC}/{_TC}([ \t]*;[ \t]*{_TC}={_TC})*$')", lambda r: r.select("page_id", fl.media_type(fl.get_field("fields", "Content-Type")).alias("m")).where("m IS NOT NULL").select("page_id", F.col("m.type").alias("typ"), F.col("m.subtype").alias("subtyp"), F.map_values("m.parameters")[0].alias("first_parameter")))
over_records("u64_strict", "SELECT page_id, CASE WHEN regexp_matches(warc_segment_number, '^[0-9]+$') THEN warc_segment_number END AS v, n_bytes AS length FROM rec", lambda r: r.select("page_id", fl.u64_strict(fl.get_field("fields", "WARC-Segment-Number")).cast("string").alias("v"), fl.content_length("fields").cast("long").alias("length")))
over_records("date_rfc3339_valid", "SELECT page_id, warc_date IS NOT NULL AND page_id % 41 NOT IN (7, 9) AS ok FROM rec", lambda r: r.select("page_id", fl.is_rfc3339(fl.get_field("fields", "WARC-Date")).alias("ok")))
over_records("url_unwrap", "SELECT page_id, CASE WHEN warc_target_uri LIKE '<%>' THEN url ELSE coalesce(warc_target_uri, '') END AS v, coalesce(warc_target_uri LIKE '<%>', false) AS wrapped FROM rec", lambda r: r.select("page_id", fl.unbracketed(get("WARC-Target-URI")).alias("v"), fl.is_bracketed(get("WARC-Target-URI")).alias("wrapped")))
over_records("ip_valid", "SELECT page_id, page_id % 300 < 256 AS ok FROM rec WHERE warc_ip_address IS NOT NULL", lambda r: r.where(fl.has_field("fields", "WARC-IP-Address")).select("page_id", ip_is_valid(get("WARC-IP-Address")).alias("ok")))
over_records("line_unfold", "SELECT page_id, 'a b ' || page_id AS v FROM rec", lambda r: r.select("page_id", fl.unfold(F.concat(F.lit("a\r\n  b\n\t"), F.col("page_id"))).alias("v")))
over_records(
    "name_value_valid",
    f"SELECT page_id, regexp_matches(coalesce(warc_type, ''), '^{_TC}$') AS type_is_name, regexp_matches(coalesce(content_type, ''), '^{_TC}$') AS media_is_name, true AS value_ok FROM rec",
    lambda r: r.select("page_id", fl.is_field_name(get("WARC-Type")).alias("type_is_name"), fl.is_field_name(get("Content-Type")).alias("media_is_name"), fl.is_field_value(get("Content-Type")).alias("value_ok")),
)
over_records("comma_list", "SELECT page_id, 'gzip,br,' || (page_id % 2) AS v FROM rec", lambda r: r.select("page_id", F.concat_ws(",", fl.comma_list(F.concat(F.lit("GZIP , br,gzip, "), (F.col("page_id") % 2).cast("string")))).alias("v")))

# ---- URL paths and extraction

_PATH = r"""list_concat([regexp_extract(url, '^([a-z]+):', 1), regexp_extract(url, '//([^/?#]+)', 1)],
  list_concat(list_filter(string_split(regexp_extract(url, '//[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''),
  CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN [replace(regexp_extract(url, '\?([^#]*)', 1), '|', '%7C')] ELSE [] END))"""
over_records("url_path_components", f"SELECT page_id, CASE WHEN warc_target_uri IS NULL THEN '' ELSE array_to_string({_PATH}, '/') END AS path FROM rec", lambda r: r.select("page_id", F.concat_ws("/", url_path_components(F.when(fl.has_field("fields", "WARC-Target-URI"), fl.unbracketed(get("WARC-Target-URI"))))).alias("path")))
_KIND = "CASE WHEN warc_segment_number IS NOT NULL OR content_type = 'bad type' OR warc_target_uri IS NULL THEN NULL WHEN warc_type = 'response' AND content_type LIKE 'application/http%' THEN 'http' WHEN warc_type IN ('resource', 'conversion') THEN 'plain' END"
over_records("extract_classify", f"SELECT page_id, {_KIND} AS content_kind, CASE WHEN warc_segment_number IS NOT NULL THEN 'UnsupportedSegmentedRecord' WHEN content_type = 'bad type' THEN 'Syntax' END AS content_error FROM rec", lambda r: ex.with_content(r).select("page_id", "content_kind", "content_error"))
over_records("extract_truncated_flag", "SELECT page_id, warc_truncated IS NOT NULL AS is_truncated FROM rec", lambda r: ex.with_content(r).select("page_id", "is_truncated"))
over_records("extract_plain_content", f"SELECT page_id, md5(html) AS h FROM rec WHERE {_KIND} = 'plain'", lambda r: ex.extracted(r, True).join(r.select("page_id", "file", "record_index"), ["file", "record_index"]).where("error IS NULL AND data IS NOT NULL").join(ex.with_content(r).where("content_kind = 'plain'").select("page_id"), "page_id").select("page_id", F.md5("data").alias("h")))


@query("path_conflict_plan", "SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) = 1 THEN 'http/h/p' || page_id % 10 ELSE 'http/h/p' || page_id % 10 || '⬧' || lpad(page_id::VARCHAR, 16, '0') END AS path FROM pages")
def _path_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/pages.parquet")
    parts = F.array(F.lit("http"), F.lit("h"), F.concat(F.lit("p"), (F.col("page_id") % 10).cast("string")))
    items = r.select("page_id", F.lit("f").alias("file"), F.col("page_id").alias("record_index"), parts.alias("components"), F.lit(False).alias("is_truncated"), F.lpad(F.col("page_id").cast("string"), 16, "0").alias("hash"))
    return ex.plan_paths(items).select("page_id", "path")


# ---- verify

_ID = "coalesce(warc_record_id, '') AS record_id"
_NO_REVISIT = "'warcinfo', 'response', 'resource', 'request', 'metadata', 'conversion', 'continuation'"
_RULES = {
    "verify_mandatory": (("mandatory-fields",), f"SELECT {_ID}, 'RequiredFieldMissing' AS kind, 'WARC-Record-ID' AS arg FROM rec WHERE warc_record_id IS NULL UNION ALL SELECT {_ID}, 'RequiredFieldMissing', 'WARC-Date' FROM rec WHERE warc_date IS NULL UNION ALL SELECT {_ID}, 'InvalidDate', 'WARC-Date' FROM rec WHERE page_id % 41 IN (7, 9)"),
    "verify_known_type": (("known-record-type",), f"SELECT {_ID}, 'UnknownRecordType' AS kind, warc_type AS arg FROM rec WHERE warc_type IN ('profile', 'Response')"),
    "verify_content_type": (("content-type",), f"SELECT {_ID}, 'InvalidMediaType' AS kind, 'Content-Type' AS arg FROM rec WHERE content_type = 'bad type'"),
    "verify_prohibited": (("concurrent-to", "refers-to", "filename"), f"SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-Concurrent-To' AS arg FROM rec WHERE warc_concurrent_to IS NOT NULL AND warc_type IN ('warcinfo', 'conversion', 'continuation') UNION ALL SELECT {_ID}, 'ProhibitedField', 'WARC-Refers-To' FROM rec WHERE warc_refers_to IS NOT NULL AND warc_type IN ('warcinfo', 'response', 'resource', 'request', 'continuation') UNION ALL SELECT {_ID}, 'ProhibitedField', 'WARC-Filename' FROM rec WHERE warc_filename IS NOT NULL AND warc_type <> 'warcinfo'"),
    "verify_ip_address": (("ip-address",), f"SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-IP-Address' AS arg FROM rec WHERE warc_ip_address IS NOT NULL AND warc_type IN ('warcinfo', 'conversion', 'continuation') UNION ALL SELECT {_ID}, 'InvalidIpAddress', 'WARC-IP-Address' FROM rec WHERE warc_ip_address IS NOT NULL AND page_id % 300 > 255"),
    "verify_target_uri": (("target-uri",), f"SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-Target-URI' AS arg FROM rec WHERE warc_target_uri IS NOT NULL AND warc_type = 'warcinfo' UNION ALL SELECT {_ID}, 'RequiredFieldMissing', 'WARC-Target-URI' FROM rec WHERE warc_target_uri IS NULL AND warc_type IN ('response', 'resource', 'request', 'revisit', 'conversion', 'continuation') UNION ALL SELECT {_ID}, 'BadSpecUri', 'WARC-Target-URI' FROM rec WHERE warc_target_uri LIKE '<%>'"),
    "verify_truncated": (("truncated",), f"SELECT {_ID}, 'InvalidTruncatedReason' AS kind, 'bogus' AS arg FROM rec WHERE warc_truncated = 'bogus'"),
    "verify_warcinfo_id": (("warcinfo-id",), f"SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-Target-URI' AS arg FROM rec WHERE warc_target_uri IS NOT NULL AND warc_type = 'warcinfo'"),
    "verify_profile": (("profile",), f"SELECT {_ID}, 'RequiredFieldMissing' AS kind, 'WARC-Profile' AS arg FROM rec WHERE warc_type = 'profile' AND warc_profile IS NULL UNION ALL SELECT {_ID}, 'BadSpecUri', 'WARC-Target-URI' FROM rec WHERE warc_profile IS NOT NULL"),
    "verify_refers_to_uri": (("refers-to-target-uri",), f"""
      SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-Refers-To-Target-URI' AS arg FROM rec WHERE warc_refers_to_target_uri IS NOT NULL AND warc_type IN ({_NO_REVISIT})
      UNION ALL SELECT {_ID}, 'InvalidUrl', 'WARC-Refers-To-Target-URI' FROM rec WHERE warc_refers_to_target_uri = 'nope'"""),
    "verify_refers_to_date": (("refers-to-date",), f"""
      SELECT {_ID}, 'ProhibitedField' AS kind, 'WARC-Refers-To-Date' AS arg FROM rec WHERE warc_refers_to_date IS NOT NULL AND warc_type IN ({_NO_REVISIT})
      UNION ALL SELECT {_ID}, 'InvalidDate', 'WARC-Refers-To-Date' FROM rec WHERE warc_refers_to_date LIKE '2024-13%'"""),
    "verify_segment_header": (("segment",), f"""
      SELECT {_ID}, 'RequiredFieldMissing' AS kind, 'WARC-Segment-Origin-ID' AS arg FROM rec WHERE warc_type = 'continuation' AND warc_segment_origin_id IS NULL
      UNION ALL SELECT {_ID}, 'RequiredFieldMissing', 'WARC-Segment-Total-Length' FROM rec WHERE warc_type = 'continuation' AND warc_segment_total_length IS NULL
      UNION ALL SELECT {_ID}, 'RequiredFieldMissing', 'WARC-Segment-Number' FROM rec WHERE warc_type = 'continuation' AND warc_segment_number IS NULL
      UNION ALL SELECT {_ID}, 'ProhibitedField', 'WARC-Segment-Origin-ID' FROM rec WHERE warc_type <> 'continuation' AND warc_segment_origin_id IS NOT NULL
      UNION ALL SELECT {_ID}, 'ProhibitedField', 'WARC-Segment-Total-Length' FROM rec WHERE warc_type <> 'continuation' AND warc_segment_total_length IS NOT NULL
      UNION ALL SELECT {_ID}, 'ParseInt', 'WARC-Segment-Number' FROM rec WHERE warc_segment_number = 'one'
      UNION ALL SELECT {_ID}, 'ParseInt', 'WARC-Segment-Total-Length' FROM rec WHERE warc_segment_total_length = 'x'
      UNION ALL SELECT {_ID}, 'InvalidSegment', NULL FROM rec WHERE warc_type = 'continuation' AND warc_segment_number = '1'"""),
}
for _name, (_checks, _sql) in _RULES.items():
    over_records(_name, _sql, lambda r, c=_checks: ve.header_problems(r, c).select("record_id", "kind", "arg"))
_REFS = f"SELECT DISTINCT {_ID}, warc_concurrent_to AS target FROM rec WHERE warc_concurrent_to IS NOT NULL AND warc_type NOT IN ('warcinfo', 'conversion', 'continuation') UNION SELECT {_ID}, warc_refers_to FROM rec WHERE warc_refers_to IS NOT NULL AND warc_type NOT IN ('warcinfo', 'response', 'resource', 'request', 'continuation')"
_LOST = f"SELECT * FROM ({_REFS}) WHERE target NOT IN (SELECT coalesce(warc_record_id, '') FROM rec)"
over_records("verify_dangling_refs", _LOST, lambda r: ve.dangling(ve.references(r).select("record_id", "target").distinct(), ve.State.of(r).ids).select("record_id", "target"))


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as segmented records: turns are segments, some lost; two in three conversations declare a total."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.octet_length("text").cast("long").alias("length"))
    kept = c.where((F.col("conv_id") + F.col("turn")) % 11 != 0)
    return kept.select(F.col("conv_id").alias("origin"), (F.col("turn") + 1).alias("number"), "length"), c.where("conv_id % 3 <> 0").groupBy(F.col("conv_id").alias("origin")).agg(F.sum("length").alias("total"))


_SEG = "seg AS (SELECT conv_id AS origin, turn + 1 AS number, octet_length(encode(text)) AS length FROM conversations WHERE (conv_id + turn) % 11 <> 0), tot AS (SELECT conv_id AS origin, sum(octet_length(encode(text)))::BIGINT AS total FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1)"
query("verify_missing_segment", f"WITH {_SEG} SELECT origin, b + 1 AS number FROM (SELECT origin, number, lag(number, 1, 0) OVER (PARTITION BY origin ORDER BY number) AS b FROM seg WHERE origin IN (SELECT origin FROM tot)) WHERE number <> b + 1")(lambda spark, d: ve.missing_segments(*_segments(spark, d)))
query("verify_segment_length", f"WITH {_SEG} SELECT tot.origin AS origin, total AS expect, coalesce(sum(length), 0)::BIGINT AS actual FROM tot LEFT JOIN seg ON tot.origin = seg.origin GROUP BY 1, 2 HAVING coalesce(sum(length), 0) <> total")(lambda spark, d: ve.segment_lengths(*_segments(spark, d)))
# the records' own segments; an origin with a declared total has one record, so which of equal keys counts isn't in question
_OWN = """own AS (
  SELECT coalesce(CASE WHEN warc_segment_number = '1' THEN warc_record_id ELSE warc_segment_origin_id END, '') AS origin, warc_segment_number::BIGINT AS number, n_bytes AS length,
    CASE WHEN warc_segment_number <> '1' AND regexp_matches(warc_segment_total_length, '^[0-9]+$') THEN warc_segment_total_length::BIGINT END AS total
  FROM rec WHERE regexp_matches(warc_segment_number, '^[0-9]+$')
), declared AS (SELECT origin, total FROM own WHERE total IS NOT NULL
), numbered AS (SELECT origin, number, length FROM own WHERE number >= 1 AND origin IN (SELECT origin FROM declared))"""
_GAPS = """SELECT origin AS record_id, 'MissingSegment' AS kind, (b + 1)::VARCHAR AS arg FROM (SELECT origin, number, lag(number, 1, 0) OVER (PARTITION BY origin ORDER BY number) AS b FROM numbered) WHERE number <> b + 1
  UNION ALL SELECT origin, 'MismatchedSegmentLength', NULL FROM (SELECT d.origin AS origin, d.total AS total, coalesce(sum(n.length), 0) AS actual FROM declared d LEFT JOIN numbered n ON d.origin = n.origin GROUP BY 1, 2) WHERE actual <> total"""
over_records("verify_own_segments", f", {_OWN} {_GAPS}", lambda r: ve.state_problems(ve.State.of(r, ("segment",)), ("segment",)).where("kind <> 'ReferencedRecordMissing'").select("record_id", "kind", "arg"))
_BLOCK_DIGESTS = f"SELECT {_ID}, 'DigestMismatch' AS kind, NULL AS arg FROM rec WHERE page_id % 12 = 0"
_PAYLOADS = f"""
  SELECT {_ID}, 'ParsePayload' AS kind, CASE WHEN warc_segment_number IS NOT NULL THEN 'UnsupportedSegmentedRecord' WHEN content_type = 'bad type' THEN 'Syntax' ELSE 'UnexpectedEof' END AS arg,
    NULL::VARCHAR AS algorithm, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual
  FROM rec WHERE warc_payload_digest IS NOT NULL AND (warc_segment_number IS NOT NULL OR content_type = 'bad type' OR ({_KIND}) = 'http')
  UNION ALL SELECT {_ID}, 'PayloadDigestMismatch', NULL, 'md5', replace(warc_payload_digest, 'md5:', ''), CASE WHEN ({_KIND}) = 'http' THEN md5('') ELSE md5(html) END
  FROM rec WHERE warc_payload_digest IS NOT NULL AND (({_KIND}) = 'http' OR ({_KIND}) = 'plain' AND page_id % 5 = 0)"""
over_records("verify_payload_digest", _PAYLOADS, lambda r: ve.digest_problems(r, ("payload-digest",)).select("record_id", "kind", "arg", "algorithm", "expected", "actual"))


@F.pandas_udf(BINARY)
def _members(records: pd.Series, together: pd.Series) -> pd.Series:
    """The records of a list as a gzip file: each a member of its own, or all together in one."""
    from ..sources import codecs

    return pd.Series([codecs.compress("gzip", b"".join(map(bytes, x)), "low") if t else b"".join(codecs.compress("gzip", bytes(y), "low") for y in x) for x, t in zip(records, together)], dtype=object)


@query("rat_fault_by_file", f"WITH {_REC} SELECT concat('bundle-', page_id // 8) AS file, arg_max(coalesce(warc_record_id, ''), page_id) AS record_id FROM rec GROUP BY page_id // 8 HAVING count(*) > 1 AND any_value(page_id // 8) % 2 = 1")
def _rat_faults(spark: SparkSession, d: str) -> DataFrame:
    """Files of eight records at most, every second one a single member; the scan finds those."""
    from ..functions.register import register_functions

    register_functions(spark)
    raw = F.concat(fl.serialize_header("version", "fields").cast("binary"), F.col("block"), F.lit(b"\r\n\r\n"))
    r = records(spark, d).select(F.expr("page_id div 8").alias("bundle"), "page_id", raw.alias("raw"))
    files = r.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("page_id", "raw"))).alias("x"))
    files = files.select("bundle", _members(F.transform("x", lambda y: y["raw"]), F.col("bundle") % 2 == 1).alias("data"))
    files.createOrReplaceTempView("bundles_of_records")
    found = spark.sql("SELECT concat('bundle-', bundle) AS file, r.record_index, r.fields, r.rat_fault FROM bundles_of_records, LATERAL warc_records(data, 'gzip') r")
    return ve.rat_faults(found).select("file", "record_id")


_EVERY = " UNION ALL ".join(f"SELECT record_id, kind, arg FROM ({s})" for s in (*(s for _, s in _RULES.values()), _BLOCK_DIGESTS, _PAYLOADS, _GAPS, f"SELECT record_id, 'ReferencedRecordMissing' AS kind, target AS arg FROM ({_LOST})"))
_RAT = "SELECT file AS record_id, 'NotRecordAtTimeCompression' AS kind, NULL AS arg FROM rec GROUP BY file HAVING bool_or(rat_fault)"
over_records("verify_summary", f", {_OWN} SELECT kind, count(*) AS n FROM ({_EVERY} UNION ALL {_RAT}) GROUP BY kind", lambda r: ve.verify(r).groupBy("kind").agg(F.count("*").alias("n")))
_EXCLUDED = {"verify_target_uri": "target-uri", "verify_truncated": "truncated", "verify_refers_to_date": "refers-to-date"}
_REST = " UNION ALL ".join(f"SELECT record_id, kind FROM ({s})" for s in (*(s for n, (_, s) in _RULES.items() if n not in _EXCLUDED), _PAYLOADS, _GAPS, f"SELECT record_id, 'ReferencedRecordMissing' AS kind FROM ({_LOST})", _RAT))
over_records("verify_exclude_check", f", {_OWN} SELECT kind, count(*) AS n FROM ({_REST}) GROUP BY kind", lambda r: ve.verify(r, (*_EXCLUDED.values(), "block-digest")).groupBy("kind").agg(F.count("*").alias("n")))

# ---- messages

_CHUNKS = "(n_bytes + 4095) // 4096"
over_records("export_messages", f"SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'Metadata' AS kind, 1 AS n FROM rec UNION ALL SELECT 'Header', 1 FROM rec UNION ALL SELECT 'BlockChunk', {_CHUNKS} FROM rec UNION ALL SELECT 'BlockEnd', 1 FROM rec UNION ALL SELECT DISTINCT 'EndOfFile', 1 FROM rec UNION ALL SELECT 'EndOfFile', count(DISTINCT file) - 1 FROM rec) GROUP BY kind", lambda r: ms.to_messages(r).groupBy("kind").agg(F.count("*").alias("n")))
_JSON_FIELDS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '[' || to_json(CASE WHEN page_id % 2 = 1 THEN '{n.lower()}' ELSE '{n}' END)::VARCHAR || ',' || to_json({c})::VARCHAR || ']' END" for n, c in _COLUMNS.items())
_HEADER_MESSAGES = f"""
  SELECT page_id, 'Metadata' AS kind, '{{"Metadata":{{"file":' || to_json(file)::VARCHAR || ',"position":' || position || '}}}}' AS head FROM rec
  UNION ALL SELECT page_id, 'Header', '{{"Header":{{"version":"WARC/1.1","fields":[' || array_to_string(list_filter([{_JSON_FIELDS}], lambda x: x IS NOT NULL), ',') || ']}}}}' FROM rec"""
over_records("export_no_block", _HEADER_MESSAGES, lambda r: ms.to_json_text(ms.to_messages(r, no_block=True).where("kind <> 'EndOfFile'")).join(r.select("page_id", "file", "record_index"), ["file", "record_index"]).select("page_id", "kind", F.col("text").alias("head")))
over_records("export_extract_metadata", f"SELECT page_id, ({_KIND}) IS NOT NULL AS has_content, warc_truncated IS NOT NULL AS is_truncated FROM rec", lambda r: ms.to_messages(r, no_block=True, extract=True).where("kind = 'ExtractMetadata'").join(r.select("page_id", "file", "record_index"), ["file", "record_index"]).select("page_id", "ExtractMetadata.has_content", "ExtractMetadata.is_truncated"))
over_records("block_base64", "SELECT page_id, md5(to_base64(encode(html))) AS v FROM rec", lambda r: r.select("page_id", F.md5(F.translate(F.base64("block"), "\r\n", "")).alias("v")))
# ---- archives on disk: written from pages, read back


def _written(spark: SparkSession, d: str, compression: str) -> str:
    folder = new_folder(spark, "archive")
    write_archive(records(spark, d), folder, compression, "low")
    return folder


_BACK = f"WITH {_REC} SELECT coalesce(warc_record_id, '') AS record_id, coalesce(warc_target_uri, '') AS target_uri, n_bytes AS content_length, md5(html) AS block_md5, false AS rat_fault FROM rec"
for _codec in ("none", "gzip", "zstandard"):

    @query(f"warc_roundtrip_{_codec}", _BACK)
    def _round_trip(spark: SparkSession, d: str, codec=_codec) -> DataFrame:
        r = read_archive(spark, _written(spark, d, codec))
        return r.select(get("WARC-Record-ID").alias("record_id"), get("WARC-Target-URI").alias("target_uri"), "content_length", F.md5("block").alias("block_md5"), "rat_fault")


@query("warc_scan_without_blocks", f"WITH {_REC} SELECT coalesce(warc_type, '') AS warc_type, count(*) AS n, sum(n_bytes)::BIGINT AS bytes, 0::BIGINT AS blocks FROM rec GROUP BY 1")
def _no_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = read_archive(spark, _written(spark, d, "none"), includeBlock="false")
    return r.groupBy(get("WARC-Type").alias("warc_type")).agg(F.count("*").alias("n"), F.sum("content_length").alias("bytes"), F.count("block").alias("blocks"))


@query("multi_input_union", f"WITH {_REC} SELECT coalesce(warc_type, '') AS warc_type, count(*) AS n, sum(n_bytes)::BIGINT AS bytes FROM rec GROUP BY 1")
def _two_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Two folders, of different codecs, read together."""
    r, at = records(spark, d), [new_folder(spark, "input") for _ in range(2)]
    write_archive(r.where("file <= 'pages-1.warc'"), at[0], "gzip", "low")
    write_archive(r.where("file > 'pages-1.warc'"), at[1], "zstandard", "low")
    return read_archive(spark, *at).groupBy(get("WARC-Type").alias("warc_type")).agg(F.count("*").alias("n"), F.sum("content_length").alias("bytes"))


@query("warc_index_splits", f"WITH {_REC} SELECT coalesce(warc_record_id, '') AS record_id, md5(html) AS block_md5 FROM rec")
def _indexed(spark: SparkSession, d: str) -> DataFrame:
    folder = _written(spark, d, "gzip")
    index = new_folder(spark, "index")
    record_index(spark, folder).write.parquet(index)
    r = read_archive(spark, folder, index=index, recordsPerSplit=50)
    return r.select(get("WARC-Record-ID").alias("record_id"), F.md5("block").alias("block_md5"))


for _fmt in ("json-seq", "jsonl", "cbor-seq"):

    @query(f"import_export_{_fmt.replace('-', '_')}", f"WITH {_REC} SELECT coalesce(warc_record_id, '') AS record_id, md5(html) AS block_md5 FROM rec")
    def _sequence(spark: SparkSession, d: str, fmt=_fmt) -> DataFrame:
        out = new_folder(spark, "messages")
        ms.write_messages(ms.to_messages(records(spark, d)), out, fmt, single=True)
        return ms.read_messages(spark, out, fmt=fmt).select(get("WARC-Record-ID").alias("record_id"), F.md5("block").alias("block_md5"))


@query("http_decode_chunked_gzip", "SELECT page_id, 200 AS status_code, md5(html) AS body_md5, 'x-end' AS trailer FROM pages")
def _http(spark: SparkSession, d: str) -> DataFrame:
    """Pages as chunked, gzip-coded responses with a trailer, decoded again."""
    from ..functions.register import http_decode
    from ..sources import codecs

    @F.pandas_udf(BINARY)
    def pack(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            body = codecs.compress("gzip", h.encode(), "low")
            m = http1.Message.response(200, reason=b"OK", fields=[("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], body=body, trailers=[("x-end", "1")])
            out.append(http1.encode(m, chunked=True, chunk=777))
        return pd.Series(out, dtype=object)

    m = spark.read.parquet(f"{d}/pages.parquet").select("page_id", http_decode(pack("html")).alias("m"))
    return m.select("page_id", "m.status_code", F.md5("m.body").alias("body_md5"), F.col("m.trailers")[0]["name"].alias("trailer"))


@query("warc_stream_arrivals", f"WITH {_REC}, {_OWN} {_EVERY}")
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the files as they arrive, and references and segments over all of them. A member a record: no fault of compression."""
    from ..streaming.arrivals import open_problems, stream_records, verify_stream

    at = new_folder(spark, "arrivals")
    verify_stream(stream_records(spark, _written(spark, d, "gzip")), f"{at}/state", f"{at}/problems", f"{at}/checkpoint").awaitTermination()
    own = spark.read.parquet(f"{at}/problems").drop("batch")
    return own.unionByName(open_problems(spark, f"{at}/state")).select("record_id", "kind", "arg")
