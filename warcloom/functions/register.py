"""Makes the functions available to SQL text under their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArchiveError
from ..model import BINARY, FIELDS, INT, STRING, struct
from ..operators import http1
from ..operators.extract import extract_content
from ..sources.sequences import cbor_encode
from ..sources.warcio import Header, read_records
from . import digests, urls


@F.pandas_udf(struct(version=STRING, fields=FIELDS, error=STRING))
def parse_warc_header(data: pd.Series) -> pd.DataFrame:
    out = []
    for d in data:
        try:
            h = None if d is None else Header.parse(bytes(d))
            out.append((h and h.version, h and [{"name": k, "value": v} for k, v in h.fields], None))
        except ArchiveError as e:
            out.append((None, None, e.kind))
    return pd.DataFrame(out, columns=["version", "fields", "error"], dtype=object)


_HTTP = struct(kind=STRING, http_version=STRING, status_code=INT, reason=BINARY, method=STRING, target=STRING, fields=FIELDS, body=BINARY, trailers=FIELDS, error=STRING)


def _utf8(s: str) -> str:
    return s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _pairs(fields):
    return [{"name": _utf8(k), "value": _utf8(v)} for k, v in fields]


@F.pandas_udf(_HTTP)
def http_decode(data: pd.Series) -> pd.DataFrame:
    """The first message of the bytes; an error's kind where they can't be read."""
    out = []
    for d in data:
        row = dict.fromkeys(_HTTP.names)
        if d is not None:
            try:
                m, _ = http1.decode(bytes(d))
                row |= dict(kind=m.kind, http_version=m.http_version, status_code=m.status_code, reason=m.reason, method=m.method, target=m.target, fields=_pairs(m.fields), body=m.body, trailers=_pairs(m.trailers))
            except ArchiveError as e:
                row["error"] = e.kind
        out.append(row)
    df = pd.DataFrame(out, columns=_HTTP.names, dtype=object)
    return df.assign(status_code=df["status_code"].astype("Int32"))


@F.pandas_udf(BINARY)
def http_encode(messages: pd.DataFrame) -> pd.Series:
    """Bytes of struct(status_code, reason, method, target, fields, body)."""
    out = []
    for r in messages.to_dict("records"):
        fields = [(f["name"], f["value"]) for f in r["fields"] if f is not None]
        head = dict(fields=fields, body=bytes(r["body"] or b""))
        m = http1.Message.request(r["method"], r["target"], **head) if r["method"] is not None else http1.Message.response(int(r["status_code"]), reason=bytes(r["reason"] or b""), **head)
        out.append(http1.encode(m))
    return pd.Series(out, dtype=object)


@F.pandas_udf(BINARY)
def cbor_text(values: pd.Series) -> pd.Series:
    return pd.Series([cbor_encode(None if v is None else v) for v in values], dtype=object)


class ArchiveRecords:
    """UDTF: the records of an archive given as bytes and a codec's name, for files read as binaryFile."""

    def eval(self, data: bytes, codec: str):
        import io

        for r in read_records(io.BytesIO(bytes(data)), codec):
            yield r.position, r.index, r.header.version, [{"name": k, "value": v} for k, v in r.header.fields], r.content_length, r.block, r.rat_fault


_UDTF = T.StructType([T.StructField("position", T.LongType()), T.StructField("record_index", T.LongType()), T.StructField("version", STRING), T.StructField("fields", FIELDS), T.StructField("content_length", T.LongType()), T.StructField("block", BINARY), T.StructField("rat_fault", T.BooleanType())])


def register_functions(spark: SparkSession) -> None:
    plain = {
        "xxh3_64": digests.xxh3_64, "crc32c": digests.crc32c, "digest_parse": digests.digest_parse, "digest_format": digests.digest_format, "checksums": digests.checksums,
        "url_path_components": urls.url_path_components, "url_escape_component": urls.url_escape_component, "url_is_valid": urls.url_is_valid, "ip_is_valid": urls.ip_is_valid,
        "parse_warc_header": parse_warc_header, "http_decode": http_decode, "http_encode": http_encode, "extract_content": extract_content, "cbor_encode": cbor_text,
    }
    for name, f in plain.items():
        spark.udf.register(name, f)
    for algorithm in ("sha3-256", "sha3-512", "blake2s", "blake2b", "blake3"):
        spark.udf.register(algorithm.replace("-", "_"), digests._python(algorithm))
    spark.udtf.register("warc_records", F.udtf(ArchiveRecords, returnType=_UDTF))
