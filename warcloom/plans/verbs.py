"""The archive verbs as DataFrame pipelines: list, get, export, import, extract, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ProtocolError
from ..functions.fields import field_filter, field_or_empty
from ..operators import extract as ex
from ..operators import verify as ve
from ..sources import messages as ms
from ..sources.archive import read_archive, write_archive

DEFAULT_FIELDS = (":position", "WARC-Record-ID", "WARC-Type", "Content-Type", "WARC-Target-URI")


def listed(name: str) -> Column:
    """A requested field: :position, :file, or a header's first value, empty where missing."""
    if name == ":position":
        return F.col("position")
    if name == ":file":
        return F.col("file")
    return field_or_empty("fields", name)


def list_records(records: DataFrame, fields=DEFAULT_FIELDS, names=None) -> DataFrame:
    """One column for each requested field, in order; names default to the fields'."""
    names = names or fields
    return records.select(*[listed(f).alias(n) for f, n in zip(fields, names)])


def list_as_json(records: DataFrame, fields=DEFAULT_FIELDS) -> DataFrame:
    """`text`: each record's values as a JSON array."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return records.select("file", "record_index", F.concat(F.lit("["), F.concat_ws(",", *[quote(listed(f)) for f in fields]), F.lit("]")).alias("text"))


def get_record(spark: SparkSession, path: str, position: int, record_id: str | None = None, **options) -> DataFrame:
    """The record at a position; with an id, only if it has that id."""
    out = read_archive(spark, path, position=position, mode="FAILFAST", **options)
    return out if record_id is None else out.where(field_or_empty("fields", "WARC-Record-ID") == record_id)


def found(records: DataFrame) -> DataFrame:
    if records.isEmpty():
        raise ProtocolError("NotFound")
    return records


def get_content(records: DataFrame) -> bytes:
    """The decoded content of one record."""
    row = ex.extracted(found(records)).select("data").first()
    if row is None or row[0] is None:
        raise ProtocolError("NoContent")
    return bytes(row[0])


def export_archive(spark: SparkSession, inputs, output: str, fmt: str = "json-seq", no_block: bool = False, extract: bool = False, single: bool = False, **options) -> None:
    records = read_archive(spark, *inputs, **options)
    ms.write_messages(ms.to_messages(records, no_block, extract), output, fmt, single)


def import_archive(spark: SparkSession, inputs, output: str, fmt: str = "json-seq", compression: str = "none", level: str = "high", files: int | None = None) -> None:
    write_archive(ms.read_messages(spark, *inputs, fmt=fmt), output, compression, level, files=files)


def extract_archive(spark: SparkSession, inputs, folder: str, include=(), exclude=(), include_pattern=(), exclude_pattern=(), continue_on_error: bool = False, **options) -> DataFrame:
    records = read_archive(spark, *inputs, **options).where(field_filter("fields", include, exclude, include_pattern, exclude_pattern))
    return ex.write_tree(records, folder, continue_on_error)


def verify_archive(spark: SparkSession, inputs, exclude=(), state_path: str | None = None, **options) -> DataFrame:
    return ve.verify(read_archive(spark, *inputs, **options), exclude, state_path)
