"""What a record holds: classification by native expressions, decoding by one Arrow UDF, and files on disk."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArchiveError, ProtocolError
from ..functions import hashes
from ..functions.fields import field_or_empty, get_field, has_field, is_media_type, unbracketed
from ..functions.urls import MARK, url_path_components
from ..model import BINARY, STRING, struct
from . import http1


def with_content(records: DataFrame) -> DataFrame:
    """Adds content_kind ('http', 'plain' or null), content_error, is_truncated and target_uri.

    Comparisons are case-sensitive. A segmented record can't be extracted; a malformed media type of a response is a
    parse error.
    """
    typ, url = field_or_empty("fields", "WARC-Type"), unbracketed(field_or_empty("fields", "WARC-Target-URI"))
    content = get_field("fields", "Content-Type")
    # read from the text rather than from media_type's map: its nested lambdas keep Spark from handing the result to Python
    wellformed = is_media_type(content)
    essence = F.regexp_extract(content, r"^[^; \t]*", 0)
    msgtype = F.regexp_extract(content, r"^.*;[ \t]*msgtype=([^; \t]*)", 1)
    segmented = has_field("fields", "WARC-Segment-Number")
    response = typ == "response"
    http = response & wellformed & (essence == "application/http") & (msgtype == "response") & (url != "")
    kind = F.when(segmented, F.lit(None).cast("string")).when(http, "http").when(typ.isin("resource", "conversion") & (url != ""), "plain")
    error = F.when(segmented, "UnsupportedSegmentedRecord").when(content.isNotNull() & ~wellformed, "Syntax")
    kind = F.when(error.isNull(), kind)
    return records.withColumns({"content_kind": kind, "content_error": error, "is_truncated": has_field("fields", "WARC-Truncated"), "target_uri": url})


@F.pandas_udf(struct(data=BINARY, error=STRING))
def extract_content(kinds: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    """The payload after transfer and content decoding; null where the record holds none."""
    out = []
    for kind, block in zip(kinds, blocks):
        if kind is None or block is None:
            out.append((None, None))
        elif kind == "plain":
            out.append((bytes(block), None))
        else:
            try:
                out.append((http1.decode(bytes(block))[0].body, None))
            except ArchiveError as e:
                out.append((None, e.kind))
    return pd.DataFrame(out, columns=["data", "error"], dtype=object)



def path_components(target: str | Column = "target_uri", typ: Column | None = None, content_kind: str | Column = "content_kind") -> Column:
    """Safe path of a record's content, a conversion marked at its end; empty where there is no content."""
    typ = field_or_empty("fields", "WARC-Type") if typ is None else typ
    kind = F.col(content_kind) if isinstance(content_kind, str) else content_kind
    parts = url_path_components(target)
    marked = F.when(typ == "conversion", F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), F.lit(MARK + "conversion"))))).otherwise(parts)
    return F.when(kind.isNotNull(), marked).otherwise(F.array().cast("array<string>"))


_EXTRACTED = "file string, record_index long, record_id string, components array<string>, is_truncated boolean, data binary, hash string, error string"


def _extract(continue_on_error: bool):
    def run(batches):
        for pdf in batches:
            data, marks, errors = [], [], []
            for kind, block, error, rid in zip(pdf["content_kind"], pdf["block"], pdf["content_error"], pdf["record_id"]):
                out = None
                if error is None:
                    try:
                        out = http1.decode(bytes(block))[0].body if kind == "http" else bytes(block)
                    except ArchiveError as e:
                        error = e.kind
                if error is not None and not continue_on_error:
                    raise ProtocolError(error, record_id=rid)
                data.append(out)
                marks.append(None if out is None else f"{hashes.xxh3_64(out):016x}")
                errors.append(error)
            yield pdf[["file", "record_index", "record_id", "components", "is_truncated"]].assign(data=data, hash=marks, error=errors)

    return run


def extracted(records: DataFrame, continue_on_error: bool = False) -> DataFrame:
    """file, record_index, record_id, components, is_truncated, data, hash (of the data, for names), error of the records
    that hold content or fail to. Without continue_on_error the first failure ends the job."""
    c = with_content(records).where("content_kind IS NOT NULL OR content_error IS NOT NULL")
    c = c.select("file", "record_index", field_or_empty("fields", "WARC-Record-ID").alias("record_id"), path_components().alias("components"), "is_truncated", "content_kind", "content_error", "block")
    return c.mapInPandas(_extract(continue_on_error), _EXTRACTED)


def plan_paths(items: DataFrame, existing: list[tuple[str, bool]] = ()) -> DataFrame:
    """Adds `path` to (file, record_index, components, is_truncated, hash): the name each content gets, as if they were
    written one after the other in order of file and record_index.

    The first of a name keeps it; a later one gets its content's hash, and if that is there too it has the same content
    and gets a null path. A folder in the way of a file, or a file in the way of a folder, moves the later one. The
    decision is sequential within one site, so sites are decided in parallel, on names and hashes alone.
    """
    old = list(existing)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        files = {p for p, folder in old if not folder}
        folders = {p for p, folder in old if folder}
        paths = []
        for parts, cut_off, mark in zip(pdf["components"], pdf["is_truncated"], pdf["hash"]):
            here: list[str] = []
            for part in parts[:-1]:
                name = part
                while "/".join([*here, name]) in files:
                    name += MARK + "d"
                here.append(name)
                folders.add("/".join(here))
            name = (parts[-1] if len(parts) else "_") + (MARK + "truncated" if cut_off else "")
            path = "/".join([*here, name])
            if path in files or path in folders:
                path = path + MARK + mark
            paths.append(None if path in files else path)
            files.add(path)
        return pdf.assign(path=paths)[["file", "record_index", "path"]]

    site = F.concat_ws("/", F.slice("components", 1, 2))
    keys = items.select("file", "record_index", "components", "is_truncated", "hash", site.alias("site"))
    chosen = keys.groupBy("site").applyInPandas(lambda pdf: decide(pdf.sort_values(["file", "record_index"])), "file string, record_index long, path string")
    return items.join(chosen, ["file", "record_index"])


def write_tree(records: DataFrame, folder: str, continue_on_error: bool = False) -> DataFrame:
    """Writes the contents below a folder that must exist; returns (file, record_index, record_id, path, error).

    A file appears whole or not at all (temporary name, then rename), so a task that runs twice leaves the same tree.
    """
    if not os.path.isdir(folder):
        raise ProtocolError("NotFound", f"the folder {folder} doesn't exist")
    old = [(os.path.relpath(os.path.join(d, x), folder), is_dir) for d, ds, fs in os.walk(folder) for x, is_dir in [*((y, True) for y in ds), *((y, False) for y in fs)]]
    found = extracted(records, continue_on_error)
    planned = plan_paths(found.where("data IS NOT NULL"), old)

    def put(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["data"]):
                if path is None:
                    continue
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temp = f"{target}.{os.getpid()}.tmp"
                with open(temp, "wb") as f:
                    f.write(data)
                os.replace(temp, target)
            yield pdf[["file", "record_index", "record_id", "path", "error"]]

    schema = "file string, record_index long, record_id string, path string, error string"
    done = planned.select("file", "record_index", "record_id", "path", "error", "data").mapInPandas(put, schema)
    return done.unionByName(found.where("data IS NULL").select("file", "record_index", "record_id", F.lit(None).cast("string").alias("path"), "error"))
