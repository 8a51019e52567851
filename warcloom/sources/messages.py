"""Records to messages and back: the exchange format of export and import."""

from __future__ import annotations

import os
import shutil
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveError, ParseError
from ..functions import hashes
from ..functions.digests import checksums
from ..model import BINARY, MESSAGE_KINDS, MESSAGES
from ..operators.extract import extract_content, path_components, with_content
from .archive import local
from .sequences import first_item, is_blank, item_value, kind_of, message_of, message_value, read_items, stream_items, write_item

#: Bytes in a message of block data.
CHUNK = 4096
#: Bytes of a message file that one task reads.
SPLIT = 16 << 20


def _message(kind: str, body: Column | None = None) -> Column:
    """A struct of all kinds with one of them set; equal types let the messages of a record be one array."""
    parts = [F.lit(kind).alias("kind")]
    for f in MESSAGES.fields[4:]:
        parts.append((body.cast(f.dataType) if f.name == kind and body is not None else F.lit(None).cast(f.dataType)).alias(f.name))
    return F.struct(*parts)


def _chunks(data: Column, kind: str, size: int) -> Column:
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: _message(kind, F.struct(F.substring(data, k * size + 1, F.lit(size)).alias("data"))))).otherwise(F.array().cast(_messages_type()))


def _messages_type():
    from ..model import STRING, array, struct

    return array(struct(kind=STRING, **{f.name: f.dataType for f in MESSAGES.fields[4:]}))


def to_messages(records: DataFrame, no_block: bool = False, extract: bool = False, chunk: int = CHUNK) -> DataFrame:
    """All messages of the records, one row each; order by file, record_index, seq. Each file ends with EndOfFile."""
    parts = [
        F.array(_message("Metadata", F.struct("file", "position")), _message("Header", F.struct("version", "fields"))),
    ]
    if extract:
        records = with_content(records).withColumn("_x", extract_content("content_kind", "block"))
        parts.append(F.array(_message("ExtractMetadata", F.struct(F.col("content_kind").isNotNull().alias("has_content"), path_components().alias("file_path_components"), "is_truncated"))))
    if not no_block:
        records = records.withColumn("_sums", checksums("block"))
        parts += [_chunks(F.col("block"), "BlockChunk", chunk), F.array(_message("BlockEnd", F.col("_sums")))]
    if extract:
        data = F.coalesce("_x.data", F.lit(b""))
        records = records.withColumn("_xsums", checksums(data))
        parts += [F.when(F.col("content_kind").isNotNull(), F.concat(_chunks(data, "ExtractChunk", chunk), F.array(_message("ExtractEnd", F.col("_xsums"))))).otherwise(F.array().cast(_messages_type()))]
    rows = records.select("file", "record_index", F.posexplode(F.concat(*parts)).alias("seq", "m")).select("file", "record_index", F.col("seq").cast("long").alias("seq"), "m.*")
    last = records.groupBy("file").agg((F.max("record_index") + 1).alias("record_index"))
    ends = last.select("file", "record_index", F.lit(0).cast("long").alias("seq"), _message("EndOfFile").alias("m")).select("file", "record_index", "seq", "m.*")
    return rows.unionByName(ends)


def _pairs(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.array(f["name"], f["value"]))


def to_json_text(messages: DataFrame) -> DataFrame:
    """Adds `text`: each message as its JSON object."""
    body = F.when(F.col("kind") == "Metadata", F.to_json(F.struct("Metadata")))
    body = body.when(F.col("kind") == "Header", F.to_json(F.struct(F.struct(F.col("Header.version"), _pairs(F.col("Header.fields")).alias("fields")).alias("Header"))))
    for k in ("BlockChunk", "ExtractChunk"):
        body = body.when(F.col("kind") == k, F.concat(F.lit(f'{{"{k}":{{"data":"'), F.translate(F.base64(F.col(f"{k}.data")), "\r\n", ""), F.lit('"}}')))
    for k in ("BlockEnd", "ExtractEnd"):
        body = body.when(F.col("kind") == k, F.to_json(F.struct(k), {"ignoreNullFields": "false"}))
    body = body.when(F.col("kind") == "ExtractMetadata", F.to_json(F.struct("ExtractMetadata")))
    return messages.withColumn("text", body.otherwise('{"EndOfFile":{}}'))


@F.pandas_udf(BINARY)
def _cbor(kinds: pd.Series, bodies: pd.DataFrame) -> pd.Series:
    out = []
    for kind, (_, row) in zip(kinds, bodies.iterrows()):
        body = row[kind] if kind != "EndOfFile" else {}
        body = dict(body or {})
        if kind == "Header":
            body["fields"] = [(f["name"], f["value"]) for f in body["fields"]]
        elif "xxh3" in body:
            body = {k: None if v is None else int(v) for k, v in body.items()}
        elif "file_path_components" in body:
            body["file_path_components"] = list(body["file_path_components"])
        out.append(write_item(message_value(kind, body, False), "cbor-seq"))
    return pd.Series(out, dtype=object)


def to_cbor(messages: DataFrame) -> DataFrame:
    """Adds `data`: each message as its CBOR item."""
    kinds = [k for k in MESSAGE_KINDS if k != "EndOfFile"]
    return messages.withColumn("data", _cbor("kind", F.struct(*kinds)))


def write_messages(messages: DataFrame, path: str, fmt: str = "json-seq", single: bool = False) -> None:
    """Messages in order as a folder of part files (one, if single)."""
    order = ["file", "record_index", "seq"]
    parts = messages.orderBy(*order)
    folder = local(path)
    if fmt == "cbor-seq":
        rows = to_cbor(parts).select("data")
        if single:
            _write_single(rows, folder, "part-00000.cbor")
            return

        def put(batches):
            from pyspark import TaskContext

            name = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.cbor")
            os.makedirs(folder, exist_ok=True)
            with open(f"{name}.tmp", "wb") as f:
                for pdf in batches:
                    for d in pdf["data"]:
                        f.write(d)
            os.replace(f"{name}.tmp", name)
            yield pd.DataFrame({"file": [name]})

        rows.mapInPandas(put, "file string").collect()
        return
    text = to_json_text(parts).select("text")
    if fmt == "json-seq":
        text = text.select(F.concat(F.lit("\x1e"), "text").alias("text"))
    if single and "://" not in folder:
        _write_single(text.select(F.concat("text", F.lit("\n")).cast("binary").alias("data")), folder, "part-00000.txt")
        return
    text = text.coalesce(1) if single else text
    text.write.mode("overwrite").text(path)


def _write_single(rows: DataFrame, folder: str, name: str) -> None:
    """The bytes of the rows, in order, as the one file of a folder. Each task writes a part, then copies it to its place in the file."""
    spark = rows.sparkSession
    hidden = os.path.join(os.path.dirname(os.path.abspath(folder)), f".{os.path.basename(os.path.abspath(folder))}.{uuid.uuid4().hex}")
    whole = os.path.join(hidden, name)

    def put(batches):
        from pyspark import TaskContext

        os.makedirs(hidden, exist_ok=True)
        own, size = f"{uuid.uuid4().hex}.part", 0
        with open(os.path.join(hidden, own), "wb") as f:
            for b in batches:
                for d in b.column(0):
                    size += f.write(d.as_buffer())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "own": [own], "size": [size]})

    try:
        os.makedirs(hidden, exist_ok=True)
        found = [r for r in sorted(rows.mapInArrow(put, "part long, own string, size long").collect()) if r["size"]]
        places, at = [], 0
        for r in found:
            places.append((r["own"], at))
            at += r["size"]
        with open(whole, "wb") as f:
            f.truncate(at)

        def place(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    own, start = places[k]
                    with open(os.path.join(hidden, own), "rb") as part, open(whole, "r+b") as f:
                        f.seek(start)
                        shutil.copyfileobj(part, f, 1 << 20)
                    yield pa.RecordBatch.from_pydict({"k": [k]})

        if places:
            spark.range(0, len(places), 1, len(places)).mapInArrow(place, "k long").collect()
        if os.path.isdir(folder):
            shutil.rmtree(folder)
        elif os.path.exists(folder):
            os.remove(folder)
        os.makedirs(folder)
        os.replace(whole, os.path.join(folder, name))
    finally:
        shutil.rmtree(hidden, ignore_errors=True)


def records_of(data: bytes, fmt: str, file: str, check: str = "all", strict: bool = False):
    """Records of one message file, by the order of its messages: header, chunks, end, and again.

    Every checksum that the end of a block carries must hold (check='first': only the first of crc32, crc32c, xxh3);
    an end without any is an error. Extract messages are passed over unless strict.
    """
    yield from _assembled(((0, v) for v in read_items(data, fmt)), file, check, strict, 0, file, 0)


def _assembled(items, file: str, check: str, strict: bool, index: int, name: str | None, position: int, end: int | None = None):
    """The records of (start, value) pairs, going on from a state between two records; those that begin before `end`."""
    header, chunks = None, None
    for start, value in items:
        if end is not None and start >= end and chunks is None:
            return
        kind, body = message_of(value)
        if kind.startswith("Extract") and not strict:
            continue
        if kind == "Metadata" and chunks is None:
            name, position = body.get("file", file), body.get("position", 0)
        elif kind == "Header" and chunks is None:
            header, chunks = body, []
        elif kind == "BlockChunk" and chunks is not None:
            chunks.append(bytes(body["data"]))
        elif kind == "BlockEnd" and chunks is not None:
            block = b"".join(chunks)
            sums = [(a, body[a]) for a in ("crc32", "crc32c", "xxh3") if body.get(a) is not None]
            if not sums:
                raise ParseError("Sequence", "a block without a checksum")
            for a, v in sums if check == "all" else sums[:1]:
                if {"crc32": zlib.crc32, "crc32c": hashes.crc32c, "xxh3": hashes.xxh3_64}[a](block) != int(v):
                    raise ParseError("ChecksumMismatch", a, file=file, position=position)
            yield name, position, index, header["version"], [{"name": k, "value": v} for k, v in header["fields"]], len(block), block
            index, header, chunks = index + 1, None, None
        elif kind == "EndOfFile" and chunks is None:
            position = 0
        else:
            raise ParseError("Sequence", f"{kind} isn't expected here")
    if chunks is not None:
        raise ParseError("UnexpectedEof", "messages end within a record")


# ---- message files in splits: what each holds is planned first, then every task has the state that its records begin in


def _opened(path: str):
    if "://" not in local(path):
        return open(local(path), "rb")  # noqa: SIM115
    import pyarrow.fs

    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


_PLAN = "path string, start long, end long, first long, stop long, own long, records long, enters boolean, leaves boolean, named boolean, name string, position long"


def _planned(f, path: str, fmt: str, strict: bool, start: int, end: int, first: int | None, most: int | None = None) -> dict:
    """What the items that begin in [first, end) hold: stop is the end of the last, own the first that isn't of a record of an
    earlier split (enters: there are such), leaves whether a record is open at the end (null: as it was), records how many begin.
    named, name and position tell of the last Metadata and EndOfFile."""
    out = dict.fromkeys((x.split(" ")[0] for x in _PLAN.split(", ")), None) | {"path": path, "start": start, "end": end, "first": first, "records": 0, "enters": False, "named": False}
    if first is None:
        return out
    closed = False
    for at, stop, item in stream_items(f, first, fmt, most=most):
        if at >= end:
            break
        out["stop"] = stop
        if is_blank(item, fmt):
            continue
        kind, body = kind_of(item, fmt), None
        if kind is None or kind == "Metadata":
            kind, body = message_of(item_value(item, fmt))
        if kind.startswith("Extract") and not strict:
            continue
        if out["own"] is None and not closed and kind in ("BlockChunk", "BlockEnd"):
            out["enters"] = True
            if kind == "BlockEnd":
                closed, out["leaves"] = True, False
            continue
        if out["own"] is None:
            out["own"], out["leaves"] = at, False
        if kind == "Metadata":
            out |= {"named": True, "name": body.get("file", path), "position": body.get("position", 0)}
        elif kind == "EndOfFile":
            out["position"] = 0
        elif kind == "Header":
            out["records"], out["leaves"] = out["records"] + 1, True
        elif kind == "BlockEnd":
            out["leaves"] = False
        if stop >= end:
            break
    return out


def _chained(plans: list[dict], fmt: str, strict: bool):
    """Of a file's plans, in order, the state in which each split's own records begin. Where a CBOR sequence was entered at a
    wrong place, its plan is made again from the right one."""
    at, opened, index, name, position = 0, False, 0, plans[0]["path"], 0
    for p in plans:
        if fmt == "cbor-seq":
            if at >= p["end"]:
                continue
            if p["first"] != at:
                with _opened(p["path"]) as f:
                    p = _planned(f, p["path"], fmt, strict, p["start"], p["end"], at)
            at = p["stop"]
        if p["enters"] and not opened:
            raise ParseError("Sequence", "BlockChunk isn't expected here", file=p["path"])
        if p["own"] is not None:
            yield {"path": p["path"], "own": p["own"], "end": p["end"], "index": index, "name": name, "position": position}
        opened = opened if p["leaves"] is None else p["leaves"]
        index += p["records"]
        name = p["name"] if p["named"] else name
        position = position if p["position"] is None else p["position"]


def read_messages(spark: SparkSession, *paths: str, fmt: str = "json-seq", check: str = "all", strict: bool = False, split: int = SPLIT) -> DataFrame:
    """records from message files. A file is read in splits, twice: for what the messages of each split leave to the next, then
    for the records. A record is the work of the split that its header begins in."""
    schema = "file string, position long, record_index long, version string, fields array<struct<name: string, value: string>>, content_length long, block binary"
    columns = ["file", "position", "record_index", "version", "fields", "content_length", "block"]
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length").where("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / F.lit(split))), 2 * F.ceil(F.sum("length") / F.lit(split))).first()
    tasks = max(1, min(int(n[0] or 0), int(n[1] or 0)))
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least("length", F.col("start") + F.lit(split)).alias("end")).repartition(tasks)
    planned, chained = _arrow_schema(_PLAN), _arrow_schema(_WORK)

    def plan(batches):
        for b in batches:
            for row in b.to_pylist():
                path, start, end = row["path"], row["start"], row["end"]
                with _opened(path) as f:
                    before = b""
                    if start:
                        f.seek(start - 1)
                        before = f.read(1)
                    first = first_item(f.read(end - start + 16) if start else b"", before, fmt, end - start)
                    first = None if first is None else start + first
                    try:
                        out = _planned(f, path, fmt, strict, start, end, first, 4 * split if start else None)
                    except (ArchiveError, RecursionError, TypeError, ValueError) as e:
                        if fmt != "cbor-seq":
                            if isinstance(e, ArchiveError):
                                e.file = e.file or path
                            raise
                        out = _planned(f, path, fmt, strict, start, end, None)  # the guess was wrong, or the file is; that turns out from the right place
                yield pa.RecordBatch.from_pylist([out], schema=planned)

    def chain(table):
        plans = sorted(table.to_pylist(), key=lambda p: p["start"])
        return pa.Table.from_pylist(list(_chained(plans, fmt, strict)), schema=chained)

    def load(batches):
        for b in batches:
            for row in b.to_pylist():
                file, held, size = row["path"], [], 0
                with _opened(file) as f:
                    items = ((at, item_value(x, fmt)) for at, _, x in stream_items(f, row["own"], fmt) if not is_blank(x, fmt))
                    try:
                        for r in _assembled(items, file, check, strict, row["index"], row["name"], row["position"], row["end"]):
                            held.append(r)
                            size += len(r[6])
                            if size > 16 << 20:
                                yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=columns), schema=records, preserve_index=False)
                                held, size = [], 0
                    except ArchiveError as e:
                        e.file = e.file or file
                        raise
                if held:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=columns), schema=records, preserve_index=False)

    records = _arrow_schema(schema)
    return splits.mapInArrow(plan, _PLAN).groupBy("path").applyInArrow(chain, _WORK).repartition(tasks).mapInArrow(load, schema)


_WORK = "path string, own long, end long, index long, name string, position long"


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
