"""The "warc" data source: scan with exact positions, index-driven splits and point lookup; and the writer.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("warc").load("dir-or-file-or-glob")

Options of the reader: compression (auto, none, gzip, zstandard), includeBlock (true), mode (FAILFAST, PERMISSIVE),
duplicateFields (last, all), file and position (point lookup), index (a Parquet table of file, position, record_index
and record_index order, as `record_index` builds) with recordsPerSplit, maxBlockBytes, batchBytes.
Options of the writer: compression, level (balanced, high, low), dictionary (a file).
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..errors import ArchiveError, ProtocolError
from ..model import RECORDS
from . import codecs
from .warcio import Header, Writer, read_records

_CODECS = {"none": "identity", "identity": "identity", "gzip": "gzip", "zstandard": "zstd", "zstd": "zstd"}
_ENDINGS = {"identity": ".warc", "gzip": ".warc.gz", "zstd": ".warc.zst"}


def codec_for(path: str, option: str = "auto") -> str:
    if option == "auto":
        return codecs.of_file(path)
    try:
        return _CODECS[option.lower()]
    except KeyError:
        raise ProtocolError("UnsupportedCompressionFormat", option) from None


def local(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")


def list_files(paths: list[str]) -> list[str]:
    """Archive files of the given files, folders and globs, in order, each once; hidden files are passed over."""
    out: dict[str, None] = {}
    for path in map(local, paths):
        if os.path.isdir(path):
            found = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith(("_", ".")) and f.lower().endswith(tuple(_ENDINGS.values())))
        else:
            found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
        out |= dict.fromkeys(found)
    return list(out)


@dataclass
class Split(InputPartition):
    file: str
    position: int = 0
    first_index: int = 0
    limit: int | None = None

    def __init__(self, file, position=0, first_index=0, limit=None):
        self.file, self.position, self.first_index, self.limit = file, position, first_index, limit


def embedded_dictionary(file) -> bytes | None:
    """The dictionary at the head of a zstd file, None if it has none; the file is left anywhere."""
    file.seek(0)
    head = file.read(4)
    if int.from_bytes(head, "little") != codecs.DICTIONARY_FRAME:
        return None
    file.seek(0)
    return codecs.read_dictionary(file)


def scan(split: Split, options: dict):
    """The records of a split as tuples of the RECORDS schema."""
    codec = codec_for(split.file, options.get("compression", "auto"))
    block = str(options.get("includeblock", "true")).lower() != "false"
    most = options.get("maxblockbytes")
    permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
    index = split.first_index or 0
    known = split.first_index is not None
    try:
        with open(split.file, "rb") as f:
            dictionary = None
            if options.get("dictionary"):
                with open(options["dictionary"], "rb") as d:
                    dictionary = d.read()
            if split.position:
                if codec == "zstd":
                    dictionary = embedded_dictionary(f) or dictionary
                f.seek(split.position)
            for r in read_records(f, codec, dictionary=dictionary, include_block=block, position=split.position, limit=split.limit, first_index=index, duplicates=options.get("duplicatefields", "last"), name=split.file, max_block=int(most) if most else None):
                index = r.index + 1
                yield split.file, r.position, r.index if known else None, r.header.version, r.header.fields, r.content_length, r.block, r.rat_fault, None
    except ArchiveError as e:
        if not permissive:
            raise
        yield split.file, e.position, index, None, None, None, None, None, (e.kind, e.position, e.snippet)


_ARROW = pa.schema([
    ("file", pa.string()), ("position", pa.int64()), ("record_index", pa.int64()), ("version", pa.string()),
    ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("content_length", pa.int64()),
    ("block", pa.binary()), ("rat_fault", pa.bool_()),
    ("_error", pa.struct([("kind", pa.string()), ("position", pa.int64()), ("snippet", pa.string())])),
])


def batches(rows, most_bytes: int = 16 << 20, most_rows: int = 4096):
    """Arrow batches that end by bytes or rows, whichever comes first: blocks may be megabytes each."""
    held, size = [], 0

    def flush():
        cols = list(zip(*held))
        cols[4] = [None if f is None else [{"name": k, "value": v} for k, v in f] for f in cols[4]]
        cols[8] = [None if e is None else dict(zip(("kind", "position", "snippet"), e)) for e in cols[8]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    for row in rows:
        held.append(row)
        size += 512 + len(row[6] or b"")
        if size >= most_bytes or len(held) >= most_rows:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.file, self.at = self.options.get("file"), self.options.get("position")

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        """Takes file = ... to read that file alone. A position needs the option: read from there on, a record's index isn't known."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = f.value
            yield f  # Spark filters again: a lookup narrows what is read, it doesn't decide

    def partitions(self):
        path = self.options.get("paths") or self.options.get("path")
        if not path:
            raise ProtocolError("NotFound", "no path given")
        paths = __import__("json").loads(path) if path.startswith("[") else path.split(",") if "," in path and not os.path.exists(local(path)) else [path]
        files = list_files(paths)
        if self.file is not None:
            files = [f for f in files if f == local(self.file)]
        if self.at is not None and len(files) == 1:
            return [Split(files[0], int(self.at), None, 1)]
        index = self.options.get("index")
        if index:
            return list(self._indexed(index, set(files)))
        return [Split(f) for f in files] or [Split("", limit=0)]

    def _indexed(self, index: str, files: set[str]):
        import pyarrow.dataset as ds

        n = int(self.options.get("recordspersplit", 1000))
        table = ds.dataset(local(index), format="parquet").to_table(columns=["file", "position", "record_index"])
        rows = sorted(zip(*(table[c].to_pylist() for c in ("file", "record_index", "position"))))
        k = 0
        while k < len(rows):
            file, first, position = rows[k]
            j = k
            while j < len(rows) and rows[j][0] == file and j - k < n:
                j += 1
            if file in files:
                yield Split(file, position, first, j - k)
            k = j

    def read(self, partition):
        if partition.limit == 0:
            return
        yield from batches(scan(partition, self.options), int(self.options.get("batchbytes", 16 << 20)))


class ArchiveStreamReader(DataSourceStreamReader):
    """Every new file is read once; the offset is the number of files seen, in order of arrival."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.seen: list[str] = []

    def initialOffset(self):  # noqa: N802
        return {"files": "[]"}

    def latestOffset(self):  # noqa: N802
        import json

        return {"files": json.dumps(list_files([self.options["path"]]))}

    def partitions(self, start, end):
        import json

        before = set(json.loads(start["files"]))
        return [Split(f) for f in json.loads(end["files"]) if f not in before] or [Split("", limit=0)]

    def read(self, partition):
        if partition.limit != 0:
            yield from batches(scan(partition, self.options))


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class ArchiveWriter(DataSourceWriter):
    """One file a task, written under a hidden name and renamed at the job's commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.options = {k.lower(): v for k, v in options.items()}
        self.overwrite = overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        folder, codec = local(self.options["path"]), codec_for("", self.options.get("compression", "none"))
        os.makedirs(folder, exist_ok=True)
        dictionary = None
        if self.options.get("dictionary"):
            with open(self.options["dictionary"], "rb") as d:
                dictionary = d.read()
        name = f"part-{TaskContext.get().partitionId():05d}{_ENDINGS[codec]}"
        hidden = f".{name}.{uuid.uuid4().hex}"
        w, f = None, None
        try:
            for row in iterator:
                if w is None:
                    f = open(os.path.join(folder, hidden), "wb")  # noqa: SIM115
                    w = Writer(f, codec, self.options.get("level", "high"), dictionary)
                fields = [(x["name"], x["value"]) for x in row["fields"]]
                w.write(Header(row["version"], fields), bytes(row["block"] or b""))
        finally:
            if f:
                f.close()
        return Written([(hidden, name)] if w else [])

    def commit(self, messages):
        folder = local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        if self.overwrite:
            for f in os.listdir(folder):
                if f.startswith("part-") and f.endswith(tuple(_ENDINGS.values())):
                    os.remove(os.path.join(folder, f))
        for m in messages:
            for hidden, name in m.files if m else ():
                target = os.path.join(folder, name)
                if os.path.exists(target):
                    stem, end = name.split(".", 1)
                    target = os.path.join(folder, f"{stem}-{uuid.uuid4().hex[:8]}.{end}")
                os.replace(os.path.join(folder, hidden), target)

    def abort(self, messages):
        folder = local(self.options["path"])
        for m in messages:
            for hidden, _ in m.files if m else ():
                if os.path.exists(os.path.join(folder, hidden)):
                    os.remove(os.path.join(folder, hidden))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite):
        return ArchiveWriter(dict(self.options), overwrite)

    def streamReader(self, schema):  # noqa: N802
        return ArchiveStreamReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes format("warc") known to the session and lets its reader see filters."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_archive(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """records of the files, folders and globs, all together."""
    import json

    register(spark)
    return spark.read.format("warc").options(**options).option("paths", json.dumps(list(paths))).load()


def record_index(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """(file, record_index, position, record_id): written as Parquet it lets later scans split files and seek."""
    from ..functions.fields import field_or_empty

    return read_archive(spark, *paths, includeBlock="false", **options).select("file", "record_index", "position", field_or_empty("fields", "WARC-Record-ID").alias("record_id"))


def write_archive(records: DataFrame, path: str, compression: str = "none", level: str = "high", mode: str = "overwrite", files: int | None = None, **options) -> None:
    """records (version, fields, block) to archive files, in order of file and record_index where those are there."""
    register(records.sparkSession)
    order = [c for c in ("file", "record_index") if c in records.columns]
    if files == 1:
        records = records.orderBy(*order).coalesce(1) if order else records.coalesce(1)
    elif order:
        records = records.repartitionByRange(files, *order) if files else records
        records = records.sortWithinPartitions(*order)
    records.select("version", "fields", F.col("block").cast("binary").alias("block")).write.format("warc").mode(mode).options(compression=compression, level=level, **options).save(path)
