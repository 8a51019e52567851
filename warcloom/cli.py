"""Command line: python -m warcloom.cli list|get|export|import|extract|verify ..."""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
import tempfile

from .errors import ArchiveError
from .operators import verify as ve
from .plans import verbs

PROBLEMS_FOUND = 8


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("warcloom").getOrCreate()


def _inputs(paths, compression: str, scratch: str) -> list[str]:
    """Files as given; standard input is spooled, its codec told by its first bytes."""
    out = []
    for p in paths:
        if p == "-":
            from .sources import codecs

            data = sys.stdin.buffer.read()
            codec = codecs.sniff(data[:8]) if compression == "auto" else compression
            p = os.path.join(scratch, "stdin" + {"identity": ".warc", "none": ".warc", "gzip": ".warc.gz", "zstd": ".warc.zst", "zstandard": ".warc.zst"}[codec])
            with open(p, "wb") as f:
                f.write(data)
        out.append(p)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="warcloom")
    p.add_argument("--log-level", default="warning")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, where=None, out: bool = True, fmt=("json-seq", "jsonl", "cbor-seq")):
        q = (where or sub).add_parser(name)
        q.add_argument("--input", action="append", default=None)
        q.add_argument("--compression", default="auto")
        if out:
            q.add_argument("--output", default="-")
        if fmt:
            q.add_argument("--format", default=fmt[0], choices=fmt)
        return q

    q = verb("list", fmt=("json-seq", "jsonl", "csv"))
    q.add_argument("--field", default=",".join(verbs.DEFAULT_FIELDS))
    q = verb("export")
    q.add_argument("--no-block", action="store_true")
    q.add_argument("--extract", action="store_true")
    q = verb("import")
    q.add_argument("--compression-level", default="high", choices=("balanced", "high", "low"))
    g = sub.add_parser("get").add_subparsers(dest="what", required=True)
    for name in ("export", "extract"):
        q = verb(name, g, fmt=("json-seq", "jsonl", "cbor-seq") if name == "export" else None)
        q.add_argument("--position", type=int, required=True)
        q.add_argument("--id")
        if name == "export":
            q.add_argument("--no-block", action="store_true")
            q.add_argument("--extract", action="store_true")
    q = verb("extract", fmt=None)
    for rule in ("include", "include-pattern", "exclude", "exclude-pattern"):
        q.add_argument(f"--{rule}", action="append", default=[])
    q.add_argument("--continue-on-error", action="store_true")
    q = verb("verify", fmt=("json-seq", "jsonl", "csv"))
    q.add_argument("--exclude-check", default="")
    q.add_argument("--database")
    return p


def _emit(lines, output: str) -> None:
    if output == "-":
        for x in lines:
            sys.stdout.buffer.write(x)
        sys.stdout.flush()
    else:
        with open(output, "wb") as f:
            for x in lines:
                f.write(x)


def _text(rows, fmt: str):
    mark, end = (b"\x1e", b"\n") if fmt == "json-seq" else (b"", b"\n")
    for r in rows:
        yield mark + r[0].encode() + end


def _csv(rows):
    import csv
    import io

    for r in rows:
        s = io.StringIO()
        csv.writer(s, lineterminator="\n").writerow(r)
        yield s.getvalue().encode()


def _messages(messages, fmt: str):
    from .sources import messages as ms

    ordered = messages.orderBy("file", "record_index", "seq")
    if fmt == "cbor-seq":
        return (bytes(r[0]) for r in ms.to_cbor(ordered).select("data").toLocalIterator())
    return _text(ms.to_json_text(ordered).select("text").toLocalIterator(), fmt)


def main(argv=None) -> int:
    from pyspark.sql import functions as F

    from .sources import messages as ms
    from .sources.archive import read_archive, write_archive

    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level.upper())
    scratch = tempfile.mkdtemp(prefix="warcloom-")
    try:
        spark = _session()
        options = {"compression": a.compression}
        if a.verb == "import":
            records = ms.read_messages(spark, *(a.input or ["-"]), fmt=a.format)
            folder = os.path.join(scratch, "out")
            codec = a.compression if a.compression != "auto" else {"gzip": "gzip", "zstd": "zstandard", "identity": "none"}[__import__("warcloom.sources.codecs", fromlist=["of_file"]).of_file(a.output)]
            write_archive(records, folder, codec, a.compression_level, files=1)
            parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
            _emit((open(os.path.join(folder, f), "rb").read() for f in parts), a.output)  # noqa: SIM115
            return 0
        inputs = _inputs(a.input or ["-"], a.compression, scratch)
        if "-" in (a.input or ["-"]):
            options["compression"] = "auto"
        if a.verb == "list":
            records = read_archive(spark, *inputs, includeBlock="false", **options).orderBy("file", "record_index")
            fields = [x.strip() for x in a.field.split(",")]
            if a.format == "csv":
                _emit(_csv(verbs.list_records(records, fields, [f"c{k}" for k in range(len(fields))]).toLocalIterator()), a.output)
            else:
                _emit(_text(verbs.list_as_json(records, fields).orderBy("file", "record_index").select("text").toLocalIterator(), a.format), a.output)
        elif a.verb == "export":
            _emit(_messages(ms.to_messages(read_archive(spark, *inputs, **options), a.no_block, a.extract), a.format), a.output)
        elif a.verb == "get":
            record = verbs.found(verbs.get_record(spark, inputs[0], a.position, a.id, **options))
            if a.what == "extract":
                _emit([verbs.get_content(record)], a.output)
            else:
                _emit(_messages(ms.to_messages(record.withColumn("record_index", F.lit(0).cast("long")), a.no_block, a.extract), a.format), a.output)
        elif a.verb == "extract":
            done = verbs.extract_archive(spark, inputs, a.output if a.output != "-" else ".", a.include, a.exclude, a.include_pattern, a.exclude_pattern, a.continue_on_error, **options)
            logging.info("extracted %d", done.count())
        elif a.verb == "verify":
            problems = verbs.verify_archive(spark, inputs, [x for x in a.exclude_check.split(",") if x], a.database, **options).persist()
            rows = ve.in_order(problems)
            if a.format == "csv":
                _emit(_csv(rows.select("record_id", "kind", "arg", "algorithm", "expected", "actual").toLocalIterator()), a.output)
            else:
                _emit(_text(rows.select(ve.to_json_text(rows)).toLocalIterator(), a.format), a.output)
            return PROBLEMS_FOUND if problems.count() else 0
        return 0
    except ArchiveError as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    sys.exit(main())
