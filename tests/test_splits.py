"""Message files read in splits, at every place where a split may begin, and written by many tasks."""

import os
import random
import zlib

import pytest

from warcloom.errors import ArchiveError, ParseError
from warcloom.sources import messages as ms
from warcloom.sources import sequences as sq


def in_splits(path, fmt: str, split: int) -> list:
    """What the tasks of read_messages do, one after the other."""
    plans, out, size = [], [], os.path.getsize(path)
    with open(path, "rb") as f:
        for start in range(0, size, split):
            end = min(size, start + split)
            f.seek(max(0, start - 1))
            before = f.read(1) if start else b""
            first = sq.first_item(f.read(end - start + 16) if start else b"", before, fmt, end - start)
            try:
                plans.append(ms._planned(f, path, fmt, False, start, end, None if first is None else start + first, 4 * split if start else None))
            except (ArchiveError, TypeError, ValueError):
                assert fmt == "cbor-seq"
                plans.append(ms._planned(f, path, fmt, False, start, end, None))
        for w in ms._chained(plans, fmt, False) if plans else ():
            items = ((at, sq.item_value(x, fmt)) for at, _, x in sq.stream_items(f, w["own"], fmt, step=64) if not sq.is_blank(x, fmt))
            out += ms._assembled(items, path, "all", False, w["index"], w["name"], w["position"], w["end"])
    return out


def sequence(fmt: str, records: int = 12) -> bytes:
    """Records of no chunk to many, some of whose bytes look like messages themselves."""
    rnd, out = random.Random(3), b""
    for k in range(records):
        block = rnd.randbytes(rnd.choice([0, 1, 60, 300])) + (b"", sq.cbor_encode({"BlockEnd": {"crc32": 1}}) * 3, b"\xa1\x66Header\xa2", b'\n\x1e{"Header":{}}\n')[k % 4]
        messages = [("Metadata", {"file": f"f{k // 3}", "position": 7 * k})] if k % 3 else []
        messages += [("Header", {"version": "WARC/1.1", "fields": [["n", f"{k}\n\x1e"]]})]
        messages += [("BlockChunk", {"data": block[j : j + 50]}) for j in range(0, len(block), 50)]
        messages += [("BlockEnd", {"crc32": zlib.crc32(block)}), ("ExtractEnd", {}), *([("EndOfFile", {})] if k % 5 == 4 else [])]
        out += b"".join(sq.write_item(sq.message_value(kind, body, fmt != "cbor-seq"), fmt) for kind, body in messages)
    return out


def splits_agree(tmp_path, fmt: str) -> None:
    path, data = str(tmp_path / "m"), sequence(fmt)
    want = list(ms.records_of(data, fmt, path))
    assert len(want) == 12
    with open(path, "wb") as f:
        f.write(data)
    for split in (1, 7, 50, 333, 1000, 1 << 20):
        assert in_splits(path, fmt, split) == want
    # cut off, or begun within a record: an error, wherever splits begin
    for broken in (data[: len(data) - 40], data[data.index(b"BlockChunk") - {"jsonl": 2, "json-seq": 3, "cbor-seq": 2}[fmt] :]):
        with open(path, "wb") as f:
            f.write(broken)
        for split in (50, 1000, 1 << 20):
            with pytest.raises(ParseError):
                in_splits(path, fmt, split)


def by_many_tasks(spark, tmp_path, fmt: str) -> None:
    rows = spark.range(0, 400, 1, 8).selectExpr("concat('f', id div 300) AS file", "7 * id AS position", "id % 300 AS record_index", "'WARC/1.1' AS version", "array(struct('n' AS name, cast(id AS string) AS value)) AS fields", "cast(repeat(sha2(cast(id AS string), 512), 60) AS binary) AS block")
    out = str(tmp_path / "out")
    ms.write_messages(ms.to_messages(rows), out, fmt, single=True)
    (name,) = os.listdir(out)
    with open(f"{out}/{name}", "rb") as f:
        want = sorted((r[0], r[1], r[2], r[6]) for r in ms.records_of(f.read(), fmt, name))
    assert [r[3] for r in want] == [bytes(r.block) for r in rows.orderBy("file", "record_index").collect()]
    from pyspark.sql import functions as F

    back = ms.read_messages(spark, out, fmt=fmt, split=1 << 19).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in back}) > 2
    assert sorted((r.file, r.position, r.record_index, bytes(r.block)) for r in back) == want


def test_jsonl_in_splits(spark, tmp_path):
    splits_agree(tmp_path, "jsonl")
    by_many_tasks(spark, tmp_path, "jsonl")


def test_json_seq_in_splits(spark, tmp_path):
    splits_agree(tmp_path, "json-seq")
    by_many_tasks(spark, tmp_path, "json-seq")


def test_cbor_seq_in_splits(spark, tmp_path):
    splits_agree(tmp_path, "cbor-seq")
    by_many_tasks(spark, tmp_path, "cbor-seq")
