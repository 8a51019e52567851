"""Message sequences: JSON text sequences, JSON lines and CBOR sequences, in plain Python."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator

from ..errors import ParseError

FORMATS = ("json-seq", "jsonl", "cbor-seq")


# ---- CBOR, as far as messages need it, and a little more


def cbor_encode(value) -> bytes:
    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _cbor_head(0, value) if value >= 0 else _cbor_head(1, -1 - value)
    if isinstance(value, bytes | bytearray | memoryview):
        return _cbor_head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        data = value.encode()
        return _cbor_head(3, len(data)) + data
    if isinstance(value, list | tuple):
        return _cbor_head(4, len(value)) + b"".join(map(cbor_encode, value))
    if isinstance(value, dict):
        return _cbor_head(5, len(value)) + b"".join(cbor_encode(k) + cbor_encode(v) for k, v in value.items())
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    raise TypeError(type(value))


def _cbor_head(major: int, n: int) -> bytes:
    for size, code in ((1, 24), (2, 25), (4, 26), (8, 27)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ParseError("Number", str(n))


def cbor_decode(data: bytes, at: int = 0):
    """(value, where the next begins)."""
    try:
        first = data[at]
        at += 1
        major, info = first >> 5, first & 31
        if info == 31:
            return _cbor_open(data, at, major)
        if info < 24:
            n = info
        elif info < 28:
            size = 1 << info - 24
            if at + size > len(data):
                raise IndexError
            n, raw = int.from_bytes(data[at : at + size], "big"), data[at : at + size]
            at += size
        else:
            raise ParseError("Sequence", "CBOR head")
        if major == 0:
            return n, at
        if major == 1:
            return -1 - n, at
        if major in (2, 3):
            if at + n > len(data):
                raise IndexError
            part = data[at : at + n]
            return (part if major == 2 else part.decode()), at + n
        if major == 4:
            out = []
            for _ in range(n):
                v, at = cbor_decode(data, at)
                out.append(v)
            return out, at
        if major == 5:
            pairs = {}
            for _ in range(n):
                k, at = cbor_decode(data, at)
                pairs[k], at = cbor_decode(data, at)
            return pairs, at
        if major == 6:
            return cbor_decode(data, at)
        if info < 24:
            return {20: False, 21: True}.get(info), at
        if info == 25:
            return struct.unpack(">e", raw)[0], at
        return (struct.unpack(">f" if info == 26 else ">d", raw)[0] if info > 24 else None), at
    except (IndexError, UnicodeDecodeError, TypeError) as e:
        raise ParseError("Sequence", "CBOR item is cut off or malformed") from e


def _cbor_open(data: bytes, at: int, major: int):
    """Items of open length, closed by a break."""
    parts = []
    while data[at] != 0xFF:
        v, at = cbor_decode(data, at)
        parts.append(v)
    at += 1
    if major in (2, 3):
        return (b"" if major == 2 else "").join(parts), at
    return (dict(zip(parts[::2], parts[1::2])) if major == 5 else parts), at


# ---- sequences


def write_item(value, fmt: str, pretty: bool = False) -> bytes:
    if fmt == "cbor-seq":
        return cbor_encode(value)
    if fmt == "json-seq":
        return b"\x1e" + json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")).encode() + b"\n"
    if fmt == "jsonl":
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
    raise ParseError("Sequence", f"format {fmt!r}")


def read_items(data: bytes, fmt: str) -> Iterator:
    try:
        if fmt == "cbor-seq":
            at = 0
            while at < len(data):
                v, at = cbor_decode(data, at)
                yield v
        elif fmt == "json-seq":
            for part in data.split(b"\x1e"):
                if part.strip():
                    yield json.loads(part)
        elif fmt == "jsonl":
            for line in data.split(b"\n"):
                if line.strip():
                    yield json.loads(line)
        elif fmt == "csv":
            raise ParseError("Sequence", "messages can't be read from CSV")
        else:
            raise ParseError("Sequence", f"format {fmt!r}")
    except ValueError as e:
        raise ParseError("Sequence", str(e)) from e


_MARKS = {"jsonl": b"\n", "json-seq": b"\x1e"}
_KIND = re.compile(rb'\s*\{\s*"(\w+)"\s*:')
_FIRST = re.compile(rb"\xa1(?:\x66Header|\x68(?:Metadata|BlockEnd)|\x69EndOfFile|\x6a(?:BlockChunk|ExtractEnd)|\x6cExtractChunk|\x6fExtractMetadata)")


def first_item(data: bytes, before: bytes, fmt: str, most: int) -> int | None:
    """Where the first item begins that begins among the first `most` bytes of data; before is the byte in front of data, empty
    at the head of a file. Of a CBOR sequence, which has no marks, a place that looks like it."""
    if not before:
        return 0 if most else None
    if fmt == "cbor-seq":
        m = _FIRST.search(data)
        at = m.start() if m else -1
    elif fmt == "jsonl":
        at = 0 if before == b"\n" else data.find(b"\n", 0, most - 1) + 1 or -1
    else:
        at = data.find(b"\x1e", 0, most)
    return at if 0 <= at < most else None


def stream_items(file, at: int, fmt: str, step: int = 1 << 20, most: int | None = None) -> Iterator[tuple[int, int, object]]:
    """(start, stop, item) of the items from an item's start on, read a step at a time: bytes for item_value, a value of CBOR.
    A CBOR item of more than `most` bytes is an error."""
    file.seek(at)
    if fmt == "cbor-seq":
        data, k, more = b"", 0, True
        while True:
            try:
                if k < len(data):
                    v, end = cbor_decode(data, k)
                    yield at + k, at + end, v
                    k = end
                    continue
            except ParseError as e:
                if not more or not isinstance(e.__cause__, IndexError) or (most and len(data) - k > most):
                    raise
            # what is cut off is tried again with as much again
            fresh = file.read(max(step, len(data) - k)) if more else b""
            more = bool(fresh)
            if not more and k >= len(data):
                return
            data, at, k = data[k:] + fresh, at + k, 0
    elif fmt in _MARKS:
        mark, held, start, lead = _MARKS[fmt], [], at, 0
        while block := file.read(step):
            parts = block.split(mark)
            for part in parts[:-1]:
                held.append(part)
                raw = b"".join(held)
                stop = start + lead + len(raw) + (fmt == "jsonl")
                yield start, stop, raw
                held, start, lead = [], stop, int(fmt == "json-seq")
            held.append(parts[-1])
        raw = b"".join(held)
        if raw or lead:
            yield start, start + lead + len(raw), raw
    else:
        raise ParseError("Sequence", "messages can't be read from CSV" if fmt == "csv" else f"format {fmt!r}")


def item_value(item, fmt: str):
    try:
        return item if fmt == "cbor-seq" else json.loads(item)
    except ValueError as e:
        raise ParseError("Sequence", str(e)) from e


def is_blank(item, fmt: str) -> bool:
    return fmt != "cbor-seq" and not item.strip()


def kind_of(item, fmt: str) -> str | None:
    """The kind of a JSON message by its head alone, None where that doesn't tell."""
    m = _KIND.match(item) if fmt != "cbor-seq" else None
    return m.group(1).decode() if m else None


def message_value(kind: str, body: dict, human: bool):
    """A message as its one-key object; bytes are base64 where people read it."""
    if "data" in body:
        body = {"data": base64.b64encode(body["data"]).decode() if human else body["data"]}
    return {kind: body}


def message_of(value) -> tuple[str, dict]:
    if not isinstance(value, dict) or len(value) != 1:
        raise ParseError("Sequence", "a message is an object of one key")
    ((kind, body),) = value.items()
    body = dict(body or {})
    if isinstance(body.get("data"), str):
        try:
            body["data"] = base64.b64decode(body["data"], validate=True)
        except ValueError as e:
            raise ParseError("Sequence", "base64") from e
    return kind, body
