"""Reading and writing web-archive records in plain Python: what runs inside a data-source task."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from ..errors import ArchiveError, ParseError, ProtocolError
from . import codecs

MAX_HEADER = 32_768
CHUNK = 1 << 20

TCHAR = rb"[0-9A-Za-z!#$%&'*+\-.^_`|~]"
_DELIMITER = re.compile(rb"(?:[^\r\n]+\r?\n)*\r?\n")
_VERSION = re.compile(rb"(WARC/[0-9.]*)\r?\n")
_FIELD = re.compile(rb"(" + TCHAR + rb"+):[ \t]*((?:[!-~\x80-\xff][!-~\x80-\xff \t]*|\r?\n[ \t]+)*)[ \t]*\r?\n")
_FOLD = re.compile(rb"\r?\n[ \t]+")
_NAME = re.compile(TCHAR + rb"+\Z")
_VALUE = re.compile(rb"(?:[!-~\x80-\xff][!-~\x80-\xff \t]*)?\Z")
_FOLDED_VALUE = re.compile(rb"(?:[!-~\x80-\xff][!-~\x80-\xff \t]*|\r?\n[ \t]+)*\Z")

Fields = list[tuple[str, str]]


def header_end(data: bytes) -> int | None:
    """Where a header section with its blank line ends, or None if it hasn't yet."""
    m = _DELIMITER.match(data)
    return m.end() if m else None


def field_pairs(data: bytes) -> list[tuple[bytes, bytes]]:
    """Name and value of each line, up to the first that isn't a field. Blanks before a value go, those after it stay."""
    out, at = [], 0
    while m := _FIELD.match(data, at):
        out.append((m.group(1), m.group(2)))
        at = m.end()
    return out


def remove_line_folding(value: bytes) -> bytes:
    return _FOLD.sub(b" ", value)


# ---- the ordered multimap of fields, names compared without regard to ASCII case


def _low(name: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def get(fields: Fields, name: str) -> str | None:
    n = _low(name)
    return next((v for k, v in fields if _low(k) == n), None)


def get_all(fields: Fields, name: str) -> list[str]:
    n = _low(name)
    return [v for k, v in fields if _low(k) == n]


def contains(fields: Fields, name: str) -> bool:
    return get(fields, name) is not None


def remove(fields: Fields, name: str) -> Fields:
    n = _low(name)
    return [(k, v) for k, v in fields if _low(k) != n]


def insert(fields: Fields, name: str, value: str) -> Fields:
    """Replaces all values of the name by one, at the end."""
    return [*remove(fields, name), (name, value)]


def parse_u64(text: str) -> int:
    """ASCII digits only, below 2^64."""
    if not text or not text.isascii() or not text.isdigit() or int(text) >= 1 << 64:
        raise ParseError("Number", text[:40])
    return int(text)


@dataclass
class Header:
    version: str = "WARC/1.1"
    fields: Fields = field(default_factory=list)

    @classmethod
    def new(cls, content_length: int, warc_type: str) -> Header:
        """A header with the four mandatory fields: a fresh id (time-ordered) and the present time."""
        now = datetime.now(UTC)
        ms, rand = int(now.timestamp() * 1000), uuid.uuid4().int
        u = uuid.UUID(int=(ms & (1 << 48) - 1) << 80 | 7 << 76 | (rand >> 66 & 0xFFF) << 64 | 2 << 62 | rand & (1 << 62) - 1)
        return cls(fields=[("WARC-Record-ID", f"<urn:uuid:{u}>"), ("WARC-Type", warc_type), ("WARC-Date", now.strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Length", str(content_length))])

    @classmethod
    def parse(cls, data: bytes, duplicates: str = "last") -> Header:
        """duplicates: 'last' keeps one value of a repeated name, the last, in its place; 'all' keeps all."""
        m = _VERSION.match(data)
        if not m:
            raise ParseError("Syntax", "version line", snippet=data)
        out = cls(m.group(1).decode(), [])
        for name, value in field_pairs(data[m.end() :]):
            try:
                n, v = name.decode(), remove_line_folding(value).decode()
            except UnicodeDecodeError:
                raise ParseError("InvalidUtf8", name.decode("latin-1")) from None
            out.fields = insert(out.fields, n, v) if duplicates == "last" else [*out.fields, (n, v)]
        return out

    def content_length(self) -> int:
        try:
            return parse_u64(get(self.fields, "Content-Length") or "")
        except ParseError:
            raise ProtocolError("InvalidContentLength") from None

    def validate(self) -> None:
        if not re.match(r"WARC/[0-9.]*", self.version):
            raise ParseError("Syntax", "version")
        for name, value in self.fields:
            validate_field_name(name.encode())
            validate_field_value(value.encode())

    def serialize(self) -> bytes:
        return (self.version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.fields) + "\r\n").encode()


def validate_field_name(name: bytes) -> None:
    if not _NAME.match(name):
        raise ParseError("Syntax", "field name", snippet=name)


def validate_field_value(value: bytes, folding: bool = False) -> None:
    if not (_FOLDED_VALUE if folding else _VALUE).match(value):
        raise ParseError("Syntax", "field value", snippet=value)


# ---- decoding


class Members:
    """Decoded bytes of a file of one or more members, with where each member begins in raw and in decoded bytes."""

    def __init__(self, file, codec: str, dictionary: bytes | None = None, position: int = 0):
        self.file, self.codec, self.dictionary = file, codecs.codec_name(codec), dictionary
        self.raw = position  # offset in the file of what is in `pending`
        self.decoded = 0 if self.codec != "identity" else position
        self.starts: list[tuple[int, int]] = []  # (decoded offset, raw offset)
        self.pending, self.d, self.over = b"", None, False
        self.head = True  # nothing but a dictionary has come yet: the first member's record is at 0
        self.first_raw = position

    def _more(self) -> bool:
        data = self.file.read(CHUNK)
        self.pending += data
        return bool(data)

    def _skippable(self) -> bool:
        """Passes over a skippable frame; the first may be a dictionary."""
        while len(self.pending) < 8 and self._more():
            pass
        if len(self.pending) < 8 or self.pending[1:4] != b"\x2a\x4d\x18" or self.pending[0] & 0xF0 != 0x50:
            return False
        n = 8 + int.from_bytes(self.pending[4:8], "little")
        if n - 8 > codecs.MAX_DICTIONARY and self.pending[0] == 0x5D and self.raw == 0:
            raise ParseError("DictionaryTooLarge")
        while len(self.pending) < n and self._more():
            pass
        if len(self.pending) < n:
            raise ProtocolError("UnexpectedEof", position=self.raw)
        if self.pending[0] == 0x5D and self.raw == 0:
            import io

            self.dictionary = codecs.read_dictionary(io.BytesIO(self.pending[:n]))
        self.pending, self.raw = self.pending[n:], self.raw + n
        return True

    def read(self) -> bytes:
        """The next decoded bytes, b'' at the end."""
        if self.codec == "identity":
            data = self.file.read(CHUNK)
            self.raw += len(data)
            self.decoded += len(data)
            return data
        while True:
            if self.d is None:
                if not self.pending and not self._more():
                    return b""
                while self.codec == "zstd" and self._skippable():
                    pass
                if not self.pending and not self._more():
                    return b""
                self.starts.append((self.decoded, self.first_raw if self.head else self.raw))
                self.head = False
                self.d = codecs.decompressor(self.codec, self.dictionary)
            if not self.pending and not self._more():
                raise ProtocolError("UnexpectedEof", "compressed member", position=self.raw)
            given = self.pending
            try:
                out = self.d.decompress(given)
            except ArchiveError:
                raise
            except Exception as e:
                raise ProtocolError("UnknownHeader", f"{self.codec}: {e}", position=self.raw, snippet=given) from e
            if self.d.eof:
                left = self.d.unused_data
                self.raw += len(given) - len(left)
                self.pending, self.d = left, None
            else:
                self.raw += len(given)
                self.pending = b""
            if out:
                self.decoded += len(out)
                return out


@dataclass
class Record:
    position: int
    index: int
    header: Header
    content_length: int
    block: bytes | None
    rat_fault: bool
    length: int  # decoded bytes of the whole record


def detect(head: bytes) -> str | None:
    """What the first bytes are: 'archive', 'compressed', 'unknown', or None if more are needed."""
    if head[:5] == b"WARC/":
        return "archive"
    if head[:2] == b"\x1f\x8b" or head[:4] == b"\x28\xb5\x2f\xfd":
        return "compressed"
    return "unknown" if len(head) >= 5 else None


def read_records(file, codec: str = "identity", *, dictionary: bytes | None = None, include_block: bool = True, position: int = 0, limit: int | None = None, first_index: int = 0, duplicates: str = "last", name: str | None = None, max_block: int | None = None) -> Iterator[Record]:
    """The records of a file from a record's position on (the file stands there). Blocks that aren't wanted are skipped,
    in plain files by seeking."""
    src = Members(file, codec, dictionary, position)
    plain = src.codec == "identity"
    buf, at = bytearray(), src.decoded  # at: decoded offset of buf[0]
    index = first_index

    def fill() -> bool:
        data = src.read()
        buf.extend(data)
        return bool(data)

    def need(n: int) -> bool:
        while len(buf) < n:
            if not fill():
                return False
        return True

    def fail(kind: str, cls=ProtocolError, **more):
        return cls(kind, file=name, position=at if plain else src.raw, **more)

    while limit is None or index - first_index < limit:
        if not need(1):
            return
        need(5)
        kind = detect(bytes(buf[:5]))
        if kind == "compressed":
            raise fail("UnexpectedCompression", snippet=bytes(buf[:16]))
        if kind == "unknown":
            raise fail("UnknownHeader", snippet=bytes(buf[:16]))
        start = at
        end = header_end(bytes(buf[: MAX_HEADER + 1]))
        while end is None:
            if len(buf) > MAX_HEADER:
                raise fail("HeaderTooBig")
            if not fill():
                raise fail("UnexpectedEof", detail="header") if kind else fail("UnknownHeader", snippet=bytes(buf[:16]))
            end = header_end(bytes(buf[: MAX_HEADER + 1]))
        if end > MAX_HEADER:
            raise fail("HeaderTooBig")
        try:
            header = Header.parse(bytes(buf[:end]), duplicates)
            n = header.content_length()
        except ArchiveError as e:
            e.file, e.position = name, start
            raise
        del buf[:end]
        at += end
        if max_block is not None and include_block and n > max_block:
            raise fail("Other", detail=f"a block of {n} bytes is over the limit of {max_block}")
        block = None
        if include_block:
            if not need(n):
                raise fail("UnexpectedEof", detail="block")
            block = bytes(buf[:n])
            del buf[:n]
        else:
            left = n
            take = min(left, len(buf))
            del buf[:take]
            left -= take
            if left and plain and file.seekable():
                file.seek(left, 1)
                src.raw += left
                src.decoded += left
            else:
                while left:
                    if not fill():
                        raise fail("UnexpectedEof", detail="block")
                    take = min(left, len(buf))
                    del buf[:take]
                    left -= take
        at += n
        if not need(4):
            raise fail("UnexpectedEof", detail="record boundary")
        if bytes(buf[:4]) != b"\r\n\r\n":
            raise fail("InvalidRecordBoundary", snippet=bytes(buf[:16]))
        del buf[:4]
        at += 4
        fault, later = False, None
        if plain:
            where = start
        else:
            if not buf:
                try:
                    fill()  # an end of member shows only when more is asked for
                except ArchiveError as e:
                    later = e  # what follows is damaged; this record isn't
                    later.file = name
            before = [s for s in src.starts if s[0] <= start]
            # members without content share a decoded offset with the next; the last of them holds the record
            where = next(s[1] for s in before if s[0] == before[-1][0]) if start == before[-1][0] and index == first_index else before[-1][1]
            ends_clean = (not buf and src.d is None) or any(s[0] == at for s in src.starts)
            fault = before[-1][0] != start or not ends_clean
            src.starts = [s for s in src.starts if s[0] >= before[-1][0]]
        yield Record(where, index, header, n, block, fault, at - start)
        index += 1
        if later:
            raise later


# ---- encoding


class Writer:
    """Records to a binary file, each a member of its own; an embedded dictionary goes first."""

    def __init__(self, file, codec: str = "identity", level: str = "high", dictionary: bytes | None = None, compress_dictionary: bool = False):
        self.file, self.codec, self.level, self.dictionary = file, codecs.codec_name(codec), level, dictionary
        self.position, self.records = 0, 0
        if dictionary and self.codec == "zstd":
            self._put(codecs.dictionary_frame(codecs.compress("zstd", dictionary) if compress_dictionary else dictionary))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.position += len(data)

    def write(self, header: Header, chunks: bytes | Iterable[bytes]) -> int:
        """Writes a record and returns its position. The block must have the declared length."""
        header.validate()
        block = chunks if isinstance(chunks, bytes) else b"".join(chunks)
        if len(block) != header.content_length():
            raise ProtocolError("ContentLengthMismatch", f"{len(block)} bytes, {header.content_length()} declared")
        at = self.position if self.records else 0  # the dictionary's frame belongs to the first record
        self.records += 1
        self._put(codecs.compress(self.codec, header.serialize() + block + b"\r\n\r\n", self.level, self.dictionary if self.codec == "zstd" else None))
        return at
