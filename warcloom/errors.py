"""What can go wrong, by kind; the kinds are the same in exceptions and in `_error` columns."""

from __future__ import annotations

MESSAGES = {
    "IoNotSeekable": "this input or output can't seek",
    "UnknownHeader": "no archive record begins here (another format, or damaged)",
    "UnexpectedCompression": "the data is compressed and was read as plain",
    "HeaderTooBig": "the header is longer than the limit",
    "MissingContentLength": "no content length where one is needed",
    "ContentLengthMismatch": "the content isn't as long as declared",
    "InvalidContentLength": "the content length isn't a number",
    "InvalidRecordBoundary": "a record doesn't end where it should",
    "InvalidMessageBoundary": "a message doesn't end where it should",
    "UnsupportedTransferEncoding": "transfer encoding not supported",
    "UnsupportedContentEncoding": "content encoding not supported",
    "UnsupportedCompressionFormat": "compression format not supported",
    "InvalidChunkedEncoding": "chunked encoding is malformed",
    "UnsupportedDigest": "digest algorithm not supported",
    "InvalidBaseEncodedValue": "the encoded value is malformed",
    "UnsupportedSegmentedRecord": "a segment of a record can't be extracted",
    "NotFound": "no such record",
    "NoContent": "the record holds no content that can be extracted",
    "AmbiguousSpecification": "the request fits more than one thing",
    "UnexpectedEof": "the input ends within a record",
    "Syntax": "malformed syntax",
    "InvalidUtf8": "text isn't UTF-8",
    "Number": "not a number in range",
    "DictionaryTooLarge": "the compression dictionary is longer than the limit",
    "NotDictionary": "the file doesn't begin with a compression dictionary",
    "Sequence": "the message sequence is malformed",
    "ChecksumMismatch": "a block doesn't match its checksum",
    "Other": "other",
}


class ArchiveError(Exception):
    """An error with a kind and, where known, file, byte position, record id and a short snippet of the input."""

    family = "Protocol"

    def __init__(self, kind: str, detail: str = "", *, file: str | None = None, position: int | None = None, record_id: str | None = None, snippet: bytes | None = None):
        self.kind, self.detail, self.file, self.position, self.record_id = kind, detail, file, position, record_id
        self.snippet = None if snippet is None else escape_snippet(snippet)
        super().__init__(kind, detail)

    def __str__(self) -> str:
        out = MESSAGES.get(self.kind, self.kind) + (f": {self.detail}" if self.detail else "")
        where = [f"{k} {v}" for k, v in (("file", self.file), ("position", self.position), ("near", self.snippet), ("record", self.record_id)) if v is not None]
        return out + (f" ({', '.join(where)})" if where else "")

    def __reduce__(self):
        return _revive, (type(self), self.kind, self.detail, self.file, self.position, self.record_id, self.snippet)


class ParseError(ArchiveError):
    family = "Parse"


class ProtocolError(ArchiveError):
    family = "Protocol"


class StorageError(ArchiveError):
    family = "Storage"


def _revive(cls, kind, detail, file, position, record_id, snippet):
    e = cls(kind, detail, file=file, position=position, record_id=record_id)
    e.snippet = snippet
    return e


def escape_snippet(data: bytes, most: int = 16) -> str:
    return "".join(chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02x}" for b in data[:most])
