"""HTTP/1.1 messages: start lines, fields, framing, chunked coding and the codings on top."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import ArchiveError, ParseError, ProtocolError
from ..sources import codecs
from ..sources.warcio import TCHAR, Fields, field_pairs, get, header_end, insert, parse_u64, remove_line_folding

MAX_HEADER = 32_768

_HTTP = rb"[Hh][Tt][Tt][Pp]/[0-9]\.[0-9]"
_STATUS = re.compile(rb"(" + _HTTP + rb") ([0-9]{3})(?: ([!-~\x80-\xff \t]*))?\r?\n")
_REQUEST = re.compile(rb"(" + TCHAR + rb"+) ([!-~]+) (" + _HTTP + rb")\r?\n")
_SIZE = re.compile(rb"([0-9A-Fa-f]+)[!-~ \t]*\r\n")


@dataclass
class Message:
    """A request or response; values are bytes read as Latin-1 where they aren't UTF-8."""

    http_version: str = "HTTP/1.1"
    status_code: int | None = None
    reason: bytes = b""
    method: str | None = None
    target: str | None = None
    fields: Fields = field(default_factory=list)
    body: bytes = b""
    trailers: Fields = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "request" if self.method is not None else "response"

    @classmethod
    def request(cls, method: str, target: str, **more) -> Message:
        return cls(method=method, target=target, **more)

    @classmethod
    def response(cls, status_code: int, **more) -> Message:
        return cls(status_code=status_code, **more)

    def header_bytes(self) -> bytes:
        first = f"{self.method} {self.target} {self.http_version}".encode() if self.method is not None else f"{self.http_version} {self.status_code} ".encode() + self.reason
        return first + b"\r\n" + b"".join(text_bytes(k) + b": " + text_bytes(v) + b"\r\n" for k, v in self.fields) + b"\r\n"


def text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "surrogateescape")


def text_bytes(value: str) -> bytes:
    return value.encode("utf-8", "surrogateescape")


def _fields(data: bytes) -> Fields:
    out: Fields = []
    for k, v in field_pairs(data):
        out = insert(out, text(k), text(remove_line_folding(v)))
    return out


def parse_header(data: bytes) -> Message:
    """A message without body from the bytes up to the blank line. Of repeated names the last counts."""
    if m := _STATUS.match(data):
        return Message(http_version=m.group(1).decode(), status_code=int(m.group(2)), reason=m.group(3) or b"", fields=_fields(data[m.end() :]))
    if m := _REQUEST.match(data):
        return Message(http_version=m.group(3).decode(), method=m.group(1).decode(), target=m.group(2).decode(), fields=_fields(data[m.end() :]))
    raise ParseError("Syntax", "start line", snippet=data)


def comma_list(fields: Fields, name: str) -> list[str]:
    """The items of a comma-separated field, trimmed, in lower case, each once."""
    return list(dict.fromkeys(x.strip().lower() for x in (get(fields, name) or "").split(",") if x.strip()))


def content_length(fields: Fields) -> int | None:
    value = get(fields, "Content-Length")
    if value is None:
        return None
    try:
        return parse_u64(value)
    except ParseError:
        raise ProtocolError("InvalidContentLength") from None


def chunk_decode(data: bytes) -> tuple[bytes, int | None]:
    """The body and where the trailer begins, None if the data end before the last chunk."""
    out, at = [], 0
    while at < len(data):
        m = _SIZE.match(data, at)
        if not m:
            if re.fullmatch(rb"[0-9A-Fa-f]*[!-~ \t]*\r?", data[at:]):
                return b"".join(out), None
            raise ProtocolError("InvalidChunkedEncoding", snippet=data[at:])
        n, at = int(m.group(1), 16), m.end()
        if n == 0:
            return b"".join(out), at
        out.append(data[at : at + n])
        at += n
        if at >= len(data):
            break
        if data[at : at + 2] == b"\r\n":
            at += 2
        elif data[at : at + 1] == b"\n":
            at += 1
        elif data[at:] == b"\r":
            break
        else:
            raise ProtocolError("InvalidChunkedEncoding", snippet=data[at:])
    return b"".join(out), None


def chunk_encode(chunks, trailers: Fields = ()) -> bytes:
    """Non-empty chunks in chunked coding, closed by trailers and a blank line."""
    out = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in chunks if c)
    return out + b"0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in trailers) + b"\r\n"


def _decode(name: str, data: bytes, kind: str) -> bytes:
    try:
        codec = codecs.codec_name(name)
        return codecs.decompress(codec, data)
    except ArchiveError as e:
        if e.kind == "UnsupportedCompressionFormat":
            raise ProtocolError(kind, name) from e
        raise


def decode(data: bytes) -> tuple[Message, int]:
    """The first message in data with its body decoded, and where the next begins.

    A body that ends early, or whose compressed data are cut off, is given as far as it goes.
    """
    end = header_end(data[: MAX_HEADER + 1])
    if end is None:
        if len(data) > MAX_HEADER:
            raise ProtocolError("HeaderTooBig")
        raise ProtocolError("UnexpectedEof", "HTTP header")
    m = parse_header(data[:end])
    rest, used = data[end:], end
    transfer = comma_list(m.fields, "Transfer-Encoding")
    code = m.status_code
    if code is not None and (100 <= code < 200 or code in (204, 304)):
        body, n = b"", 0
    elif transfer:
        if transfer[-1] == "chunked":
            body, trailer = chunk_decode(rest)
            n = len(rest)
            if trailer is not None:
                # no trailer fields: the blank line comes at once
                stop = header_end(rest[trailer:])
                if stop is None:
                    stop = len(rest) - trailer
                if stop > MAX_HEADER:
                    raise ProtocolError("HeaderTooBig")
                m.trailers = _fields(rest[trailer : trailer + stop])
                n = trailer + stop
            transfer = transfer[:-1]
        elif m.kind == "request":
            raise ProtocolError("MissingContentLength")
        else:
            body, n = rest, len(rest)
    else:
        n = content_length(m.fields)
        if n is None:
            n = 0 if m.kind == "request" else len(rest)
        n = min(n, len(rest))
        body = rest[:n]
    for name in reversed(transfer):
        body = _decode(name, body, "UnsupportedTransferEncoding") if name != "identity" else body
    for name in comma_list(m.fields, "Content-Encoding"):  # in the order listed
        if name != "identity":
            body = _decode(name, body, "UnsupportedContentEncoding")
    m.body = body
    return m, used + n


def encode(m: Message, chunked: bool = False, chunk: int = 4096) -> bytes:
    """A message as bytes; the body is sent as it is, in chunks if asked."""
    body = chunk_encode((m.body[k : k + chunk] for k in range(0, len(m.body), chunk)), m.trailers) if chunked else m.body
    return m.header_bytes() + body
