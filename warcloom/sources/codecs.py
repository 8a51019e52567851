"""Compression by name: one-shot and incremental, with member boundaries where a format has them."""

from __future__ import annotations

import zlib

from ..errors import ParseError, ProtocolError

NAMES = {
    "identity": "identity", "none": "identity", "": "identity",
    "deflate": "deflate",
    "gzip": "gzip", "x-gzip": "gzip", "gz": "gzip",
    "br": "brotli", "brotli": "brotli",
    "zstd": "zstd", "zstandard": "zstd", "zst": "zstd",
}
#: Levels for balanced, high and low compression.
LEVELS = {"gzip": {"balanced": 6, "high": 9, "low": 1}, "deflate": {"balanced": 6, "high": 9, "low": 1}, "brotli": {"balanced": 4, "high": 7, "low": 0}, "zstd": {"balanced": 3, "high": 9, "low": 1}}
DICTIONARY_FRAME = 0x184D2A5D
MAX_DICTIONARY = 16 << 20


def codec_name(name: str) -> str:
    try:
        return NAMES[name.strip().lower()]
    except KeyError:
        raise ParseError("UnsupportedCompressionFormat", name) from None


def of_file(name: str) -> str:
    """The codec of an archive file by its name, in any case."""
    low = name.lower()
    for end, codec in ((".warc", "identity"), (".warc.gz", "gzip"), (".warc.zst", "zstd")):
        if low.endswith(end):
            return codec
    raise ProtocolError("UnsupportedCompressionFormat", f"can't tell the compression of {name!r} from its name")


def sniff(head: bytes) -> str:
    """The codec by the first bytes, for input without a name."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"\x28\xb5\x2f\xfd" or (len(head) >= 4 and head[1:4] == b"\x2a\x4d\x18" and head[0] & 0xF0 == 0x50):
        return "zstd"
    return "identity"


def _brotli():
    try:
        import brotli
    except ImportError:
        raise ProtocolError("UnsupportedCompressionFormat", "brotli isn't installed") from None
    return brotli


class _Identity:
    eof, unused_data = False, b""

    def decompress(self, data: bytes) -> bytes:
        return data


class _Brotli:
    eof, unused_data = False, b""

    def __init__(self):
        self._d = _brotli().Decompressor()

    def decompress(self, data: bytes) -> bytes:
        return self._d.process(data)


def decompressor(codec: str, dictionary: bytes | None = None):
    """An object with decompress(bytes), eof (one member is over) and unused_data (what follows it)."""
    codec = codec_name(codec)
    if codec == "identity":
        return _Identity()
    if codec == "gzip":
        return zlib.decompressobj(31)
    if codec == "deflate":
        return zlib.decompressobj(15)
    if codec == "brotli":
        return _Brotli()
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompressobj()


def decompress(codec: str, data: bytes, dictionary: bytes | None = None) -> bytes:
    """All members of data. A cut-off end isn't an error: what could be decoded is returned."""
    out, left = [], data
    codec = codec_name(codec)
    while left:
        d = decompressor(codec, dictionary)
        try:
            out.append(d.decompress(left))
        except Exception as e:  # each codec has an error class of its own
            if isinstance(e, ProtocolError):
                raise
            if out:
                break
            raise ProtocolError("UnsupportedCompressionFormat" if codec == "identity" else "Other", f"{codec}: {e}") from e
        if not d.eof:
            break
        left = d.unused_data
    return b"".join(out)


def compress(codec: str, data: bytes, level: str = "balanced", dictionary: bytes | None = None) -> bytes:
    """data as one member."""
    codec = codec_name(codec)
    if codec == "identity":
        return data
    n = LEVELS[codec][level]
    if codec == "gzip":
        c = zlib.compressobj(n, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    if codec == "deflate":
        return zlib.compress(data, n)
    if codec == "brotli":
        return _brotli().compress(data, quality=n, lgwin=22)
    import zstandard

    params = {"level": n, "write_checksum": True, "write_content_size": True}
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **params).compress(data)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds an embedded dictionary at the head of a file."""
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_dictionary(file) -> bytes:
    """The embedded dictionary at a stream's head, decompressed if it is compressed itself."""
    head = file.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        raise ParseError("NotDictionary")
    n = int.from_bytes(head[4:], "little")
    if n > MAX_DICTIONARY:
        raise ParseError("DictionaryTooLarge")
    data = file.read(n)
    if len(data) < n:
        raise ParseError("UnexpectedEof")
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=MAX_DICTIONARY)
    return data
