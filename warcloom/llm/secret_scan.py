"""Secrets in texts, reported only after structural confirmation.

Candidates are PEM blocks, dotted signed tokens and long runs of base64 or hex. Each is decoded; the bytes must then
parse as what they seem to be: DER with nested lengths that add up and the shape of a key (in PKCS#8, of the key inside
too), an OpenSSH private container, an OpenPGP secret-key packet whose checksum is right, whole cipher blocks under the
headers of an encrypted PEM key, a signed token whose header is JSON with an algorithm. Public keys are no secrets; base64 that
is wrapped into lines is found in PEM and OpenPGP blocks only. A run of hex that decodes to a usual key length
has no inner structure; it is reported (kind opaque_key) only where the text assigns it to a name for secrets and its
bytes are as varied as random ones.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+?)-----((?:(?!-----)[A-Za-z0-9+/=\s\\:,;.()@-])*)-----END \1-----")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,}={0,2})\.([A-Za-z0-9_-]{2,}={0,2})\.([A-Za-z0-9_-]*={0,2})(?![A-Za-z0-9_-])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)\w*$", re.IGNORECASE)
#: Lengths in bytes of keys and tokens that are written in hex.
KEY_BYTES = frozenset((16, 20, 24, 32, 48, 64))
_OIDS = {bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a8648ce3d0201"): "ec", bytes.fromhex("2b6570"): "ed25519", bytes.fromhex("2b656e"): "x25519", bytes.fromhex("2a8648ce380401"): "dsa"}


def unbase64(text: str) -> bytes | None:
    t = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(t) % 4 == 1:
        return None
    try:
        return base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The elements [(tag, value or elements)] that fill data exactly, None where a length doesn't fit its parent."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2 or depth > 200:  # no key nests so deep; each level takes two bytes
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 128:  # DER wants the short form
                return None
        if at + n > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def der_key(data: bytes) -> str | None:
    """What key a DER structure holds, if its fields have a key's shape."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    seq = top[0][1]
    tags = [t for t, _ in seq]
    if len(seq) >= 9 and tags[:9] == [2] * 9 and seq[0][1] in (b"\0", b"\1"):
        n, p, q = (int.from_bytes(seq[k][1], "big") for k in (1, 4, 5))
        return "rsa_private_key" if n == p * q else None
    if len(seq) == 6 and tags == [2] * 6 and seq[0][1] == b"\0":
        return "dsa_private_key"
    if len(seq) >= 2 and tags[:2] == [2, 4] and seq[0][1] == b"\1" and 16 <= len(seq[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec_private_key"
    if len(seq) >= 3 and tags[:3] == [2, 0x30, 4] and seq[1][1] and seq[1][1][0][0] == 6:
        kind, inner = _OIDS.get(seq[1][1][0][1]), der(seq[2][1])
        if not inner or len(inner) != 1:
            return None
        fits = {"rsa": lambda: der_key(seq[2][1]) == "rsa_private_key", "ec": lambda: der_key(seq[2][1]) == "ec_private_key", "dsa": lambda: inner[0][0] == 2}
        fits |= dict.fromkeys(("ed25519", "x25519"), lambda: inner[0][0] == 4 and len(inner[0][1]) == 32)
        return f"pkcs8_{kind or 'other'}_private_key" if kind is None or fits[kind]() else None
    if len(seq) == 2 and tags == [0x30, 4] and seq[0][1] and seq[0][1][0][0] == 6:
        return "pkcs8_encrypted_private_key"
    return None


def openssh_key(data: bytes) -> str | None:
    """An OpenSSH private container: magic and nested lengths that fill it."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):  # cipher, kdf, kdf options
            n = int.from_bytes(data[at : at + 4], "big")
            at += 4 + n
            if at + 4 > len(data):
                return None
        count = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= count <= len(data) // 4:
            return None
        for _ in range(count + 1):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return "openssh_private_key" if at == len(data) else None
    return None


def signed_token(head: str, body: str) -> str | None:
    """A signed-token header: base64url JSON with an algorithm, over a JSON body."""
    raw, inner = unbase64(head), unbase64(body)
    try:
        header = json.loads(raw) if raw else None
        if isinstance(header, dict) and isinstance(header.get("alg"), str):
            if "enc" in header:
                return "encrypted_token"
            return "signed_token" if isinstance(json.loads(inner or b""), dict) else None
    except (ValueError, RecursionError):
        pass
    return None


def confirm_bytes(data: bytes | None) -> str | None:
    if not data or len(data) < 16:
        return None
    if data[0] == 0x30:
        return der_key(data)
    if data.startswith(b"openssh-key-v1\0"):
        return openssh_key(data)
    if data.startswith(b"-----BEGIN ") and b"PRIVATE KEY" in data.split(b"\n", 1)[0]:
        found = scan(data.decode("latin-1"))
        return found[0][2] if found else None
    return None


def _crc24(data: bytes) -> int:
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def pem_secret(label: str, body: str) -> str | None:
    """What secret a PEM or OpenPGP block holds, its headers and lines taken apart."""
    lines = [x.strip() for x in re.split(r"\\r?\\n|\n", body)]
    headers, rest = [x for x in lines if ":" in x], [x for x in lines if x and ":" not in x]
    if label == "PGP PRIVATE KEY BLOCK":
        check = unbase64(rest.pop()[1:]) if rest and rest[-1].startswith("=") and len(rest[-1]) == 5 else None
        data = unbase64("".join(rest))
        if not data or check is not None and _crc24(data) != int.from_bytes(check, "big"):
            return None
        tag = data[0] & 0x3F if data[0] & 0x40 else (data[0] & 0x3C) >> 2
        return "openpgp_private_key" if data[0] & 0x80 and tag == 5 and len(data) > 32 else None
    if "PRIVATE KEY" not in label:
        return None
    data = unbase64("".join("".join(rest).split()))
    if any(x.replace(" ", "") == "Proc-Type:4,ENCRYPTED" for x in headers):
        cipher = next((x.split(":", 1)[1].strip() for x in headers if x.startswith("DEK-Info:")), "")
        block = 16 if cipher.startswith("AES") else 8
        return "encrypted_pem_private_key" if "," in cipher and data and len(data) % block == 0 else None
    return confirm_bytes(data)


def assigned(text: str, at: int) -> bool:
    """Whether what begins at `at` is given to a name for secrets: name, operator and quotes, read backwards from there."""
    k = at
    if k and text[k - 1] in "\"'":
        k -= 1
    while k and text[k - 1].isspace():
        k -= 1
    op = next((o for o in ("=>", ":=", "=", ":") if text.endswith(o, 0, k)), None)
    if op is None:
        return False
    k -= len(op)
    while k and text[k - 1].isspace():
        k -= 1
    if k and text[k - 1] in "\"'":
        k -= 1
    end = k
    while k and (text[k - 1].isalnum() or text[k - 1] in "_-"):
        k -= 1
    return _NAME.search(text[k:end]) is not None


def varied(data: bytes) -> bool:
    """Whether bytes spread as random ones do: the entropy reaches 0.8 of what so many bytes can have."""
    n = len(data)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    return entropy >= 0.8 * math.log2(min(n, 256))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of confirmed secrets, in order, none inside another."""
    found, inside = [], 0
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            kind = pem_secret(m.group(1), m.group(2))
            if kind:
                found.append((m.start(), m.end(), kind))
    blocks = list(found)
    for run in _RUN.finditer(text):
        a, s = run.start(), run.group()
        while inside < len(blocks) and blocks[inside][1] <= a:
            inside += 1
        if inside < len(blocks) and blocks[inside][0] <= a:
            continue
        taken: list[tuple[int, int]] = []
        for m in _JWT.finditer(s) if s.count(".") >= 2 else ():
            kind = signed_token(m.group(1), m.group(2))
            if kind:
                found.append((a + m.start(), a + m.end(), kind))
                taken.append(m.span())
        for m in _HEX.finditer(s):
            data = bytes.fromhex(m.group()) if len(m.group()) % 2 == 0 else None
            kind = confirm_bytes(data)
            start = a + m.start()
            if not kind and data and len(data) in KEY_BYTES and varied(data) and assigned(text, start):
                kind = "opaque_key"
            if kind and not any(x < m.end() and m.start() < y for x, y in taken):
                found.append((start, a + m.end(), kind))
                taken.append(m.span())
        for m in _BASE64.finditer(s):
            if not any(x < m.end() and m.start() < y for x, y in taken):
                kind = confirm_bytes(unbase64(m.group()))
                if kind:
                    found.append((a + m.start(), a + m.end(), kind))
    return sorted(found)


_SCHEMA = "doc_id long, start long, end long, kind string"


def _batches(batches):
    for b in pieces(batches):
        rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for hit in scan(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "kind"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (character positions) and kind of each confirmed secret.

    Null and empty texts hold none. Rows without doc_id are reported with a null id, repeated rows once each. Other
    columns are ignored, whatever their names. Of kinds that overlap the structured one counts: PEM blocks, then signed
    tokens, then hex, then base64.
    """
    # texts without a long run of the alphabet hold no candidate and don't leave the JVM; the pattern is tried at the start
    # of runs alone
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.col("text").rlike(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{24}|-----BEGIN "))
    return some.mapInArrow(_batches, _SCHEMA)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
