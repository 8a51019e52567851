"""Labelled digests (algorithm:value) and checksums as columns."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArchiveError, ParseError, ProtocolError
from ..model import BINARY, LONG, STRING, SUMS, U64, struct
from . import hashes
from .fields import _col

BUILT_IN = {"md5": lambda c: F.unhex(F.md5(c)), "sha1": lambda c: F.unhex(F.sha1(c)), "sha256": lambda c: F.unhex(F.sha2(c, 256)), "sha512": lambda c: F.unhex(F.sha2(c, 512))}


def parse(label: str) -> tuple[str, bytes]:
    """Algorithm and bytes of a labelled digest: hex or base32 (any case, padding optional), told apart by length."""
    name, colon, value = label.partition(":")
    if not colon:
        raise ParseError("Syntax", "digest label")
    algorithm = hashes.algorithm_name(name)
    if algorithm is None:
        raise ProtocolError("UnsupportedDigest", name)
    n = hashes.OUTPUT_LENGTH[algorithm]
    bare = value.rstrip("=")
    as_hex, as_32 = len(value) == 2 * n, len(bare) == -(-n * 8 // 5)
    try:
        if as_32 and (not as_hex or value.endswith("=")):
            out = base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        elif as_hex:
            out = binascii.unhexlify(value)
        else:
            raise ProtocolError("InvalidBaseEncodedValue", label[:80])
    except (binascii.Error, ValueError):
        raise ProtocolError("InvalidBaseEncodedValue", label[:80]) from None
    return algorithm, out


def show(algorithm: str, value: bytes) -> str:
    """SHA-1 in base32 as is custom, all others in hex."""
    return f"{algorithm}:" + (base64.b32encode(value).decode() if algorithm == "sha1" else value.hex())


def algorithm_name(name: str | Column) -> Column:
    """The canonical algorithm of a name in any case, null if it isn't supported."""
    n = F.lower(_col(name))
    n = F.when(n.isin("sha-1", "sha-256", "sha-512"), F.replace(n, F.lit("-"), F.lit(""))).when(n == "xxh3-64", "xxh3").when(n == "blake2s-256", "blake2s").when(n == "blake2b-512", "blake2b").otherwise(n)
    return F.when(n.isin(*hashes.OUTPUT_LENGTH), n)


@F.pandas_udf(struct(algorithm=STRING, value=BINARY, error=STRING))
def digest_parse(labels: pd.Series) -> pd.DataFrame:
    out = []
    for s in labels:
        try:
            out.append((*parse(s), None) if s is not None else (None, None, None))
        except ArchiveError as e:
            out.append((None, None, e.kind))
    return pd.DataFrame(out, columns=["algorithm", "value", "error"])


@F.pandas_udf(STRING)
def digest_format(algorithms: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or v is None else show(a, bytes(v)) for a, v in zip(algorithms, values)], dtype=object)


def _python(algorithm: str):
    @F.pandas_udf(BINARY)
    def udf(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hashes.digest(algorithm, bytes(v)) for v in values], dtype=object)

    @F.pandas_udf(BINARY)
    def blake3(values: pd.Series) -> pd.Series:
        has = [v is not None for v in values]
        found = iter(hashes.blake3_each([bytes(v) for v in values if v is not None]))
        return pd.Series([next(found) if h else None for h in has], dtype=object)

    return blake3 if algorithm == "blake3" else udf


def digest(algorithm: str, data: str | Column) -> Column:
    """The digest as bytes; Spark's own function where there is one."""
    data = _col(data)
    if algorithm in BUILT_IN:
        return BUILT_IN[algorithm](data)
    if algorithm not in hashes.OUTPUT_LENGTH:
        raise ProtocolError("UnsupportedDigest", algorithm)
    return _python(algorithm)(data)


@F.pandas_udf(SUMS)
def checksums(data: pd.Series) -> pd.DataFrame:
    """crc32, crc32c and xxh3 in one pass over the rows."""
    import zlib
    from decimal import Decimal

    rows = [(None, None, None) if v is None else (zlib.crc32(v), hashes.crc32c(bytes(v)), Decimal(hashes.xxh3_64(bytes(v)))) for v in data]
    return pd.DataFrame(rows, columns=["crc32", "crc32c", "xxh3"], dtype=object)


@F.pandas_udf(U64)
def xxh3_64(data: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([None if v is None else Decimal(hashes.xxh3_64(bytes(v))) for v in data], dtype=object)


@F.pandas_udf(LONG)
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else hashes.crc32c(bytes(v)) for v in data], dtype="Int64")


def crc32(data: str | Column) -> Column:
    return F.crc32(_col(data))
