"""Expressions over `fields`, the ordered case-insensitive multimap of a record's header. All stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError

TCHAR = r"[0-9A-Za-z!#$%&'*+\-.^_`|~]"
_MEDIA = rf"^({TCHAR}+)/({TCHAR}+)((?:[ \t]*;[ \t]*{TCHAR}+={TCHAR}+)*)$"
_DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lower(c: Column) -> Column:
    """ASCII letters only, as field names are compared."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _same(name: str):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return lambda f: _lower(f["name"]) == F.lit(low)


def get_field(fields: str | Column, name: str) -> Column:
    """The first value of a name, null where there is none."""
    return F.get(F.filter(_col(fields), _same(name)), 0)["value"]


def field_or_empty(fields: str | Column, name: str) -> Column:
    return F.coalesce(get_field(fields, name), F.lit(""))


def get_all_fields(fields: str | Column, name: str) -> Column:
    return F.transform(F.filter(_col(fields), _same(name)), lambda f: f["value"])


def has_field(fields: str | Column, name: str) -> Column:
    return F.coalesce(F.exists(_col(fields), _same(name)), F.lit(False))


def remove_field(fields: str | Column, name: str) -> Column:
    same = _same(name)
    return F.filter(_col(fields), lambda f: ~same(f))


def append_field(fields: str | Column, name: str, value: str | Column) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.concat(_col(fields), F.array(F.struct(F.lit(name).alias("name"), v.alias("value"))))


def insert_field(fields: str | Column, name: str, value: str | Column) -> Column:
    """Puts one value in the place of all of a name, at the end."""
    return append_field(remove_field(fields, name), name, value)


def extend_fields(fields: str | Column, more: str | Column) -> Column:
    return F.concat(_col(fields), _col(more))


def n_fields(fields: str | Column) -> Column:
    return F.size(_col(fields))


def show_fields(fields: str | Column) -> Column:
    """`name: value` lines, each ended by CR LF."""
    return F.array_join(F.transform(_col(fields), lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit("\r\n"))), "")


def serialize_header(version: str | Column, fields: str | Column) -> Column:
    return F.concat(_col(version), F.lit("\r\n"), show_fields(fields), F.lit("\r\n"))


def new_header_fields(warc_type: str | Column, content_length: str | Column) -> Column:
    """The four mandatory fields for a new record: a random id and the present time."""
    t = warc_type if isinstance(warc_type, Column) else F.lit(warc_type)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return F.array(pair("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), pair("WARC-Type", t), pair("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), pair("Content-Length", _col(content_length).cast("string")))


def u64_strict(text: str | Column) -> Column:
    """decimal(20,0) of a text of ASCII digits below 2^64, else null."""
    t = _col(text)
    n = F.when(t.rlike(r"\A0*[0-9]{1,20}\z"), t).try_cast("decimal(20,0)")
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n)


def content_length(fields: str | Column) -> Column:
    return u64_strict(get_field(fields, "Content-Length"))


def set_content_length(fields: str | Column, value: str | Column) -> Column:
    return insert_field(fields, "Content-Length", _col(value).cast("string"))


def media_type(text: str | Column) -> Column:
    """struct(type, subtype, parameters) of type/subtype;name=value..., tokens only; null where malformed. Of repeated parameters the last counts."""
    t = _col(text)
    ok = t.rlike(_MEDIA)
    items = F.filter(F.transform(F.split(F.regexp_extract(t, _MEDIA, 3), ";"), lambda s: F.trim(F.translate(s, "\t", " "))), lambda s: s != "")
    pairs = F.transform(items, lambda s: F.struct(F.substring_index(s, "=", 1).alias("k"), F.expr("0").cast("int").alias("n"), s.alias("s")))
    entries = F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), F.substring(p["s"], F.length(p["k"]) + 2, F.length(p["s"])).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.when(ok, F.struct(F.regexp_extract(t, _MEDIA, 1).alias("type"), F.regexp_extract(t, _MEDIA, 2).alias("subtype"), F.map_from_entries(last).alias("parameters")))


def is_media_type(text: str | Column) -> Column:
    return _col(text).rlike(_MEDIA)


def is_rfc3339(text: str | Column) -> Column:
    """Whether the text is a full RFC 3339 date and time that exists."""
    t = _col(text)
    return F.coalesce(t.rlike(_DATE) & F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def rfc3339(text: str | Column) -> Column:
    t = _col(text)
    return F.when(is_rfc3339(t), F.try_to_timestamp(F.regexp_replace(F.upper(t), r"^(.{10}) ", "$1T")))


def is_bracketed(text: str | Column) -> Column:
    """Whether an address is written <...>, which the format's examples wrongly suggest."""
    t = _col(text)
    return F.coalesce(t.startswith("<") & t.endswith(">"), F.lit(False))


def unbracketed(text: str | Column) -> Column:
    t = _col(text)
    return F.when(is_bracketed(t), F.regexp_replace(t, r"^<+|>+$", "")).otherwise(t)


def is_field_name(text: str | Column) -> Column:
    return _col(text).rlike(rf"\A{TCHAR}+\z")


def is_field_value(text: str | Column, folding: bool = False) -> Column:
    one = r"[!-~\x{80}-\x{10ffff}][!-~\x{80}-\x{10ffff} \t]*"
    return _col(text).rlike(rf"\A(?:{one}|\r?\n[ \t]+)*\z" if folding else rf"\A(?:{one})?\z")


def unfold(text: str | Column) -> Column:
    """Folded lines as one, each fold a blank."""
    return F.regexp_replace(_col(text), r"\r?\n[ \t]+", " ")


def comma_list(text: str | Column) -> Column:
    """Items trimmed, in lower case, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(_col(text), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


# ---- filters


def _rule(fields: Column, rule: str) -> Column:
    name, _, value = rule.partition(":")
    if ":" not in rule or not value:
        return has_field(fields, name)
    same = _same(name)
    return F.coalesce(F.exists(fields, lambda f: same(f) & (f["value"] == F.lit(value))), F.lit(False))


_UNSUPPORTED = re.compile(r"\(\?(?:<?[=!])|(?<!\\)(?:\\\\)*\\[1-9]|\(\?>|[*+?}]\+")


def checked_pattern(pattern: str) -> str:
    """The pattern, if it keeps to what runs in linear time: no look-around, back-references or possessive forms."""
    if _UNSUPPORTED.search(pattern):
        raise ParseError("Syntax", f"pattern {pattern!r} uses look-around, back-references or possessive repeats")
    return pattern


def _pattern(fields: Column, rule: str) -> Column:
    name, _, value = rule.partition(":")
    same, p = _same(name), checked_pattern(value)
    return F.coalesce(F.exists(fields, lambda f: same(f) & f["value"].rlike(p)), F.lit(False))


def field_filter(fields: str | Column, include=(), exclude=(), include_pattern=(), exclude_pattern=()) -> Column:
    """NOT any exclusion AND (no inclusion is given OR any holds). A rule is NAME (present) or NAME:VALUE (equal) or NAME:REGEX (found anywhere)."""
    f = _col(fields)
    out = F.lit(True)
    for r in exclude:
        out = out & ~_rule(f, r)
    for r in exclude_pattern:
        out = out & ~_pattern(f, r)
    wanted = [_rule(f, r) for r in include] + [_pattern(f, r) for r in include_pattern]
    if wanted:
        any_ = wanted[0]
        for w in wanted[1:]:
            any_ = any_ | w
        out = out & any_
    return out
