"""Verification: rules over headers and blocks, dangling references, and segments, as sets.

One pass over the records makes a survey: for each the problems of its own (an array of candidates, filtered), its
references and its place among segments. That table is cut into the shared folder; references, segments and the order of
files then need shuffles of its short rows only. Blocks are read by the digest rules alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..functions import digests, hashes
from ..functions.fields import field_or_empty, get_all_fields, get_field, has_field, is_bracketed, is_media_type, is_rfc3339, media_type, u64_strict, unbracketed
from ..functions.urls import ip_is_valid, url_is_valid
from ..model import BOOLEAN, INT, STRING, array, struct
from ..scratch import cut
from . import http1

TYPES = ("continuation", "conversion", "metadata", "request", "resource", "response", "revisit", "warcinfo")
CHECKS = (
    "mandatory-fields", "known-record-type", "content-type", "concurrent-to", "block-digest", "payload-digest", "ip-address", "refers-to",
    "refers-to-target-uri", "refers-to-date", "target-uri", "truncated", "warcinfo-id", "filename", "profile", "segment", "record-at-time-compression",
)
_MANDATORY = ("WARC-Record-ID", "Content-Length", *(f"WARC-{x}" for x in ("Date", "Type")))
_TRUNCATED = ("length", "time", "disconnect", "unspecified")


def _problem(ord_: int, kind: str, arg: Column | None = None) -> Column:
    a = F.lit(None).cast("string") if arg is None else arg
    return F.struct(F.lit(kind).alias("kind"), a.alias("arg"), F.lit(ord_).alias("ord"))


_HEADERS = (
    *_MANDATORY, "Content-Type", "WARC-Concurrent-To", "WARC-IP-Address", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Target-URI",
    "WARC-Truncated", "WARC-Filename", "WARC-Profile", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length", "WARC-Segment-Number",
)


def _header(name: str) -> Column:
    return F.col("_h_" + name.lower().replace("-", "_"))


def _has(name: str) -> Column:
    return _header(name).isNotNull()


def _value(name: str) -> Column:
    return F.coalesce(_header(name), F.lit(""))


def _with_headers(records: DataFrame) -> DataFrame:
    """Adds a column for each field that a rule looks at: looked up once, the rules are short expressions over them."""
    return records.withColumns({"_h_" + n.lower().replace("-", "_"): get_field("fields", n) for n in _HEADERS})


def header_rules(checks=CHECKS) -> list[Column]:
    """Candidate problems (null where a rule holds), in the order in which they are reported, over the columns of _with_headers."""
    typ, out, k = _value("WARC-Type"), [], 0

    def add(check: str, cond: Column, kind: str, arg: Column | str | None = None) -> None:
        nonlocal k
        k += 1
        if check in checks:
            out.append(F.when(cond, _problem(k, kind, F.lit(arg) if isinstance(arg, str) else arg)))

    def banned(check: str, name: str, types) -> None:
        add(check, _has(name) & typ.isin(*types), "ProhibitedField", name)

    def needed(check: str, name: str, cond: Column | None = None) -> None:
        add(check, ~_has(name) & (F.lit(True) if cond is None else cond), "RequiredFieldMissing", name)

    for name in _MANDATORY:
        needed("mandatory-fields", name)
    add("known-record-type", ~typ.isin(*TYPES), "UnknownRecordType", typ)
    add("mandatory-fields", _has("WARC-Date") & ~is_rfc3339(_value("WARC-Date")), "InvalidDate", "WARC-Date")
    add("content-type", _has("Content-Type") & ~is_media_type(_value("Content-Type")), "InvalidMediaType", "Content-Type")
    banned("concurrent-to", "WARC-Concurrent-To", ("warcinfo", "conversion", "continuation"))
    banned("ip-address", "WARC-IP-Address", ("warcinfo", "conversion", "continuation"))
    add("ip-address", _has("WARC-IP-Address") & ~F.coalesce(F.col("_ip_ok"), F.lit(True)), "InvalidIpAddress", "WARC-IP-Address")
    banned("refers-to", "WARC-Refers-To", ("continuation", "request", "resource", "response", "warcinfo"))
    others = tuple(t for t in TYPES if t != "revisit")
    banned("refers-to-target-uri", "WARC-Refers-To-Target-URI", others)
    add("refers-to-target-uri", _has("WARC-Refers-To-Target-URI") & ~F.coalesce(F.col("_refers_ok"), F.lit(True)), "InvalidUrl", "WARC-Refers-To-Target-URI")
    banned("refers-to-date", "WARC-Refers-To-Date", others)
    add("refers-to-date", _has("WARC-Refers-To-Date") & ~is_rfc3339(_value("WARC-Refers-To-Date")), "InvalidDate", "WARC-Refers-To-Date")
    target = _value("WARC-Target-URI")
    banned("target-uri", "WARC-Target-URI", ("warcinfo",))
    needed("target-uri", "WARC-Target-URI", typ.isin("continuation", "conversion", "request", "resource", "response", "revisit"))
    add("target-uri", _has("WARC-Target-URI") & is_bracketed(target), "BadSpecUri", "WARC-Target-URI")
    add("target-uri", _has("WARC-Target-URI") & ~F.coalesce(F.col("_target_ok"), F.lit(True)), "InvalidUrl", "WARC-Target-URI")
    add("truncated", _has("WARC-Truncated") & ~_value("WARC-Truncated").isin(*_TRUNCATED), "InvalidTruncatedReason", _value("WARC-Truncated"))
    banned("warcinfo-id", "WARC-Target-URI", ("warcinfo",))
    add("filename", _has("WARC-Filename") & (typ != "warcinfo"), "ProhibitedField", "WARC-Filename")
    needed("profile", "WARC-Profile", typ == "profile")
    add("profile", _has("WARC-Profile") & is_bracketed(_value("WARC-Profile")), "BadSpecUri", "WARC-Target-URI")
    cont = typ == "continuation"
    for name in ("WARC-Segment-Origin-ID", "WARC-Segment-Total-Length", "WARC-Segment-Number"):
        needed("segment", name, cont)
    for name in ("WARC-Segment-Origin-ID", "WARC-Segment-Total-Length"):
        add("segment", _has(name) & ~cont, "ProhibitedField", name)
    number = u64_strict(_value("WARC-Segment-Number"))
    add("segment", _has("WARC-Segment-Number") & number.isNull(), "ParseInt", "WARC-Segment-Number")
    add("segment", cont & (number == 1), "InvalidSegment")
    add("segment", _has("WARC-Segment-Total-Length") & u64_strict(_value("WARC-Segment-Total-Length")).isNull(), "ParseInt", "WARC-Segment-Total-Length")
    return out


def _with_validity(records: DataFrame) -> DataFrame:
    """Adds what the header rules need from Python: whether addresses and URLs are valid."""
    return _with_headers(records).withColumns({
        "_ip_ok": ip_is_valid(_header("WARC-IP-Address")),
        "_refers_ok": url_is_valid(_header("WARC-Refers-To-Target-URI")),
        "_target_ok": url_is_valid(unbracketed(_header("WARC-Target-URI"))),
    })


def _found(checks) -> Column:
    """The header problems of a record as an array."""
    rules = header_rules(checks)
    none = F.array().cast("array<struct<kind: string, arg: string, ord: int>>")
    return F.filter(F.array(*rules), lambda p: p.isNotNull()) if rules else none


_RID = ("record_id", "file", "record_index")


def header_problems(records: DataFrame, checks=CHECKS) -> DataFrame:
    r = _with_validity(records).select(field_or_empty("fields", "WARC-Record-ID").alias("record_id"), "file", "record_index", _found(checks).alias("header"))
    return _exploded(r, "header")


def _exploded(slim: DataFrame, column: str) -> DataFrame:
    return _shape(slim.select(*_RID, F.explode(column).alias("p")).select(*_RID, "p.*"))


def _shape(df: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else null.alias(c)) for c in ("record_id", "kind", "arg", "algorithm", "expected", "actual")], "file", "record_index", F.col("ord").cast("int").alias("ord"))


# ---- digests


_DIGEST = array(struct(kind=STRING, arg=STRING, algorithm=STRING, expected=STRING, actual=STRING, ord=INT))


@F.pandas_udf(_DIGEST)
def _digest_problems(block_labels: pd.Series, payload_labels: pd.Series, kinds: pd.Series, errors: pd.Series, blocks: pd.Series) -> pd.Series:
    """Of each record the labels that can't be read and the digests that don't match, in one pass over its bytes."""

    def compare(labels, data, mismatch):
        out, wanted = [], {}
        for label in labels if labels is not None else ():
            try:
                a, v = digests.parse(label)
                wanted[a] = v
            except ArchiveError:
                out.append(("UnknownDigest", label, None, None, None))
        for a, v in wanted.items():
            actual = hashes.digest(a, data)
            if actual != v:
                out.append((mismatch, None, a, v.hex(), actual.hex()))
        return out

    rows = []
    for bl, pl, kind, error, block in zip(block_labels, payload_labels, kinds, errors, blocks):
        data = bytes(block if block is not None else b"")
        out = compare(bl, data, "DigestMismatch")
        if error is not None and pl is not None and len(pl):
            out.append(("ParsePayload", error, None, None, None))
        elif kind is not None and pl is not None and len(pl):
            payload = data
            if kind == "http":
                try:
                    payload = http1.decode(data)[0].body
                except ArchiveError as e:
                    out.append(("ParsePayload", e.kind, None, None, None))
                    payload = b""
            out += compare(pl, payload, "PayloadDigestMismatch")
        rows.append([dict(zip(("kind", "arg", "algorithm", "expected", "actual", "ord"), (*p, 1000 + k))) for k, p in enumerate(out)])
    return pd.Series(rows, dtype=object)


@F.pandas_udf(struct(ip_ok=BOOLEAN, refers_ok=BOOLEAN, target_ok=BOOLEAN, digest=_DIGEST))
def _survey(ips: pd.Series, refers: pd.Series, targets: pd.Series, block_labels: pd.Series, payload_labels: pd.Series, kinds: pd.Series, errors: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    """All that verification needs from Python, in one transfer."""
    return pd.DataFrame({"ip_ok": ip_is_valid.func(ips), "refers_ok": url_is_valid.func(refers), "target_ok": url_is_valid.func(targets), "digest": _digest_problems.func(block_labels, payload_labels, kinds, errors, blocks)}).astype(object)


_survey = _survey.asNondeterministic()  # one evaluation, though several columns come from it


def _digest_inputs(checks) -> tuple[Column, ...]:
    """What the digest rules need of a record (with content_kind and content_error); without such a field its block doesn't leave the JVM."""
    none = F.array().cast("array<string>")
    block = get_all_fields("fields", "WARC-Block-Digest") if "block-digest" in checks else none
    payload = get_all_fields("fields", "WARC-Payload-Digest") if "payload-digest" in checks else none
    return block, payload, F.col("content_kind"), F.col("content_error"), F.when((F.size(block) > 0) | (F.size(payload) > 0), F.col("block"))


def digest_problems(records: DataFrame, checks=CHECKS) -> DataFrame:
    """Problems of block and payload digests."""
    from .extract import with_content

    r = with_content(records).select(field_or_empty("fields", "WARC-Record-ID").alias("record_id"), "file", "record_index", F.explode(_digest_problems(*_digest_inputs(checks))).alias("p"))
    return _shape(r.select(*_RID, "p.*"))


# ---- references and segments


def _referred(checks) -> Column:
    """The references of a record that the enabled checks follow, as an array of (target, kind)."""
    typ = field_or_empty("fields", "WARC-Type")
    kinds = (
        ("concurrent-to", "WARC-Concurrent-To", ~typ.isin("warcinfo", "conversion", "continuation")),
        ("refers-to", "WARC-Refers-To", ~typ.isin("continuation", "request", "resource", "response", "warcinfo")),
        ("warcinfo-id", "WARC-Warcinfo-ID", typ != "warcinfo"),
    )
    none = F.array().cast("array<struct<target: string, kind: string>>")
    parts = [F.when(cond, F.transform(get_all_fields("fields", name), lambda v, n=check: F.struct(v.alias("target"), F.lit(n).alias("kind")))).otherwise(none) for check, name, cond in kinds if check in checks]
    return F.concat(*parts) if parts else none


def references(records: DataFrame, checks=CHECKS) -> DataFrame:
    """(record_id, target, kind) of every reference that the enabled checks follow."""
    return _references(records.select(field_or_empty("fields", "WARC-Record-ID").alias("record_id"), _referred(checks).alias("refs")))


def _references(slim: DataFrame) -> DataFrame:
    return slim.select("record_id", F.explode("refs").alias("r")).select("record_id", "r.target", "r.kind").distinct()


def dangling(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """References whose target no record has: refs(record_id, target) against ids(record_id)."""
    return refs.join(ids.select(F.col("record_id").alias("target")), "target", "left_anti")


def _segment() -> Column:
    """(number, origin, length, total) of a record that is a segment, else null."""
    rid = field_or_empty("fields", "WARC-Record-ID")
    number = u64_strict(field_or_empty("fields", "WARC-Segment-Number"))
    origin = F.when(number == 1, rid).otherwise(field_or_empty("fields", "WARC-Segment-Origin-ID"))
    total = F.when(number != 1, u64_strict(field_or_empty("fields", "WARC-Segment-Total-Length")))
    row = F.struct(number.alias("number"), origin.alias("origin"), F.col("content_length").alias("length"), total.alias("total"))
    return F.when(has_field("fields", "WARC-Segment-Number") & number.isNotNull(), row)


def segment_rows(records: DataFrame) -> DataFrame:
    """file, record_index, number, origin, length, total of the records that are segments."""
    return _segments(records.select("file", "record_index", _segment().alias("segment")))


def _segments(slim: DataFrame) -> DataFrame:
    return slim.where("segment IS NOT NULL").select("file", "record_index", "segment.*")


#: Segment numbers that the scan of an origin covers, the last not included.
FIRST_SEGMENT, LAST_SEGMENT = 1, (1 << 64) - 1


def segments_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, number, length) and (origin, total), the last in order of each key. Number 0 is no segment of an origin."""
    at = F.struct("file", "record_index")
    counted = rows.where((F.col("number") >= FIRST_SEGMENT) & (F.col("number") < F.lit(str(LAST_SEGMENT)).cast("decimal(20,0)")))
    segments = counted.groupBy("origin", "number").agg(F.max_by("length", at).alias("length"))
    totals = rows.where("total IS NOT NULL").groupBy("origin").agg(F.max_by("total", at).alias("total"))
    return segments, totals


def missing_segments(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """(origin, number): the first missing number of each gap, for origins whose total length is declared."""
    w = W.partitionBy("origin").orderBy("number")
    before = F.lag("number", 1, 0).over(w)
    return segments.join(totals.select("origin"), "origin", "left_semi").withColumn("before", before).where("number <> before + 1").select("origin", (F.col("before") + 1).alias("number"))


def segment_lengths(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """(origin, expect, actual) where the segments' lengths don't add up to the declared total."""
    sums = segments.groupBy("origin").agg(F.sum("length").alias("actual"))
    return totals.join(sums, "origin", "left").select("origin", F.col("total").alias("expect"), F.coalesce("actual", F.lit(0)).alias("actual")).where("expect <> actual")


def rat_faults(records: DataFrame) -> DataFrame:
    """A problem for each file that holds several records in one compressed member, at its last record."""
    last = F.max_by(F.col("record_id") if "record_id" in records.columns else field_or_empty("fields", "WARC-Record-ID"), "record_index")
    found = records.groupBy("file").agg(F.max("rat_fault").alias("fault"), last.alias("record_id"), F.max("record_index").alias("record_index")).where("fault")
    return _shape(found.select("record_id", F.lit("NotRecordAtTimeCompression").alias("kind"), "file", "record_index", F.lit(5000).alias("ord")))


def survey(records: DataFrame, checks=CHECKS, own: bool = False) -> DataFrame:
    """What verification needs of each record, in one pass: record_id, file, record_index, rat_fault, refs, segment; with
    `own` also the record's own problems (header, digest). Blocks are read by the digest rules alone."""
    columns = [field_or_empty("fields", "WARC-Record-ID").alias("record_id"), F.col("file"), F.col("record_index"), F.col("rat_fault") if "rat_fault" in records.columns else F.lit(False).alias("rat_fault"), _referred(checks).alias("refs"), _segment().alias("segment")]
    if own:
        from .extract import with_content

        own_ = _survey(_header("WARC-IP-Address"), _header("WARC-Refers-To-Target-URI"), unbracketed(_header("WARC-Target-URI")), *_digest_inputs(checks))
        records = _with_headers(with_content(records)).withColumn("_own", own_).withColumns({f"_{c}": F.col(f"_own.{c}") for c in ("ip_ok", "refers_ok", "target_ok")})
        columns += [_found(checks).alias("header"), F.col("_own.digest").alias("digest")]
    return records.select(*columns)


def own_problems(slim: DataFrame, checks=CHECKS) -> DataFrame:
    """The problems that records and files have by themselves, from a survey with `own`."""
    out = [_exploded(slim, c) for c in ("header", "digest") if c in slim.columns]
    if "record-at-time-compression" in checks:
        out.append(rat_faults(slim))
    return reduce(DataFrame.unionByName, out)


@dataclass
class State:
    """What verification keeps of earlier runs: ids, references and segments."""

    ids: DataFrame
    refs: DataFrame
    segments: DataFrame

    @classmethod
    def of(cls, records: DataFrame, checks=CHECKS) -> State:
        return cls.of_survey(survey(records, checks))

    @classmethod
    def of_survey(cls, slim: DataFrame) -> State:
        return cls(slim.select("record_id").distinct(), _references(slim), _segments(slim))

    def union(self, other: State) -> State:
        return State(self.ids.unionByName(other.ids).distinct(), self.refs.unionByName(other.refs).distinct(), self.segments.unionByName(other.segments))

    def save(self, path: str, mode: str = "append") -> None:
        for name in ("ids", "refs", "segments"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> State:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("ids", "refs", "segments")))


def state_problems(state: State, checks=CHECKS) -> DataFrame:
    """Dangling references, missing segments and wrong total lengths over all that the state holds."""
    null = F.lit(None).cast("string")
    nowhere = (null.alias("file"), F.lit(None).cast("long").alias("record_index"))
    lost = _shape(dangling(state.refs, state.ids).select("record_id", F.lit("ReferencedRecordMissing").alias("kind"), F.col("target").alias("arg"), *nowhere, F.lit(6000).alias("ord")).distinct())
    out = [lost]
    if "segment" in checks:
        segments, totals = segments_of(state.segments)
        out.append(_shape(missing_segments(segments, totals).select(F.col("origin").alias("record_id"), F.lit("MissingSegment").alias("kind"), F.col("number").cast("string").alias("arg"), *nowhere, F.lit(6001).alias("ord"))))
        out.append(_shape(segment_lengths(segments, totals).select(F.col("origin").alias("record_id"), F.lit("MismatchedSegmentLength").alias("kind"), F.col("expect").cast("string").alias("expected"), F.col("actual").cast("string").alias("actual"), *nowhere, F.lit(6002).alias("ord"))))
    return reduce(DataFrame.unionByName, out)


def verify(records: DataFrame, exclude=(), state_path: str | None = None) -> DataFrame:
    """All problems of the records. With state_path, references and segments are checked against earlier runs' too, and kept."""
    unknown = set(exclude) - set(CHECKS)
    if unknown:
        raise ValueError(f"no such check: {', '.join(sorted(unknown))}")
    checks = tuple(c for c in CHECKS if c not in exclude)
    # the archive is scanned once; all that follows reads the short rows of this table
    slim = cut(survey(records, checks, own=True), "verify")
    state = State.of_survey(slim)
    if state_path:
        state.save(state_path)
        state = State.load(records.sparkSession, state_path)
        state = State(state.ids.distinct(), state.refs.distinct(), state.segments)
    return own_problems(slim, checks).unionByName(state_problems(state, checks))


def in_order(problems: DataFrame) -> DataFrame:
    return problems.orderBy(F.col("file").asc_nulls_last(), "record_index", "ord", "record_id")


_BARE = ("InvalidSegment", "NotRecordAtTimeCompression")


def to_json_text(problems: DataFrame) -> Column:
    """{"record_id":…,"kind":…} with the kind bare, with one value, or with named ones."""
    kind = F.col("kind")
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    body = F.when(kind.isin(*_BARE), quote(kind))
    body = body.when(kind.isin("DigestMismatch", "PayloadDigestMismatch"), F.concat(F.lit("{"), quote(kind), F.lit(":"), F.to_json(F.struct("algorithm", "expected", "actual")), F.lit("}")))
    body = body.when(kind == "MismatchedSegmentLength", F.concat(F.lit("{"), quote(kind), F.lit(':{"expect":'), F.col("expected"), F.lit(',"actual":'), F.col("actual"), F.lit("}}")))
    body = body.when(kind == "MissingSegment", F.concat(F.lit("{"), quote(kind), F.lit(":"), F.col("arg"), F.lit("}")))
    body = body.otherwise(F.concat(F.lit("{"), quote(kind), F.lit(":"), quote(F.coalesce("arg", F.lit(""))), F.lit("}")))
    return F.concat(F.lit('{"record_id":'), quote(F.col("record_id")), F.lit(',"kind":'), body, F.lit("}"))
