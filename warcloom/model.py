"""Schemas of the tables that the engine passes around. Built without a session, so that importing needs none."""

from pyspark.sql import types as T

STRING, BINARY, LONG, INT, DOUBLE, BOOLEAN = T.StringType(), T.BinaryType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
#: Unsigned 64-bit numbers.
U64 = T.DecimalType(20, 0)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


def array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


FIELDS = array(struct(name=STRING, value=STRING))
ERROR = struct(kind=STRING, position=LONG, snippet=STRING)
SUMS = struct(crc32=LONG, crc32c=LONG, xxh3=U64)

#: One row for each record of an archive file.
RECORDS = struct(file=STRING, position=LONG, record_index=LONG, version=STRING, fields=FIELDS, content_length=LONG, block=BINARY, rat_fault=BOOLEAN, _error=ERROR)

#: One row for each broken rule: kind, arg and the rest give the problem; file, record_index and ord its place.
PROBLEMS = struct(record_id=STRING, kind=STRING, arg=STRING, algorithm=STRING, expected=STRING, actual=STRING, file=STRING, record_index=LONG, ord=INT)

MESSAGE_KINDS = ("Metadata", "Header", "BlockChunk", "BlockEnd", "ExtractMetadata", "ExtractChunk", "ExtractEnd", "EndOfFile")
#: One row for each message of an export; the struct of its kind is set, the others are null.
MESSAGES = struct(
    file=STRING,
    record_index=LONG,
    seq=LONG,
    kind=STRING,
    Metadata=struct(file=STRING, position=LONG),
    Header=struct(version=STRING, fields=FIELDS),
    BlockChunk=struct(data=BINARY),
    BlockEnd=SUMS,
    ExtractMetadata=struct(has_content=BOOLEAN, file_path_components=array(STRING), is_truncated=BOOLEAN),
    ExtractChunk=struct(data=BINARY),
    ExtractEnd=SUMS,
)
