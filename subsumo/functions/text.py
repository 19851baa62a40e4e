"""Values as text.

Values are compared as raw text, so ``1`` and ``1.0`` differ. Typed columns are cast with
Spark's own cast, which is injective for every atomic type: rounding to a fixed number
of digits would merge different doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest value, in bytes, that is grouped by its text itself. A longer one is grouped
#: by the SHA-256 digest of its whole text in base64 (44 characters) followed by its length,
#: which is always longer than this and can therefore never equal a short value.
LONGEST_PLAIN_KEY = 44

_ATOMIC = (
    T.StringType, T.CharType, T.VarcharType, T.BooleanType, T.NumericType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType,
)


def value_text(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    if isinstance(data_type, _ATOMIC):
        return column.cast("string")
    if isinstance(data_type, (T.ArrayType, T.StructType)) and not _has_map(data_type):
        # JSON keeps elements apart, whatever their texts hold.
        return F.when(column.isNotNull(), F.to_json(column, {"ignoreNullFields": "false"}))
    raise ValueError(f"{data_type.simpleString()} columns have no value text, as equal maps may be written differently")


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (*_ATOMIC, T.BinaryType))


def has_digest(data_type: T.DataType) -> bool:
    """Whether texts of this type can be long."""
    return isinstance(data_type, (T.StringType, T.BinaryType, T.ArrayType, T.StructType))


def group_key(text: Column, data_type: T.DataType, digest_long: bool = True) -> Column:
    """The text to group by, a function of the value alone."""
    if not digest_long or not has_digest(data_type):
        return text
    size = F.octet_length(text)
    digest = F.base64(F.unhex(F.sha2(text, 256)))
    return F.when(size > LONGEST_PLAIN_KEY, F.concat(digest, F.lit(":"), size)).otherwise(text)
