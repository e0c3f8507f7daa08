"""Type families, declared type names and the id-as-string rule."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGER, FLOAT, NUMERIC = "INTEGER", "FLOAT", "NUMERIC"
STRING, BOOLEAN, BYTES = "STRING", "BOOLEAN", "BYTES"
DATE, TIMESTAMP, DATETIME = "DATE", "TIMESTAMP", "DATETIME"
ARRAY, RECORD, OTHER = "ARRAY", "RECORD", "OTHER"

NUMBER_KINDS = frozenset({INTEGER, FLOAT, NUMERIC})
TIME_KINDS = frozenset({DATE, TIMESTAMP, DATETIME})
NESTED_KINDS = frozenset({ARRAY, RECORD, OTHER})

_KINDS = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType), FLOAT),
    ((T.DecimalType,), NUMERIC),
    ((T.StringType, T.VarcharType, T.CharType), STRING),
    ((T.BooleanType,), BOOLEAN),
    ((T.BinaryType,), BYTES),
    ((T.DateType,), DATE),
    ((T.TimestampType,), TIMESTAMP),
    ((T.TimestampNTZType,), DATETIME),
    ((T.ArrayType,), ARRAY),
    ((T.StructType, T.MapType), RECORD),
)

# Warehouse type names accepted in a declared model, and the Spark
# type each one means. BIGNUMERIC may exceed 38 digits, so it is read as double.
WAREHOUSE_TYPES = {
    "STRING": T.StringType(),
    "BYTES": T.BinaryType(),
    "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
    "INT64": T.LongType(),
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 9),
    "BIGNUMERIC": T.DoubleType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampType(),
    "JSON": T.StringType(),
}


def kind_of(data_type: T.DataType) -> str:
    for classes, kind in _KINDS:
        if isinstance(data_type, classes):
            return kind
    return OTHER


def is_floating(data_type: T.DataType) -> bool:
    return kind_of(data_type) == FLOAT


def declared_type(name: str) -> T.DataType:
    """A declared type: an upper-case warehouse name, or any Spark DDL type."""
    if name in WAREHOUSE_TYPES:
        return WAREHOUSE_TYPES[name]
    return T.DataType.fromDDL(name)


def field_type(schema: T.StructType, name: str) -> T.DataType:
    """The type of a column, resolved as Spark does: ignoring case, `a.b` nested."""
    top_level = {f.name.lower(): f.dataType for f in schema.fields}
    if name.lower() in top_level:
        return top_level[name.lower()]
    current: T.DataType = schema
    for part in name.split("."):
        fields = {f.name.lower(): f.dataType for f in getattr(current, "fields", [])}
        if part.lower() not in fields:
            raise ValueError(f"no column {name!r}; columns are {', '.join(schema.names)}")
        current = fields[part.lower()]
    return current


def is_id_name(name: str) -> bool:
    """Columns whose name contains "id", in any case, are compared as strings."""
    return "id" in name.lower()
