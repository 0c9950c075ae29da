"""Tagged schemas: field names, options and special kinds as StructField metadata.

A tag is `name,option,...`: an empty name keeps the field's, the exact tag `-` drops the field, `-,` names it "-".
Options: omitempty, string (scalars as quoted text) and copy (no effect). Kinds beyond Spark's own types are metadata
too: raw (verbatim text), number (a number's own text), unsigned width, fixed array length, time, hook.
"""

from __future__ import annotations

from dataclasses import dataclass, field as _field

from pyspark.sql import types as T

from .errors import UnsupportedTypeError

_UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
_QUOTABLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DecimalType)


@dataclass(frozen=True)
class Field:
    """A field of a record. type: a Spark type, a DDL string, or a Record."""

    name: str
    type: "T.DataType | str | Record"
    tag: str = ""
    kind: str | None = None  # raw, number, time, hook:<name>
    fixed: int | None = None
    keys: str | None = None  # a hook for a map's keys
    embedded: bool = False


@dataclass(frozen=True)
class Record:
    """Fields in order; embedded records' fields are promoted, the shallowest of a name winning and equals cancelling."""

    fields: list[Field] = _field(default_factory=list)

    def struct(self) -> T.StructType:
        found: dict[str, list[tuple[int, int, T.StructField]]] = {}
        order = 0

        def place(record: Record, depth: int) -> None:
            nonlocal order
            for f in record.fields:
                if f.tag == "-":
                    continue
                name, *options = f.tag.split(",")
                if f.embedded and isinstance(f.type, Record) and not name:
                    place(f.type, depth + 1)
                    continue
                order += 1
                built = _build(f, name or f.name, options)
                found.setdefault(built.name, []).append((depth, order, built))

        place(self, 0)
        out: list[tuple[int, T.StructField]] = []
        for rivals in found.values():
            least = min(d for d, _, _ in rivals)
            top = [(o, s) for d, o, s in rivals if d == least]
            if len(top) == 1:
                out.append(top[0])
        return T.StructType([s for _, s in sorted(out, key=lambda x: x[0])])


def unsigned(bits: int) -> T.DataType:
    """The Spark type that holds an unsigned integer; Field(kind=f"uint{bits}") adds the range check."""
    return _UNSIGNED[bits]


def _build(f: Field, name: str, options: list[str]) -> T.StructField:
    kind, dtype = f.kind, f.type
    if isinstance(dtype, Record):
        dtype = dtype.struct()
    if isinstance(dtype, str):
        if dtype.startswith("uint"):
            kind, dtype = dtype, unsigned(int(dtype[4:]))
        else:
            dtype = T.StructType.fromDDL(f"x {dtype}")[0].dataType
    meta: dict[str, object] = {}
    if "omitempty" in options:
        meta["json.omitempty"] = True
    if "string" in options and isinstance(dtype, _QUOTABLE) and kind not in ("raw", "time"):
        meta["json.string"] = True
    if kind:
        meta["json.kind"] = kind
    if f.fixed is not None:
        meta["json.fixed"] = f.fixed
    if f.keys:
        meta["json.keys"] = f.keys
    check(dtype)
    return T.StructField(name, dtype, True, meta)


def check(dtype: T.DataType) -> None:
    """Raise for types that have no JSON form here."""
    if isinstance(dtype, T.StructType):
        for f in dtype:
            check(f.dataType)
    elif isinstance(dtype, T.ArrayType):
        check(dtype.elementType)
    elif isinstance(dtype, T.MapType):
        if not isinstance(dtype.keyType, (T.StringType, T.IntegralType, T.DecimalType)):
            raise UnsupportedTypeError(f"map keys of type {dtype.keyType.simpleString()}")
        check(dtype.valueType)
    elif isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.DateType)) or isinstance(dtype, T.DecimalType) and dtype.scale:
        raise UnsupportedTypeError(f"unsupported type {dtype.simpleString()}")


def plain(schema: "T.StructType | T.DataType | Record | str") -> T.DataType:
    """A schema given as a record, DDL text or type, as a type."""
    if isinstance(schema, Record):
        return schema.struct()
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema) if ":" not in schema.split("<")[0] and " " in schema.split("<")[0].strip() else T.StructType.fromDDL(f"x {schema}")[0].dataType
    return schema
