"""decode(): a text column to a typed column with an error column.

Built-in parsing takes the documents on which it is provably exact: valid ones whose value types, read off the parsed
variant, fit the schema without any of the parser's own conversions. All other documents go whole to the codec, as do
schemas with kinds that built-ins lack (raw text, number text, hooks, unsigned widths, quoted scalars).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import ERROR_DDL, InvalidTargetError
from ..functions.text import col, time_value, whole, wrapped
from ..options import DecodeOptions
from ..schema import Record, check, plain
from . import codec

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
#: Microseconds of the years 1 to 9999.
_YEARS = (-62135596800000000, 253402300799999999)
_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_INTEGERS = {T.ByteType: (-(1 << 7), (1 << 7) - 1), T.ShortType: (-(1 << 15), (1 << 15) - 1), T.IntegerType: (-(1 << 31), (1 << 31) - 1), T.LongType: None}


def _native_type(dtype: T.DataType, meta: dict) -> bool:
    if meta:
        return False
    if isinstance(dtype, T.StructType):
        return all(_NAME.fullmatch(f.name) and _native_type(f.dataType, {k: v for k, v in f.metadata.items() if k != "json.omitempty"}) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _native_type(dtype.elementType, {})
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) and _native_type(dtype.valueType, {})
    return isinstance(dtype, (T.BooleanType, T.DoubleType, T.FloatType, T.StringType, T.TimestampType, T.BinaryType, *_INTEGERS))


def native_schema(dtype: T.DataType) -> bool:
    """Whether built-in parsing may be used for documents of this schema at all."""
    if isinstance(dtype, T.StructType):
        return len(dtype) > 0 and _native_type(dtype, {}) and len({f.name.lower() for f in dtype}) == len(dtype)
    return isinstance(dtype, (T.MapType, T.ArrayType)) and _native_type(dtype, {})


def _wide(dtype: T.DataType) -> T.DataType:
    """The schema with every integer as a long and every float as a double, so that no narrow type wraps around, and with
    times and bytes as text."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _wide(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_wide(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _wide(dtype.valueType))
    if isinstance(dtype, (T.TimestampType, T.BinaryType)):
        return T.StringType()
    return T.LongType() if type(dtype) in _INTEGERS else T.DoubleType() if isinstance(dtype, T.FloatType) else dtype


def _pattern(dtype: T.DataType) -> str:
    """schema_of_variant()'s text for values that need no conversion."""
    if isinstance(dtype, T.StructType):
        # fields come in the order of their bytes, and may be missing
        parts = [f"(?:{f.name}: {_pattern(f.dataType)}(?:, |(?=>)))?" for f in sorted(dtype, key=lambda f: f.name.encode())]
        return "(?:VOID|OBJECT<" + "".join(parts) + ">)"
    if isinstance(dtype, T.ArrayType):
        return f"(?:VOID|ARRAY<{_pattern(dtype.elementType)}>)"
    if isinstance(dtype, T.BooleanType):
        return "(?:VOID|BOOLEAN)"
    if isinstance(dtype, T.MapType):
        return rf"(?:VOID|OBJECT<(?:(?:\w++|`(?:[^`]|``)*+`): {_pattern(dtype.valueType)}(?:, |(?=>)))*+>)"
    if isinstance(dtype, (T.StringType, T.TimestampType, T.BinaryType)):
        return "(?:VOID|STRING)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return r"(?:VOID|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
    return "(?:VOID|BIGINT)"


def _skips(dtype: T.StructType, fold: bool) -> tuple[str, str | None]:
    """Patterns of a shape that has a field's key with an unfit value, or one that differs from a field's in case only.
    They look at every key, nested ones too: what they find by mistake goes to the codec."""
    bad = "|".join(f"{f.name}: (?!{_pattern(f.dataType)}[,>])" for f in dtype)
    names = "|".join(f.name for f in dtype)
    return f"[<, ]`?(?:{bad})", rf"[<, ](?!(?:{names}): )(?i:`?(?:{names})`?: )" if fold else None


def _fits(x: Column, dtype: T.DataType) -> Column:
    """Whether the numbers of a widened value lie in their own type's range, its times and bytes are well-formed, and no
    map has a key twice."""
    if isinstance(dtype, T.StructType):
        out = F.lit(True)
        for f in dtype:
            if _narrow(f.dataType):
                out = out & _fits(x[f.name], f.dataType)
        return out
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.forall(x, lambda e: _fits(e, dtype.elementType)), F.lit(True))
    if isinstance(dtype, T.MapType):
        once = F.size(F.array_distinct(F.map_keys(x))) == F.size(F.map_keys(x))
        inner = F.forall(F.map_values(x), lambda e: _fits(e, dtype.valueType)) if _narrow(dtype.valueType) else F.lit(True)
        return F.coalesce(once & inner, F.lit(True))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.abs(x.cast(dtype)) != float("inf"), F.lit(True))
    if isinstance(dtype, T.TimestampType):
        return x.isNull() | F.coalesce(F.unix_micros(time_value(x)).between(*_YEARS), F.lit(False))
    if isinstance(dtype, T.BinaryType):
        return x.isNull() | x.rlike(_BASE64)
    lo, hi = _INTEGERS[type(dtype)]
    return F.coalesce(x.between(lo, hi), F.lit(True))


def _narrow(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_narrow(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _narrow(dtype.elementType)
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.TimestampType, T.BinaryType, T.MapType)) or bool(_INTEGERS.get(type(dtype)))


def _finished(x: Column, dtype: T.DataType) -> Column:
    """A widened value in its own type."""
    if not _changes(dtype):
        return x.cast(_plainly(dtype))
    if isinstance(dtype, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_finished(x[f.name], f.dataType).alias(f.name) for f in dtype]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(x, lambda e: _finished(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        zero = isinstance(dtype.valueType, (T.IntegerType, T.LongType))  # null values of integer maps are stored as zero
        return F.transform_values(x, lambda _, e: F.coalesce(e, F.lit(0)).cast(dtype.valueType) if zero else _finished(e, dtype.valueType))
    return time_value(x) if isinstance(dtype, T.TimestampType) else F.unbase64(x)


def _changes(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_changes(f.dataType) for f in dtype)
    return _changes(dtype.elementType) if isinstance(dtype, T.ArrayType) else isinstance(dtype, (T.TimestampType, T.BinaryType, T.MapType))


def _codec(s: Column, dtype: T.DataType, options: DecodeOptions) -> Column:
    """The codec over a text column: struct<value, error>, null for a null document."""
    hooks = dict(codec.HOOKS)
    variant = _has_variant(dtype)
    out_type = _no_variant(dtype) if variant else _plainly(dtype)
    arrow = pa.struct([("value", to_arrow_type(out_type)), ("error", to_arrow_type(T.StructType.fromDDL(f"e {ERROR_DDL}")[0].dataType))])

    def run(x: pa.Array) -> pa.Array:
        codec.HOOKS.update(hooks)
        reader = codec.Reader(dtype, options)
        return pa.array([None if v is None else dict(zip(("value", "error"), reader.read(v))) for v in x.to_pylist()], arrow)

    return F.arrow_udf(run, _answer(out_type))(s)


def _answer(dtype: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("value", dtype), T.StructField("error", T.StructType.fromDDL(f"e {ERROR_DDL}")[0].dataType)])


def _has_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_variant(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _has_variant(dtype.elementType)
    return isinstance(dtype, T.VariantType) or isinstance(dtype, T.MapType) and _has_variant(dtype.valueType)


def _no_variant(dtype: T.DataType) -> T.DataType:
    """Dynamic parts leave the codec as text and are parsed afterwards."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _no_variant(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_no_variant(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _no_variant(dtype.valueType))
    return T.StringType() if isinstance(dtype, T.VariantType) else dtype


def _revive(x: Column, dtype: T.DataType) -> Column:
    if not _has_variant(dtype):
        return x
    if isinstance(dtype, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_revive(x[f.name], f.dataType).alias(f.name) for f in dtype]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(x, lambda e: _revive(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(x, lambda _, v: _revive(v, dtype.valueType))
    return F.try_parse_json(x)


def decode(c: "Column | str", schema: "T.DataType | Record | str", options: DecodeOptions = DecodeOptions()) -> Column:
    """struct<value, error> of each document. A syntax error leaves no value; at a mismatch the first error is kept, its
    field is null and the others are decoded. The error is null where all is well; a null document has neither."""
    dtype = plain(schema)
    if not isinstance(dtype, T.DataType):
        raise InvalidTargetError(f"can't decode into {schema!r}")
    check(dtype)
    s = col(c)
    out_type = _answer(_plainly(dtype))
    none = F.struct(F.lit(None).cast(_plainly(dtype)).alias("value"), F.lit(None).cast(ERROR_DDL).alias("error"))
    if not options.native or options.zero_fill or options.use_number or not native_schema(dtype):
        got = _codec(s, dtype, options)
        if _has_variant(dtype):
            got = F.when(got.isNotNull(), F.struct(_revive(got["value"], dtype).alias("value"), got["error"].alias("error")))
        return F.coalesce(got, none)
    w = wrapped(s)
    v = F.try_variant_get(w, "$[0]", "variant")
    shape = F.schema_of_variant(v)
    fits = shape.rlike(f"^{_pattern(dtype)}$") & (shape != "VOID")
    # or other keys beside the schema's, which are skipped
    if isinstance(dtype, T.StructType):
        bad, folded = _skips(dtype, options.fold_keys)
        loose = shape.startswith("OBJECT<") & ~shape.rlike(bad)
        fits = fits | (loose & ~shape.rlike(folded) if folded else loose)
    # escapes of lone surrogates are parsed, but not as they should be
    clean = ~s.contains("\\ud") & ~s.contains("\\uD") & whole(w) & fits
    typed = F.from_json(s, _wide(dtype), _STRICT)
    if _narrow(dtype):
        clean = clean & _fits(typed, dtype)
    # the codec sees only what isn't clean, and its answer alone tells later on which documents those were
    other = _codec(F.when(~F.coalesce(clean, F.lit(False)), s), dtype, options)
    native = F.struct(_finished(typed, dtype).alias("value"), F.lit(None).cast(ERROR_DDL).alias("error"))
    return F.when(s.isNull(), none.cast(out_type)).otherwise(F.coalesce(other.cast(out_type), native.cast(out_type)))


def _plainly(dtype: T.DataType) -> T.DataType:
    """The type without its fields' metadata."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plainly(f.dataType)) for f in dtype])
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _plainly(dtype.valueType))
    return T.ArrayType(_plainly(dtype.elementType)) if isinstance(dtype, T.ArrayType) else dtype


def fixed_array(c: "Column | str", n: int, zero: object = 0) -> Column:
    """An array of exactly n elements: cut, or filled up with zeros."""
    return F.slice(F.concat(col(c), F.array_repeat(F.lit(zero), n)), 1, n)


def decode_into(previous: "Column | str", c: "Column | str", schema: "T.DataType | Record | str", options: DecodeOptions = DecodeOptions()) -> Column:
    """decode(), on top of an earlier value: what is missing or null keeps its previous value, records are merged field
    by field and maps key by key, arrays are replaced. A document with a syntax error leaves the previous value."""
    dtype = plain(schema)
    got = decode(c, dtype, options)
    return F.struct(_merged(col(previous), got["value"], dtype).alias("value"), got["error"].alias("error"))


def _merged(old: Column, new: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        both = F.struct(*[_merged(old[f.name], new[f.name], f.dataType).alias(f.name) for f in dtype])
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both)
    if isinstance(dtype, T.MapType):
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a)))
    return F.coalesce(new, old)
