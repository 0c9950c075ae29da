"""encode(): a typed column to JSON text, assembled from built-in expressions field by field.

Only strings with rare control characters, doubles of many digits, hooks and pretty printing call Arrow functions. Fields
come in declaration order, nulls are written, omitempty fields vanish when they are zero.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERROR_DDL, UnsupportedTypeError
from ..functions.text import col, escape, float_text, indent, json_quote, time_text
from ..options import EncodeOptions
from ..schema import Record, check, plain
from . import codec



def _zero(x: Column, dtype: T.DataType, meta: dict) -> Column:
    if isinstance(dtype, T.StructType) or meta.get("json.fixed") is not None:
        return x.isNull()
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    if isinstance(dtype, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(dtype, T.BinaryType):
        return x.isNull() | (F.octet_length(x) == 0)
    if isinstance(dtype, T.BooleanType):
        return x.isNull() | ~x
    return x.isNull() | (x == 0) if isinstance(dtype, T.NumericType) else x.isNull()


def _hook(x: Column, name: str, dtype: T.DataType) -> Column:
    hooks = dict(codec.HOOKS)
    field = T.StructField("v", dtype, True, {"json.kind": f"hook:{name}"})

    def run(a: pa.Array) -> pa.Array:
        codec.HOOKS.update(hooks)
        writer = codec.Writer(dtype, EncodeOptions())
        return pa.array([writer.write(v, field.metadata)[0] for v in a.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(x)


def _text(x: Column, dtype: T.DataType, meta: dict, options: EncodeOptions, depth: int) -> Column:
    kind = str(meta.get("json.kind", ""))
    if kind.startswith("hook:"):
        return _hook(x, kind[5:], dtype)
    if kind == "raw":
        return F.when(x.isNull() | (x == ""), F.lit("null")).otherwise(x)
    quoted = (lambda t: F.concat(F.lit('"'), t, F.lit('"'))) if meta.get("json.string") else (lambda t: t)
    if kind == "number":
        out = quoted(F.when(x == "", F.lit("0")).otherwise(x))
    elif isinstance(dtype, T.BooleanType) or isinstance(dtype, (T.IntegralType, T.DecimalType)):
        out = quoted(x.cast("string"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = quoted(float_text(x, isinstance(dtype, T.FloatType), options.float_exp_auto))
        return F.when(x.isNull(), F.lit("null")).otherwise(out)  # NaN and infinities stay null: an error
    elif isinstance(dtype, T.StringType):
        out = json_quote(x, options)
        out = json_quote(out, EncodeOptions()) if meta.get("json.string") else out
    elif isinstance(dtype, T.BinaryType):
        out = F.concat(F.lit('"'), F.base64(x), F.lit('"'))
        out = F.replace(out, F.lit("\r\n"), F.lit(""))
    elif isinstance(dtype, T.TimestampType):
        return F.when(x.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), time_text(x), F.lit('"')))
    elif isinstance(dtype, T.VariantType):
        out = escape(F.to_json(x), options)
    elif isinstance(dtype, T.StructType):
        return F.when(x.isNull(), F.lit("null")).otherwise(_object(x, dtype, options, depth))
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(x, lambda e: _text(e, dtype.elementType, {}, options, depth + 1))
        out = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
        out = F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None)).otherwise(out) if _fails(dtype.elementType) else out
    elif isinstance(dtype, T.MapType):
        parts = F.transform(F.map_entries(x), lambda e: F.concat(json_quote(e["key"].cast("string"), options), F.lit(":"), _text(e["value"], dtype.valueType, {}, options, depth + 1)))
        out = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
        out = F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None)).otherwise(out) if _fails(dtype.valueType) else out
    else:
        raise UnsupportedTypeError(f"unsupported type {dtype.simpleString()}")
    return F.when(x.isNull(), F.lit("null")).otherwise(out)


def _object(x: Column, dtype: T.StructType, options: EncodeOptions, depth: int) -> Column:
    if options.max_depth is not None and depth >= options.max_depth:
        raise UnsupportedTypeError(f"nested deeper than {options.max_depth}")
    parts, whole = [], F.lit(True)
    if dtype and not any(f.metadata.get("json.omitempty") for f in dtype):  # a null among the parts makes all of it null
        for f in dtype:
            parts += [F.lit(("," if parts else "{") + codec.quote(f.name) + ":"), _text(x[f.name], f.dataType, f.metadata, options, depth + 1)]
        return F.concat(*parts, F.lit("}"))
    for f in dtype:
        v = x[f.name]
        text = _text(v, f.dataType, f.metadata, options, depth + 1)
        part = F.concat(F.lit(codec.quote(f.name) + ":"), text)
        if f.metadata.get("json.omitempty"):
            gone = _zero(v, f.dataType, f.metadata)
            parts.append(F.when(~gone, part))
            if _fails(f.dataType, f.metadata):
                whole = whole & (gone | text.isNotNull())
        else:
            parts.append(part)
            if _fails(f.dataType, f.metadata):
                whole = whole & text.isNotNull()
    out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")
    return F.when(whole, out) if _fails(dtype) else out


def _fails(dtype: T.DataType, meta: dict = {}) -> bool:
    """Whether a value of this type can have no JSON form."""
    if str(meta.get("json.kind", "")).startswith("hook:"):
        return True
    if isinstance(dtype, T.StructType):
        return any(_fails(f.dataType, f.metadata) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _fails(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _fails(dtype.valueType)
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.TimestampType))


def _loops(dtype: T.DataType) -> bool:
    """Whether an Arrow function would stand inside a lambda, which Spark doesn't allow."""
    if isinstance(dtype, T.StructType):
        return any(f.metadata.get("json.keys") is not None or _loops(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _calls(dtype.elementType, {})
    return isinstance(dtype, T.MapType) and _calls(dtype.valueType, {})


def _calls(dtype: T.DataType, meta: dict) -> bool:
    """Whether a value's text takes an Arrow function."""
    if str(meta.get("json.kind", "")).startswith("hook:") or meta.get("json.keys"):
        return True
    if isinstance(dtype, T.StructType):
        return any(_calls(f.dataType, f.metadata) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _calls(dtype.elementType, {})
    return _calls(dtype.valueType, {}) if isinstance(dtype, T.MapType) else isinstance(dtype, (T.FloatType, T.DoubleType))


def _portable(x: Column, dtype: T.DataType) -> Column:
    """The value as an Arrow function can take it: variants as their text, times in microseconds (a year beyond 9999 is
    none of Python's)."""
    if isinstance(dtype, T.VariantType):
        return F.to_json(x)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(x)
    if isinstance(dtype, T.StructType) and _foreign(dtype):
        return F.when(x.isNotNull(), F.struct(*[_portable(x[f.name], f.dataType).alias(f.name) for f in dtype]))
    if isinstance(dtype, T.ArrayType) and _foreign(dtype):
        return F.transform(x, lambda e: _portable(e, dtype.elementType))
    return F.transform_values(x, lambda _, v: _portable(v, dtype.valueType)) if isinstance(dtype, T.MapType) and _foreign(dtype) else x


def _foreign(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_foreign(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _foreign(dtype.elementType)
    return _foreign(dtype.valueType) if isinstance(dtype, T.MapType) else isinstance(dtype, (T.VariantType, T.TimestampType))


def encode(c: "Column | str", schema: "T.DataType | Record | str", options: EncodeOptions = EncodeOptions()) -> Column:
    """JSON text of each value; null where the value has none (NaN, an infinity, a year beyond 9999)."""
    dtype = plain(schema)
    check(dtype)
    x = col(c)
    out = _codec(x, dtype, options)["text"] if _loops(dtype) else _text(x, dtype, {}, options, 0)
    return indent(out, options.prefix, options.indent) if options.indent else out


def encode_checked(c: "Column | str", schema: "T.DataType | Record | str", options: EncodeOptions = EncodeOptions()) -> Column:
    """struct<text, error> by the codec: why a value has no text."""
    dtype = plain(schema)
    check(dtype)
    return _codec(col(c), dtype, options)


def _codec(x: Column, dtype: T.DataType, options: EncodeOptions) -> Column:
    hooks = dict(codec.HOOKS)
    error = pa.struct([("kind", pa.string()), ("message", pa.string()), ("offset", pa.int32()), ("value", pa.string()), ("target", pa.string()), ("field", pa.string())])
    arrow = pa.struct([("text", pa.string()), ("error", error)])

    def run(a: pa.Array) -> pa.Array:
        codec.HOOKS.update(hooks)
        writer = codec.Writer(dtype, options)
        return pa.array([dict(zip(("text", "error"), writer.write(v))) for v in a.to_pylist()], arrow)

    return F.arrow_udf(run, f"struct<text: string, error: {ERROR_DDL}>")(_portable(x, dtype))


def append_encode(prefix: "Column | str", c: "Column | str", schema: "T.DataType | Record | str", options: EncodeOptions = EncodeOptions()) -> Column:
    """prefix with the value's JSON behind it; prefix alone where the value has none."""
    return F.concat(col(prefix), F.coalesce(encode(c, schema, options), F.lit("")))


def encode_indent(c: "Column | str", schema: "T.DataType | Record | str", prefix: str = "", step: str = "  ", options: EncodeOptions = EncodeOptions()) -> Column:
    return encode(c, schema, options.but(prefix=prefix, indent=step))
