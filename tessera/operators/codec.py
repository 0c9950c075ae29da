"""The strict codec: one document at a time in Python, called on Arrow batches where built-ins can't be exact.

Reading is RFC 8259 with nothing added. Numbers keep their text until a target type asks for a value, raw fields keep
their span, a mismatch is noted (the first one) and the rest of the record goes on, a syntax error ends the document.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from json.decoder import scanstring

import numpy as np
from pyspark.sql import types as T

from ..errors import HookError, JsonSyntaxError, JsonTypeError, UnexpectedEndError, UnsupportedValueError
from ..options import DecodeOptions, EncodeOptions

_WS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_INTEGER = re.compile(r"-?(?:0|[1-9][0-9]*)")
_LONE = re.compile(r"[\ud800-\udfff]")
_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d)")
_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}

#: name -> (decode hook, encode hook, text): see register_codec().
HOOKS: dict[str, tuple[Callable | None, Callable | None, bool]] = {}


def register_codec(name: str, decode: Callable[[str], object] | None = None, encode: Callable[[object], str] | None = None, text: bool = False) -> None:
    """Custom forms of a field of kind `hook:<name>`: decode gets the value's raw text and encode returns raw JSON; with
    text=True both deal in the content of a JSON string instead. A null is never handed to a hook."""
    HOOKS[name] = (decode, encode, text)


class Number(str):
    """A number's own text."""

    __slots__ = ()


class Raw(str):
    """A value's own text, and the place of its end in the document."""

    __slots__ = ("end",)


def _raw(text: str, a: int, b: int, base: int) -> Raw:
    out = Raw(text[a:b])
    out.end = base + b
    return out


def _refuse(word: str) -> object:
    raise JsonSyntaxError(f"invalid literal {word}")


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def _clean(s: str) -> str:
    return _LONE.sub("\ufffd", s.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass")) if _LONE.search(s) else s


def _fail(text: str, e: json.JSONDecodeError | StopIteration | RecursionError, at: int) -> JsonSyntaxError:
    pos = getattr(e, "pos", getattr(e, "value", at))
    pos = pos if isinstance(pos, int) else at
    if pos >= len(text.rstrip(" \t\n\r")) or "Unterminated" in str(e):
        return UnexpectedEndError("unexpected end of JSON input", offset=n_bytes(text))
    return JsonSyntaxError(f"invalid character {text[pos]!r}", offset=n_bytes(text[:pos]))


def n_bytes(text: str) -> int:
    """UTF-8 bytes: offsets count these."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def scan(text: str, at: int = 0) -> tuple[object, int]:
    """The value that begins at `at` (after white space) and its end. Strings are str, numbers Number."""
    at = _WS.match(text, at).end()
    if at >= len(text):
        raise UnexpectedEndError("unexpected end of JSON input", offset=n_bytes(text))
    try:
        return _DECODER.scan_once(text, at)
    except (json.JSONDecodeError, StopIteration) as e:
        raise _fail(text, e, at) from None
    except RecursionError:
        return _deep(text, at)


def _deep(text: str, at: int) -> tuple[object, int]:
    """scan() without recursion, for values nested beyond the interpreter's stack."""
    stack: list[tuple[object, str | None]] = []
    while True:
        at = _WS.match(text, at).end()
        c = text[at : at + 1]
        if c in "{[" and c:
            at = _WS.match(text, at + 1).end()
            box: object = {} if c == "{" else []
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = box, at + 1
            else:
                key = None
                if c == "{":
                    key, at = _key(text, at)
                stack.append((box, key))
                continue
        else:
            try:
                value, at = _DECODER.scan_once(text, at)
            except (json.JSONDecodeError, StopIteration) as e:
                raise _fail(text, e, at) from None
        while stack:
            box, key = stack.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = _WS.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = _WS.match(text, at + 1).end()
                key = None
                if isinstance(box, dict):
                    key, at = _key(text, at)
                stack.append((box, key))
                break
            if c == ("}" if isinstance(box, dict) else "]") and c:
                value, at = box, at + 1
                continue
            raise _fail(text, StopIteration(at), at)
        else:
            return value, at


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise _fail(text, StopIteration(at), at)
    try:
        key, at = scanstring(text, at + 1, True)
    except json.JSONDecodeError as e:
        raise _fail(text, e, at) from None
    at = _WS.match(text, at).end()
    if text[at : at + 1] != ":":
        raise _fail(text, StopIteration(at), at)
    return key, _WS.match(text, at + 1).end()


def document(text: str) -> object:
    """The one value of a document."""
    value, end = scan(text)
    end = _WS.match(text, end).end()
    if end != len(text):
        raise JsonSyntaxError(f"invalid character {text[end]!r} after top-level value", offset=n_bytes(text[:end]))
    return value


def valid(text: str | None) -> bool | None:
    """Whether a document is valid; numbers beyond a double's range make it invalid."""
    if text is None:
        return None
    try:
        todo = [document(text)]
    except JsonSyntaxError:
        return False
    while todo:
        v = todo.pop()
        if isinstance(v, Number):
            if len(v) > 300 or "e" in v or "E" in v:
                if abs(float(v)) == float("inf"):
                    return False
        elif isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
    return True


def values(text: str) -> list[tuple[str | None, dict | None]]:
    """(raw text, error) of each of the concatenated values of a text. After an error reading goes on at the first
    newline behind the failed value's start; an error without such a newline ends the text and is lost."""
    out: list[tuple[str | None, dict | None]] = []
    at = 0
    while (at := _WS.match(text, at).end()) < len(text):
        try:
            _, end = scan(text, at)
            out.append((text[at:end], None))
            at = end
        except JsonSyntaxError as e:
            line = text.find("\n", at)
            if line < 0:
                break
            out.append((None, e.row()))
            at = line + 1
    return out


def rest(text: str) -> str:
    """What values() leaves unread: the text from a malformed or unfinished last value on."""
    at = 0
    while (at := _WS.match(text, at).end()) < len(text):
        try:
            at = scan(text, at)[1]
        except JsonSyntaxError:
            line = text.find("\n", at)
            if line < 0:
                break
            at = line + 1
    return text[at:]


def members(text: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
    """(key, start, end) of the members of the object that begins at `at`, and the object's end."""
    out = []
    at = _WS.match(text, at + 1).end()
    if text[at : at + 1] == "}":
        return out, at + 1
    while True:
        key, at = _key(text, at)
        _, end = scan(text, at)
        out.append((key, at, end))
        at = _WS.match(text, end).end()
        c = text[at : at + 1]
        at = _WS.match(text, at + 1).end()
        if c == "}":
            return out, at
        if c != ",":
            raise _fail(text, StopIteration(at - 1), at - 1)


# --------------------------------------------------------------------------- decoding


def _needs_spans(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(f.metadata.get("json.kind") == "raw" or str(f.metadata.get("json.kind", "")).startswith("hook:") or _needs_spans(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _needs_spans(dtype.elementType)
    return isinstance(dtype, T.MapType) and _needs_spans(dtype.valueType)


def _spanned(text: str, at: int, base: int = 0) -> tuple[object, int]:
    """scan(), with every object's members as Raw texts to be read when they are asked for. base: the text's own place."""
    at = _WS.match(text, at).end()
    if text[at : at + 1] == "{":
        parts, end = members(text, at)
        return {k: _raw(text, a, b, base) for k, a, b in parts}, end
    if text[at : at + 1] == "[":
        _, end = scan(text, at)
        out, p = [], _WS.match(text, at + 1).end()
        while text[p] != "]":
            _, q = scan(text, p)
            out.append(_raw(text, p, q, base))
            p = _WS.match(text, q).end()
            if text[p] == ",":
                p = _WS.match(text, p + 1).end()
        return out, end
    return scan(text, at)


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, Number):
        return f"number {v}"
    return "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


_ZERO = {T.BooleanType: False, T.StringType: "", T.FloatType: 0.0, T.DoubleType: 0.0, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.DecimalType: Decimal(0)}


def fold(name: str) -> str:
    """A key without regard to case: letters fold only to letters of as many bytes, so the Kelvin sign is no k."""
    if name.isascii():
        return name.lower()
    return "".join(d if len(d := c.casefold()) == 1 and len(d.encode()) == len(c.encode()) else c for c in name)


class Reader:
    """Documents to values of a type. The first mismatch is kept in `error`."""

    def __init__(self, dtype: T.DataType, options: DecodeOptions):
        self.dtype, self.options, self.spans = dtype, options, _needs_spans(dtype)
        self.error: JsonTypeError | None = None
        self.at, self.always = 0, False  # the end of the value at hand; whether members are read by their spans

    def read(self, text: str | None) -> tuple[object, dict | None]:
        """(value, error row). A syntax error has no value; a mismatch leaves its field null."""
        if text is None:
            return None, None
        self.error = None
        try:
            tree = document(text)
            if self.spans:
                tree, _ = _spanned(text, 0)
            self.at = len(text)
            value = self.value(tree, self.dtype, {}, "")
            if self.error and not self.spans:  # again, for the place of the mismatch
                self.error, self.always = None, True
                self.value(_spanned(text, 0)[0], self.dtype, {}, "")
                self.always = False
            if self.error:
                self.error.offset = n_bytes(text[: self.error.offset])
        except JsonSyntaxError as e:
            return None, e.row()
        except HookError as e:
            return None, e.row()
        return value, self.error.row() if self.error else None

    def mismatch(self, v: object, target: str, field: str) -> None:
        if self.error is None:
            self.error = JsonTypeError.of(kind_of(v), target, field)
            self.error.offset = self.at

    def value(self, v: object, dtype: T.DataType, meta: dict, field: str) -> object:
        kind = str(meta.get("json.kind", ""))
        if kind == "raw":
            return str(v) if isinstance(v, Raw) else v
        if kind.startswith("hook:"):
            return self.hook(v, kind[5:], field)
        if isinstance(v, Raw):
            self.at = v.end
            v = _spanned(v, 0, v.end - len(v))[0] if self.always or _needs_spans(dtype) else scan(v, 0)[0]
        if meta.get("json.string") and v is not None:
            v = self.unquoted(v, dtype, field)
            if v is None:
                return None
        if v is None:
            if self.options.zero_fill and type(dtype) in _ZERO:
                return _ZERO[type(dtype)]
            return None
        if kind == "number":
            if isinstance(v, Number):
                return str(v)
            if isinstance(v, str) and _NUMBER.fullmatch(v):
                return v
            return self.mismatch(v, "number", field)
        name = kind if kind.startswith("uint") else dtype.simpleString()
        if isinstance(dtype, T.BooleanType):
            return v if isinstance(v, bool) else self.mismatch(v, name, field)
        if type(dtype) in _RANGES or isinstance(dtype, T.DecimalType):
            if isinstance(v, Number) and _INTEGER.fullmatch(v):
                n = int(v)
                if kind.startswith("uint"):
                    lo, hi = 0, (1 << int(kind[4:])) - 1
                elif isinstance(dtype, T.DecimalType):
                    lo, hi = 1 - 10**dtype.precision, 10**dtype.precision - 1
                else:
                    bits = _RANGES[type(dtype)]
                    lo, hi = -(1 << bits - 1), (1 << bits - 1) - 1
                if lo <= n <= hi and not (kind.startswith("uint") and v.startswith("-")):
                    return Decimal(n) if isinstance(dtype, T.DecimalType) else n
            return self.mismatch(v, name, field)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            if isinstance(v, Number):
                x = float(v)
                with np.errstate(over="ignore"):
                    if abs(x) != float("inf") and not (isinstance(dtype, T.FloatType) and np.isinf(np.float32(x))):
                        return x
            return self.mismatch(v, name, field)
        if isinstance(dtype, T.TimestampType):
            found = instant(v) if isinstance(v, str) and not isinstance(v, Number) else None
            return found if found is not None else self.mismatch(v, name, field)
        if isinstance(dtype, T.StringType):
            return _clean(v) if isinstance(v, str) and not isinstance(v, Number) else self.mismatch(v, name, field)
        if isinstance(dtype, T.BinaryType):
            if isinstance(v, str) and not isinstance(v, Number):
                try:
                    return base64.b64decode(v.replace("\r", "").replace("\n", ""), validate=True)
                except (binascii.Error, ValueError):
                    pass
            return self.mismatch(v, name, field)
        if isinstance(dtype, T.StructType):
            return self.record(v, dtype, field) if isinstance(v, dict) else self.mismatch(v, "struct", field)
        if isinstance(dtype, T.ArrayType):
            if not isinstance(v, list):
                return self.mismatch(v, "array", field)
            out = [self.value(x, dtype.elementType, {}, f"{field}[{i}]") for i, x in enumerate(v)]
            n = meta.get("json.fixed")
            return out if n is None else [*out[:n], *[_ZERO.get(type(dtype.elementType))] * (n - len(out))]
        if isinstance(dtype, T.MapType):
            return self.map(v, dtype, meta, field) if isinstance(v, dict) else self.mismatch(v, "map", field)
        if isinstance(dtype, T.VariantType):
            return writer_text(renumbered(v, "text") if self.options.use_number else v)
        return self.mismatch(v, name, field)

    def record(self, v: dict, dtype: T.StructType, field: str) -> dict:
        names = {f.name: f for f in dtype}
        out: dict[str, object] = {f.name: (_ZERO.get(type(f.dataType)) if self.options.zero_fill else None) for f in dtype}
        folded: dict[str, T.StructField] | None = None
        for k, x in v.items():
            f = names.get(k)
            if f is None and self.options.fold_keys:
                if folded is None:
                    folded = {}
                    for g in dtype:
                        folded.setdefault(fold(g.name), g)
                f = folded.get(fold(_clean(k)))
            if f is not None:
                out[f.name] = self.value(x, f.dataType, f.metadata, f"{field}.{f.name}" if field else f.name)
        return out

    def map(self, v: dict, dtype: T.MapType, meta: dict, field: str) -> list[tuple[object, object]]:
        out: dict[object, object] = {}
        for k, x in v.items():
            key: object = _clean(k)
            if meta.get("json.keys"):
                try:
                    key = HOOKS[meta["json.keys"]][0](key)
                except Exception as e:
                    raise HookError(f"{meta['json.keys']}: {e}", field=field) from e
            elif not isinstance(dtype.keyType, T.StringType):
                key = self.value(Number(k) if _INTEGER.fullmatch(k) else k, dtype.keyType, {}, f"{field}[{k!r}]")
                if key is None:
                    continue
            got = self.value(x, dtype.valueType, {}, f"{field}[{k!r}]")
            if x is None and isinstance(dtype.valueType, (T.IntegerType, T.LongType)):
                got = 0  # null values of integer maps are stored as zero
            out[key] = got
        return list(out.items())

    def unquoted(self, v: object, dtype: T.DataType, field: str) -> object:
        """What a quoted scalar's text holds."""
        if not isinstance(v, str) or isinstance(v, Number):
            return self.mismatch(v, f"quoted {dtype.simpleString()}", field)
        if isinstance(dtype, T.StringType):
            if v[:1] == '"':
                try:
                    inner = document(v)
                    if isinstance(inner, str) and not isinstance(inner, Number):
                        return inner
                except JsonSyntaxError:
                    pass
            return v
        try:
            inner = document(v)
        except JsonSyntaxError:
            inner = v
        if inner is None or isinstance(inner, (bool, Number)):
            return inner
        return self.mismatch(v, f"quoted {dtype.simpleString()}", field)

    def hook(self, v: object, name: str, field: str) -> object:
        decode, _, text = HOOKS[name]
        if v is None or isinstance(v, Raw) and v == "null":
            return None
        raw = str(v) if isinstance(v, Raw) else writer_text(v)
        self.at = getattr(v, "end", self.at)
        if text:
            inner = scan(raw)[0]
            if not isinstance(inner, str) or isinstance(inner, Number):
                return self.mismatch(inner, f"text of {name}", field)
            raw = _clean(inner)
        try:
            return decode(raw) if decode else raw
        except Exception as e:
            raise HookError(f"{name}: {e}", field=field) from e


def instant(text: str) -> datetime | None:
    """An RFC 3339 time, cut to microseconds."""
    m = _RFC3339.fullmatch(text)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    micro = int(((m.group(7) or "") + "000000")[:6])
    zone = m.group(8)
    shift = timedelta(0) if zone == "Z" else (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:]))
    try:
        return datetime(y, mo, d, h, mi, s, micro, timezone.utc) - shift
    except (ValueError, OverflowError):
        return None


# --------------------------------------------------------------------------- encoding

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPED = re.compile(r'["\\\x00-\x1f]')


def quote(s: str, options: EncodeOptions = EncodeOptions()) -> str:
    """A JSON string; control characters without a short form are \\u00xx in lower case."""
    out = '"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m.group()) or f"\\u{ord(m.group()):04x}", s) + '"'
    return escaped(out, options)


def escaped(text: str, options: EncodeOptions) -> str:
    """The optional escapes on finished JSON text."""
    if options.escape_html:
        text = text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    if options.escape_line_terms:
        text = text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return text


def float_text(x: float, single: bool = False, exp_auto: bool = False) -> str:
    """The shortest digits that read back as the same value: plain, or with an exponent where exp_auto asks for one."""
    if x != x or x in (float("inf"), float("-inf")):
        raise UnsupportedValueError(f"unsupported value {x}")
    shortest = str(np.float32(x)) if single else repr(float(x))
    d = Decimal(shortest)
    size = abs(np.float32(x)) if single else abs(x)
    low, high = (np.float32(1e-6), np.float32(1e21)) if single else (1e-6, 1e21)
    if exp_auto and size != 0 and (size < low or size >= high):
        sign, digits, exp = d.as_tuple()
        text = "".join(map(str, digits)).rstrip("0") or "0"
        e = exp + len(digits) - 1
        return ("-" if sign else "") + text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e):0{1 if e < 0 else 2}d}"
    text = format(d, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def renumbered(v: object, numbers: str) -> object:
    """A scanned tree with its numbers as text (strings) or in a double's notation."""
    if isinstance(v, Number):
        if numbers == "text":
            return "".join(v)
        x = repr(float(v))
        return Number(x if "e" in x or "E" in x or x in ("inf", "-inf") else x + "e0")
    if isinstance(v, dict):
        return {k: renumbered(x, numbers) for k, x in v.items()}
    return [renumbered(x, numbers) for x in v] if isinstance(v, list) else v


def writer_text(v: object) -> str:
    """Compact JSON of a scanned tree, numbers in their own text."""
    if isinstance(v, (Raw, Number)):
        return str(v)
    if isinstance(v, str):
        return quote(_clean(v))
    if isinstance(v, dict):
        return "{" + ",".join(quote(_clean(k)) + ":" + writer_text(x) for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(writer_text, v)) + "]"
    return "null" if v is None else "true" if v is True else "false"


def zero(v: object, dtype: T.DataType, meta: dict) -> bool:
    """What omitempty leaves out; records and fixed arrays never are."""
    if v is None:
        return True
    if isinstance(dtype, T.StructType) or meta.get("json.fixed") is not None:
        return False
    return v in (False, 0, "", b"", Decimal(0)) if not isinstance(v, (list, dict, tuple)) else len(v) == 0


class Writer:
    """Values of a type to JSON text."""

    def __init__(self, dtype: T.DataType, options: EncodeOptions):
        self.dtype, self.options = dtype, options

    def write(self, v: object, meta: dict = {}) -> tuple[str | None, dict | None]:
        try:
            return self.text(v, self.dtype, meta, 0), None
        except (UnsupportedValueError, HookError) as e:
            return None, e.row()

    def text(self, v: object, dtype: T.DataType, meta: dict, depth: int) -> str:
        kind = str(meta.get("json.kind", ""))
        if kind.startswith("hook:"):
            _, encode, text = HOOKS[kind[5:]]
            if v is None:
                return "null"
            try:
                out = encode(v) if encode else str(v)
            except Exception as e:
                raise HookError(f"{kind[5:]}: {e}") from e
            return quote(out, self.options) if text else out or "null"
        if kind == "raw":
            return v or "null"
        if v is None:
            return "null"
        if kind == "number":
            return self.quoted(v or "0", meta)
        if isinstance(dtype, T.BooleanType):
            return self.quoted("true" if v else "false", meta)
        if isinstance(dtype, (T.IntegralType, T.DecimalType)):
            return self.quoted(str(int(v)), meta)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return self.quoted(float_text(v, isinstance(dtype, T.FloatType), self.options.float_exp_auto), meta)
        if isinstance(dtype, T.StringType):
            out = quote(v, self.options)
            return quote(out, self.options) if meta.get("json.string") else out
        if isinstance(dtype, T.BinaryType):
            return '"' + base64.b64encode(v).decode() + '"'
        if isinstance(dtype, T.TimestampType):
            return '"' + time_text(v) + '"'
        if self.options.max_depth is not None and depth >= self.options.max_depth:
            raise UnsupportedValueError(f"nested deeper than {self.options.max_depth}")
        if isinstance(dtype, T.StructType):
            get = v.get if isinstance(v, dict) else lambda name: v[name]
            parts = []
            for f in dtype:
                x = get(f.name)
                if f.metadata.get("json.omitempty") and zero(x, f.dataType, f.metadata):
                    continue
                parts.append(quote(f.name) + ":" + self.text(x, f.dataType, f.metadata, depth + 1))
            return "{" + ",".join(parts) + "}"
        if isinstance(dtype, T.ArrayType):
            return "[" + ",".join(self.text(x, dtype.elementType, {}, depth + 1) for x in v) + "]"
        if isinstance(dtype, T.MapType):
            pairs = v.items() if isinstance(v, dict) else v
            if meta.get("json.keys"):
                try:
                    pairs = [(HOOKS[meta["json.keys"]][1](k), x) for k, x in pairs]
                except Exception as e:
                    raise HookError(f"{meta['json.keys']}: {e}") from e
            return "{" + ",".join(quote(str(k), self.options) + ":" + self.text(x, dtype.valueType, {}, depth + 1) for k, x in pairs) + "}"
        return escaped(str(v), self.options)  # a variant's own text

    def quoted(self, text: str, meta: dict) -> str:
        return f'"{text}"' if meta.get("json.string") else text


def time_text(t: datetime | int) -> str:
    """RFC 3339 with the fraction's trailing zeros cut, of a time or of microseconds since 1970."""
    earlier = 0
    if isinstance(t, int):
        day, micros = divmod(t, 86_400_000_000)
        earlier = 400 if -719_528 <= day < -719_162 else 0  # the year 0 is none of Python's; the calendar repeats after 400
        try:
            t = datetime(1970, 1, 1) + timedelta(days=day + (146_097 if earlier else 0), microseconds=micros)
        except OverflowError:
            raise UnsupportedValueError("year outside 0..9999") from None
    if t.tzinfo is not None:
        t = t.astimezone(timezone.utc)
    fraction = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
    return f"{t.year - earlier:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}{fraction}Z"


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^{}\[\],:"\s]+', re.S)


def indented(text: str, prefix: str, indent: str) -> str:
    """Compact JSON over several lines; empty objects and arrays stay on one."""
    if not indent:
        return text
    out: list[str] = []
    depth = 0
    pieces = _PIECE.findall(text)
    for i, p in enumerate(pieces):
        if p in "{[" and len(p) == 1:
            out.append(p)
            if pieces[i + 1] not in ("}", "]"):
                depth += 1
                out.append("\n" + prefix + indent * depth)
        elif p in "}]" and len(p) == 1:
            if pieces[i - 1] not in ("{", "["):
                depth -= 1
                out.append("\n" + prefix + indent * depth)
            out.append(p)
        elif p == ",":
            out.append(",\n" + prefix + indent * depth)
        elif p == ":":
            out.append(": ")
        else:
            out.append(p)
    return "".join(out)
