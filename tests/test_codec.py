"""The strict codec alone: accept and reject lists, floats, tagged kinds, indentation."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import types as T

from tessera.errors import UnsupportedTypeError, UnsupportedValueError
from tessera.operators import codec
from tessera.options import DecodeOptions, EncodeOptions
from tessera.schema import Field, Record

GOOD = ["0", "-0", "1e5", "1E-5", "1.25", '""', '"\\u00e9\\n"', "null", "true", "false", "[]", "{}", " [ 1 , 2 ] ", '{"a":{"b":[{}]}}', '"\\ud83d\\ude00"', '"\\ud800"', '{"a":1,"a":2}', "[[[]]]", "\t1\r\n", '" "', "123456789012345678901234567890"]
BAD = ["", " ", "01", "+1", ".5", "1.", "1e", "-", "NaN", "Infinity", "tru", "nul", "[1,]", "[,1]", "[1 2]", "[1", "1]", '{"a"}', '{"a":}', '{a:1}', '{"a":1,}', '{"a":1', "'a'", '"a', '"\\x"', '"\\u12"', '"\t"', "1 2", "1,2", "{} x", "﻿1", "//x\n1", "[1}", "1e400", " 1"]


def test_accept_and_reject():
    assert [t for t in GOOD if not codec.valid(t)] == []
    assert [t for t in BAD if codec.valid(t)] == []
    assert codec.valid(None) is None


def test_depth_is_unlimited():
    n = 50_000
    assert codec.valid("[" * n + "]" * n)
    assert codec.valid('{"a":' * n + "1" + "}" * n)
    assert not codec.valid("[" * n + "]" * (n - 1))


def read(schema, text, **options):
    return codec.Reader(schema, DecodeOptions(**options)).read(text)


def struct_of(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@pytest.mark.parametrize("dtype,lo,hi", [(T.ByteType(), -128, 127), (T.ShortType(), -32768, 32767), (T.IntegerType(), -(1 << 31), (1 << 31) - 1), (T.LongType(), -(1 << 63), (1 << 63) - 1)])
def test_integer_ranges(dtype, lo, hi):
    s = struct_of(v=dtype)
    for x, ok in ((lo, True), (hi, True), (lo - 1, False), (hi + 1, False)):
        value, error = read(s, f'{{"v":{x}}}')
        assert (value["v"] == x, error is None) == (ok, ok)
        if not ok:
            assert error["value"] == f"number {x}" and error["field"] == "v"


def test_mismatch_keeps_the_first_error_and_goes_on():
    value, error = read(struct_of(a=T.LongType(), b=T.LongType(), c=T.StringType()), '{"a":"x","b":1.5,"c":"ok"}')
    assert value == {"a": None, "b": None, "c": "ok"} and error["field"] == "a" and error["value"] == "string"


def test_syntax_error_has_no_value_and_an_offset():
    value, error = read(struct_of(a=T.LongType()), '{"a":1 2}')
    assert value is None and error["kind"] == "syntax" and error["offset"] == 7
    assert "unexpected end" in read(struct_of(a=T.LongType()), '{"a":')[1]["message"]


def test_floats_out_of_range():
    for text in ("1e700", "1.8e308", "-1e309"):
        assert read(struct_of(v=T.DoubleType()), f'{{"v":{text}}}')[1]["kind"] == "type"
    assert read(struct_of(v=T.FloatType()), '{"v":1e39}')[1]["kind"] == "type"
    assert read(struct_of(v=T.DoubleType()), '{"v":5e-324}')[0]["v"] == 5e-324


def test_fold_keys_prefers_the_exact_name():
    s = struct_of(name=T.LongType())
    assert read(s, '{"NAME":1}')[0]["name"] == 1
    assert read(s, '{"NAME":1}', fold_keys=False)[0]["name"] is None
    assert read(s, '{"name":2,"NAME":1}')[0]["name"] == 1  # the last one that matches wins


def test_maps_arrays_unsigned_and_kinds():
    m = T.MapType(T.LongType(), T.StringType())
    assert read(m, '{"1":"a","-2":"b"}') == ([(1, "a"), (-2, "b")], None)
    assert read(m, '{"x":"a"}')[1]["kind"] == "type"
    r = Record([Field("u", T.ShortType(), kind="uint8"), Field("n", T.StringType(), kind="number"), Field("w", T.StringType(), kind="raw"), Field("f", T.ArrayType(T.LongType()), fixed=2)]).struct()
    value, error = read(r, '{"u":255,"n":1.50,"w": [1, {"a" : 2}],"f":[1,2,3]}')
    assert value == {"u": 255, "n": "1.50", "w": '[1, {"a" : 2}]', "f": [1, 2]} and error is None
    assert read(r, '{"u":-1}')[1]["kind"] == "type" and read(r, '{"u":256}')[1]["kind"] == "type"
    assert read(r, '{"f":[1]}')[0]["f"] == [1, 0]


def test_base64_needs_padding():
    s = struct_of(b=T.BinaryType())
    assert read(s, '{"b":"aGk="}')[0]["b"] == b"hi" and read(s, '{"b":""}')[0]["b"] == b""
    assert read(s, '{"b":"aGk"}')[1]["kind"] == "type"


def test_quoted_scalars():
    r = Record([Field("i", T.LongType(), ",string"), Field("b", T.BooleanType(), ",string"), Field("s", T.StringType(), ",string"), Field("l", T.ArrayType(T.LongType()), ",string")]).struct()
    assert read(r, '{"i":"12","b":"true","s":"\\"x\\"","l":[1]}')[0] == {"i": 12, "b": True, "s": "x", "l": [1]}
    assert read(r, '{"i":12}')[1]["kind"] == "type" and read(r, '{"i":null}') == ({"i": None, "b": None, "s": None, "l": None}, None)
    assert codec.Writer(r, EncodeOptions()).write({"i": 12, "b": True, "s": "x", "l": [1]})[0] == '{"i":"12","b":"true","s":"\\"x\\"","l":[1]}'


def test_time():
    s = struct_of(t=T.TimestampType())
    t = read(s, '{"t":"2024-02-29T23:59:59.123456789+02:00"}')[0]["t"]
    assert codec.time_text(t) == "2024-02-29T21:59:59.123456Z"
    for bad in ("2023-02-29T00:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "x"):
        assert read(s, json.dumps({"t": bad}))[1]["kind"] == "type"


def test_float_text_is_the_shortest_and_round_trips():
    rng = random.Random(5)
    for _ in range(3000):
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if math.isfinite(x):
            assert float(codec.float_text(x)) == x and "e" not in codec.float_text(x)
            assert float(codec.float_text(x, exp_auto=True)) == x
    assert [codec.float_text(x, exp_auto=True) for x in (1e20, 1e21, 1e-6, 1e-7, 0.0, -0.0, 100.0, 2e23)] == ["100000000000000000000", "1e+21", "0.000001", "1e-7", "0", "-0", "100", "2e+23"]
    assert codec.float_text(0.1, single=True) == "0.1" and codec.float_text(16777216.0, single=True) == "16777216"
    for x in (float("nan"), float("inf")):
        with pytest.raises(UnsupportedValueError):
            codec.float_text(x)


def test_escapes():
    assert codec.quote('a"\\/\b\f\n\r\t\x1f\x7f<>& ') == '"a\\"\\\\/\\b\\f\\n\\r\\t\\u001f\x7f<>& "'
    assert codec.quote("< ", EncodeOptions().std_compat()) == '"\\u003c\\u2029"'


def test_omitempty_and_embedding():
    inner = Record([Field("x", T.LongType(), ",omitempty"), Field("y", T.LongType())])
    r = Record([Field("y", T.StringType()), Field("inner", inner, embedded=True), Field("l", T.ArrayType(T.LongType()), ",omitempty"), Field("no", T.LongType(), "-"), Field("d", T.LongType(), "-,")]).struct()
    assert [f.name for f in r] == ["y", "x", "l", "-"]
    write = codec.Writer(r, EncodeOptions()).write
    assert write({"y": "", "x": 0, "l": [], "-": None})[0] == '{"y":"","-":null}'
    assert write({"y": None, "x": 5, "l": [0], "-": 1})[0] == '{"y":null,"x":5,"l":[0],"-":1}'
    clash = Record([Field("a", Record([Field("z", T.LongType())]), embedded=True), Field("b", Record([Field("z", T.LongType())]), embedded=True), Field("k", T.LongType())])
    assert [f.name for f in clash.struct()] == ["k"]


def test_hooks_raise_as_hook_errors():
    codec.register_codec("picky", decode=lambda s: int(s), encode=lambda v: f"[{v}]")
    r = Record([Field("x", T.LongType(), kind="hook:picky")]).struct()
    assert read(r, '{"x": 7 }') == ({"x": 7}, None) and read(r, '{"x":"q"}')[1]["kind"] == "hook"
    assert codec.Writer(r, EncodeOptions()).write({"x": 7})[0] == '{"x":[7]}'


def test_depth_limit_and_unsupported_types():
    t: T.DataType = T.LongType()
    for _ in range(3):
        t = T.ArrayType(t)
    assert codec.Writer(t, EncodeOptions(max_depth=2)).write([[[1]]])[1]["kind"] == "value"
    with pytest.raises(UnsupportedTypeError):
        Record([Field("d", T.DateType())]).struct()


def test_indent_and_values():
    assert codec.indented('{"a":1,"b":[],"c":[1,{"x":"y,{z"}]}', "", " ") == json.dumps({"a": 1, "b": [], "c": [1, {"x": "y,{z"}]}, indent=1)
    assert codec.indented('{"a":1}', ">", "") == '{"a":1}'
    got = codec.values('{"x":1}\n{bad}\n{"x":3} 4\n[5')
    assert [t for t, _ in got] == ['{"x":1}', None, '{"x":3}', "4"] and got[1][1]["kind"] == "syntax"


def test_random_round_trips():
    rng = random.Random(9)
    schema = struct_of(a=T.LongType(), b=T.StringType(), c=T.ArrayType(T.DoubleType()), d=struct_of(e=T.BooleanType()), m=T.MapType(T.StringType(), T.LongType()))
    for _ in range(300):
        text = lambda: "".join(chr(rng.choice([rng.randrange(32), rng.randrange(32, 127), rng.randrange(160, 0xD7FF), 0x1F600])) for _ in range(rng.randrange(9)))
        v = {"a": rng.choice([None, rng.randrange(-(1 << 63), 1 << 63)]), "b": rng.choice([None, text()]), "c": rng.choice([None, [rng.uniform(-1e9, 1e9) for _ in range(3)]]), "d": rng.choice([None, {"e": True}]), "m": [(k, rng.randrange(99)) for k in {text() for _ in range(2)}]}
        out, error = codec.Writer(schema, EncodeOptions()).write(v)
        assert error is None and json.loads(out) is not None and read(schema, out) == (v, None)


def test_use_number_and_key_hooks():
    s = struct_of(v=T.VariantType())
    assert read(s, '{"v":[1.50,{"x":1e2}]}', use_number=True)[0]["v"] == '["1.50",{"x":"1e2"}]'
    assert read(s, '{"v":[1.50]}')[0]["v"] == "[1.50]"
    codec.register_codec("hexkey", decode=lambda k: int(k, 16), encode=lambda k: f"{k:x}", text=True)
    r = Record([Field("m", T.MapType(T.LongType(), T.StringType()), keys="hexkey")]).struct()
    assert read(r, '{"m":{"ff":"a"}}')[0] == {"m": [(255, "a")]}
    assert codec.Writer(r, EncodeOptions()).write({"m": {255: "a"}})[0] == '{"m":{"ff":"a"}}'
    assert read(r, '{"m":{"zz":"a"}}')[1]["kind"] == "hook"
