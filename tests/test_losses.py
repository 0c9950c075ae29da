"""What must not be lost in silence: bad records, dynamic values in maps, odd names, odd years, hooks that raise."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import json_quote, prepare
from tessera.operators.codec import Reader, fold, register_codec
from tessera.operators.decode import decode
from tessera.operators.encode import encode, encode_checked
from tessera.options import DecodeOptions, EncodeOptions
from tessera.schema import Field, Record, plain
from tessera.sources.ndjson import decode_records, read_values, split_values, unread


def lines(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


@pytest.mark.parametrize("read", [lambda d: d.select("value.*").collect(), lambda d: d.count(), lambda d: d.select("i").collect(), lambda d: d.filter("value.x > 0").collect()])
def test_fail_mode_raises_whatever_is_read(spark, read):
    good, bad = lines(spark, ['{"x":1}', '{"x":2}']), lines(spark, ['{"x":1}', '{"x":"no"}'])
    assert read(decode_records(good, "x bigint", "fail"))
    with pytest.raises(Exception, match="bad JSON record"):
        read(decode_records(bad, "x bigint", "fail"))
    only_syntax = lambda kind: kind == "syntax"
    assert decode_records(lines(spark, ["{bad", '{"x":1}']), "x bigint", "skip", skip=only_syntax).count() == 2
    with pytest.raises(Exception, match="bad JSON record"):
        read(decode_records(bad, "x bigint", "skip", skip=only_syntax))


def test_malformed_values_fail_too(spark, tmp_path):
    (tmp_path / "a").write_text('{"x":1}\n{"x":,\n{"x":2}')
    prepare(spark)
    assert read_values(spark, str(tmp_path), "x bigint", "drop").count() == 2
    with pytest.raises(Exception, match="bad JSON record"):
        read_values(spark, str(tmp_path), "x bigint", "fail").count()


def test_unread_rest(spark):
    d = lines(spark, ['{"a":1} [2', "[1][2]", "", "{x\n7", '"é" nul'])
    assert [r[0] for r in d.orderBy("i").select(unread("value")).collect()] == ["[2", "", "", "", "nul"]
    assert split_values(d).filter("error is null").count() == 5


def test_variants_in_maps_and_arrays(spark):
    prepare(spark)
    d = spark.sql("""select map('k', parse_json('{"b":[1,2.50,"x<"]}'), 'n', parse_json('null'), 's', cast(null as variant)) m, array(parse_json('1'), parse_json('"é"')) a""")
    schema = "m map<string,variant>, a array<variant>"
    want = '{"m":{"k":{"b":[1,2.5,"x<"]},"n":null,"s":null},"a":[1,"é"]}'
    assert d.select(encode(F.struct("m", "a"), schema)).first()[0] == want
    assert d.select(encode_checked(F.struct("m", "a"), schema)["text"]).first()[0] == want
    html = d.select(encode_checked(F.struct("m", "a"), schema, EncodeOptions(escape_html=True))["text"]).first()[0]
    assert html == want.replace("<", "\\u003c")


def test_names_that_are_no_identifiers(spark):
    names = ["a b", "-", "é ü", "x.y", "q`r", "$", "1"]
    record = Record([Field(n, "bigint", f"{n}," if n == "-" else "") for n in names])
    d = lines(spark, [json.dumps({n: i for i, n in enumerate(names)}), '{"a b":"no"}', None])
    rows = d.select("i", decode("value", record.struct()).alias("d")).orderBy("i").collect()
    assert list(rows[0].d.value) == list(range(len(names))) and rows[0].d.error is None
    assert rows[1].d.error.field == "a b" and rows[2].d.value is None
    back = d.filter("i = 0").select(encode(decode("value", record.struct())["value"], record.struct())).first()[0]
    assert json.loads(back) == {n: i for i, n in enumerate(names)}


def test_years_beyond_the_calendar(spark):
    prepare(spark)
    d = spark.sql("select timestamp_micros(253402300800000000) late, timestamp_micros(-62135596800000000 - 86400000000) zero, timestamp_micros(-62198755200000000) before, timestamp_micros(1500000) fine")
    got = [d.select(encode_checked(F.struct(F.col(c).alias("t")), "t timestamp").alias("e")).first().e for c in d.columns]
    assert [g.error.kind if g.error else g.text for g in got] == ["value", '{"t":"0000-12-31T00:00:00Z"}', "value", '{"t":"1970-01-01T00:00:01.5Z"}']
    in_map = d.select(encode(F.create_map(F.lit("k"), "late"), "map<string,timestamp>"), encode(F.create_map(F.lit("k"), "fine"), "map<string,timestamp>")).first()
    assert list(in_map) == [None, '{"k":"1970-01-01T00:00:01.5Z"}']


def test_hooks_that_raise(spark):
    def refuse(v):
        if v == "bad":
            raise ValueError("no")
        return f'"{v}!"'

    register_codec("refuse", encode=refuse)
    r = Record([Field("x", "string", kind="hook:refuse"), Field("y", "int")])
    d = lines(spark, ["bad", "fine", None])
    rows = d.select("i", encode(F.struct(F.col("value").alias("x"), F.lit(1).alias("y")), r.struct()).alias("t"), encode_checked(F.struct(F.col("value").alias("x"), F.lit(1).alias("y")), r.struct()).alias("c")).orderBy("i").collect()
    assert [x.t for x in rows] == [None, '{"x":"fine!","y":1}', '{"x":null,"y":1}']
    assert [x.c.text for x in rows] == [x.t for x in rows] and rows[0].c.error.kind == "hook"


def test_offsets_count_bytes_and_ends():
    read = lambda text, ddl: Reader(plain(ddl), DecodeOptions()).read(text)[1]
    assert read('{"éé":x}', "a int")["offset"] == 8
    assert read('{"é":1,"a":"x"}', "a int")["offset"] == len('{"é":1,"a":"x"'.encode())
    assert read('{"a":{"b":[1,true,2]}}', "a struct<b: array<int>>")["offset"] == len('{"a":{"b":[1,true')
    assert read('{"a":1} x', "a int")["offset"] == 8 and read('{"a":"ü', "a int")["offset"] == 8
    assert read('["a"]', "a int")["offset"] == 5


@pytest.mark.parametrize("native", [True, False])
def test_keys_fold_to_letters_of_as_many_bytes(spark, native):
    assert fold("KÄ") == "kä" and fold("K") == "K" and fold("ß") == "ß"
    d = lines(spark, ['{"K":1}', '{"K":2}', '{"k":3,"K":4}', '{"x":{"k":"s"},"K":5,"other":[1,{"k":null}]}', '{"unknown":1e700,"k":6}', '{"k":1,"K":"s"}'])
    rows = d.select("i", decode("value", "k bigint", DecodeOptions(native=native)).alias("d")).orderBy("i").collect()
    assert [r.d.value.k for r in rows] == [None, 2, 4, 5, 6, None]
    rows = d.select("i", decode("value", "k bigint", DecodeOptions(native=native, fold_keys=False)).alias("d")).orderBy("i").collect()
    assert [r.d.value.k for r in rows] == [None, None, 3, None, 6, 1]


TYPED = [
    '{"f":1.5,"t":"2020-02-29T12:00:00.1234567Z","b":"QUI=","m":{"a":1,"b":null,"k z":3},"n":{"x":{"y":["1999-12-31T23:59:59+02:00",null]}},"l":["QQ==",""]}',
    '{"f":1e39}', '{"f":1e38,"t":"2020-02-30T00:00:00Z"}', '{"t":"0000-01-01T00:00:00Z","f":2}', '{"t":"9999-12-31T23:59:59-01:00"}', '{"t":"2020-01-01"}', '{"t":7}', '{"t":"2020-01-01T00:00:00,5Z"}', '{"t":"2020-01-01T24:00:00Z"}', '{"t":"2020-01-01T00:00:00+19:00"}',
    '{"b":"Q"}', '{"b":"QQ=\\n="}', '{"b":"Q Q="}', '{"b":"QR=="}', '{"b":null,"t":null,"f":null,"m":null}', '{"m":{"a":1,"a":2}}', '{"m":{"a":1.5}}', '{"m":{"a":99999999999999999999}}', '{"m":{}}', '{"m":{"`":1,", a: ":2,"é":3}}', '{"m":[1]}', '{"n":{"x":{"y":"z"},"w":null}}',
    '{"n":{"x":null,"w":{"y":[],"z":1}}}', '{"l":["?"]}', '{"F":1}', '{"unknown":{"t":1},"f":0.1}', '{"f":16777217,"t":"2020-06-01T00:00:00.000001-05:30"}', "{}", "[]", '{"m":{"a":1}} x', None,
]


@pytest.mark.parametrize("ddl", ["f float, t timestamp, b binary, m map<string,bigint>, n map<string,struct<y: array<timestamp>>>, l array<binary>", "map<string,map<string,int>>", "map<string,float>", "array<map<string,binary>>"])
def test_times_bytes_floats_and_maps_agree_with_the_codec(spark, ddl):
    texts = TYPED + ['{"a":{"b":1,"c":null}}', '{"a":{"b":3000000000}}', '{"a":1.25,"b":null,"c":1e39}', '[{"a":"QQ=="},null,{"b":"?"}]', "[]", "null"]
    d = lines(spark, texts)
    both = d.select("i", decode("value", ddl).alias("n"), decode("value", ddl, DecodeOptions(native=False)).alias("c")).orderBy("i").collect()
    for r in both:
        assert r.n == r.c, texts[r.i]
    from tessera.operators.decode import native_schema

    assert native_schema(plain(ddl))


def test_wide_schemas_and_huge_numbers(spark):
    ddl = ", ".join(f"f{i} double" for i in range(40))
    d = lines(spark, [json.dumps({f"f{i}": i / 4 for i in range(40)} | {"zz": {"f1": "s"}}), '{"f3":1e400,"f4":2}', '{"f3":' + "9" * 400 + "}", '{"f3":-0.0,"extra":"\\ud800"}'])
    for native in (True, False):
        rows = d.select("i", decode("value", ddl, DecodeOptions(native=native)).alias("d")).orderBy("i").collect()
        assert list(rows[0].d.value) == [i / 4 for i in range(40)] and rows[0].d.error is None
        assert rows[1].d.value.f3 is None and rows[1].d.value.f4 == 2 and rows[1].d.error.kind == "type"
        assert rows[2].d.value.f3 is None and rows[3].d.value.f3 == 0 and rows[3].d.error is None


def test_strings_are_quoted_without_python(spark):
    texts = ["\x0b\x0b\x1f\\u000B\\\x0b\\\\\x0e", "plain", "é <>&\"\\/", "\x00\x01\x10\x1a\x7f", ""]
    d = lines(spark, texts).select("i", json_quote("value").alias("q"), encode(F.struct(F.array("value").alias("a"), F.create_map("value", F.array(F.struct("value"))).alias("m")), "a array<string>, m map<string,array<struct<value: string>>>").alias("e"))
    from tessera.operators.codec import quote

    for r in d.collect():
        q = quote(texts[r.i])
        assert r.q == q and r.e == f'{{"a":[{q}],"m":{{{q}:[{{"value":{q}}}]}}}}'
    assert "ArrowEvalPython" not in d._jdf.queryExecution().executedPlan().toString()
