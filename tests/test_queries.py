"""Every verification query against DuckDB on the smallest tables, and plans and modes of the operators."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators.decode import decode, native_schema
from tessera.operators.encode import encode
from tessera.options import DecodeOptions, EncodeOptions
from tessera.plans import verification
from tessera.schema import plain
from tessera.sources.ndjson import decode_records, read_ndjson, read_values, write_ndjson
from tessera.functions.text import is_valid, prepare

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def flat(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [flat(x) for x in v]
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([flat(x) for x in r]) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(verification.QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(verification.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(verification.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


DOCS = ['{"a":300,"b":"x","c":[1,2]}', '{"a":3,"b":"x"}', '{"a":1.0}', '{"b":5}', '{"a":1', '{"a":1}}', '{"A":7}', None, "", '{"a":1,"a":2,"z":[{}]}', '{"b":"\\ud800"}', '{"c":[1,"x"]}', "[1]", '{"d":1e400}', '{"d":1e3}', '{"e":{"f":5,"q":1}}', '{"e":{"F":5}}', '{"a":1},{"a":2}', '{"a":1}],[{"a":2}', '{"a":true}', '{"b":{"x":1}}', '{"e":[1]}', '{"a":-0}', '{"d":0.1,"b":""}', "null", "{}", '{"e":null,"c":[null]}']


def test_native_and_codec_agree(spark):
    prepare(spark)
    schema = "a tinyint, b string, c array<int>, d double, e struct<f: int>"
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, s string")
    got = df.select("s", decode("s", schema).alias("n"), decode("s", schema, DecodeOptions(native=False)).alias("c")).collect()
    assert [(r.s, r.n) for r in got] == [(r.s, r.c) for r in got]
    assert native_schema(plain(schema))


def test_validity_of_tricky_texts(spark):
    prepare(spark)
    texts = ["1],[2", '1},{"v":2', "1 2", "", " ", "{}", "[]", "5", '"x"', "nul", "1e400", "1e-400", "[1e309]", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "s string").select(is_valid("s").alias("v")).collect()]
    assert got == [False, False, False, False, False, True, True, True, True, False, False, True, False, None]


def test_decode_reads_only_its_column(spark):
    plan = spark.read.parquet(f"{DIR}/events.parquet").select(decode("props", "k bigint").alias("d"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<props:string>" in plan


def test_encode_unnests_and_escapes(spark):
    df = spark.createDataFrame([(1, "<a&b>", None, float("nan"))], "i int, s string, n string, f double")
    html = EncodeOptions(escape_html=True)
    got = df.select(encode(F.struct("i", "s", "n"), "i int, s string, n string", html).alias("x"), encode(F.struct("f"), "f double").alias("y")).first()
    assert got.x == '{"i":1,"s":"\\u003ca\\u0026b\\u003e","n":null}' and got.y is None


def test_modes_of_bad_records(spark, tmp_path):
    (tmp_path / "in.txt").write_text('{"x":1}\n{bad}\n\n{"x":3}\n')
    read = lambda mode, **o: read_ndjson(spark, str(tmp_path / "in.txt"), "x bigint", mode, **o)
    assert sorted(r.value.x for r in read("drop").collect()) == [1, 3]
    assert read("skip").filter("error is not null").count() == 1
    with pytest.raises(Exception, match="bad JSON record"):
        read("fail").collect()
    assert read("skip", skip=lambda k: k == "syntax").count() == 3
    with pytest.raises(Exception, match="bad JSON record"):
        read("skip", skip=lambda k: k == "type").collect()
    (tmp_path / "cat.txt").write_text('{"x":1} {"x":\n2}[\n{"x":4}')
    assert sorted(r.value.x for r in read_values(spark, str(tmp_path / "cat.txt"), "x bigint", "drop").collect()) == [1, 2, 4]


def test_write_fails_on_values_without_json(spark, tmp_path):
    with pytest.raises(Exception):
        write_ndjson(spark.createDataFrame([(float("inf"),)], "f double"), str(tmp_path / "out"))
    empty = spark.createDataFrame([], "f double")
    write_ndjson(empty, str(tmp_path / "none"))
    assert decode_records(spark.read.text(str(tmp_path / "none")), "f double").count() == 0


def test_decode_into_merges(spark):
    from tessera.operators.decode import decode_into

    prepare(spark)
    schema = "a bigint, m map<string,bigint>, r struct<x: bigint, y: string>, l array<bigint>"
    first, second = '{"a":1,"m":{"p":1,"q":2},"r":{"x":1,"y":"k"},"l":[1,2]}', '{"a":null,"m":{"q":3},"r":{"x":9},"l":[5]}'
    df = spark.createDataFrame([(first, second), (first, "{bad"), ("", second)], "s string, t string")
    got = [r.v for r in df.select(decode_into(decode("s", schema)["value"], "t", schema).alias("v")).collect()]
    assert got[0].value.asDict(True) == {"a": 1, "m": {"p": 1, "q": 3}, "r": {"x": 9, "y": "k"}, "l": [5]}
    assert got[1].value.a == 1 and got[1].error.kind == "syntax" and got[2].value.r.x == 9
