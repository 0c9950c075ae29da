"""Verification queries over the driver's tables, each with its form in DuckDB's SQL.

JSON text is built from the tables, sent through the operators under test, and compared with what SQL computes from the
same columns. Relational parts are Spark's own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dynamic, float_text, is_valid, json_quote, prepare, raw_member, time_value
from ..operators.codec import register_codec
from ..operators.decode import decode, fixed_array
from ..operators.encode import append_encode, encode, encode_checked, encode_indent
from ..options import DecodeOptions, EncodeOptions
from ..schema import Field, Record
from ..sources.ndjson import decode_records, read_values, split_values, unread, write_ndjson
from ..streaming.ndjson import read_stream, write_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _doc(*parts: object) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@_query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type")
def decode_sum_by_type(t):
    rows = t("events").filter(is_valid("props")).select("event_type", decode("props", "k bigint")["value"]["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS is_error FROM events")
def decode_struct(t):
    d = t("events").select("event_id", decode("props", "k bigint").alias("d"))
    return d.select("event_id", F.col("d.value.k").alias("k"), F.col("d.error").isNotNull().alias("is_error"))


@_query("SELECT o_orderkey, o_custkey AS cust, o_orderstatus AS status, o_orderkey % 7 AS first, 3 AS n_tags FROM orders")
def decode_nested(t):
    doc = _doc('{"cust":{"id":', F.col("o_custkey"), ',"extra":[1,{"x":null}]},"status":"', F.col("o_orderstatus"), '","tags":[', F.col("o_orderkey") % 7, ',2,3],"unknown":{"a":[]}}')
    v = decode(doc, "cust struct<id: bigint, extra: array<struct<x: int>>>, status string, tags array<bigint>")
    plain = decode(F.regexp_replace(doc, r',"extra":\[1,\{"x":null\}\]', ""), "cust struct<id: bigint>, status string, tags array<bigint>")
    d = t("orders").select("o_orderkey", plain.alias("d"), v.alias("e"))
    return d.select("o_orderkey", F.col("e.value.cust.id").alias("cust"), F.col("d.value.status").alias("status"), F.col("d.value.tags")[0].alias("first"), F.size("d.value.tags").alias("n_tags"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0::BIGINT AS missing FROM events")
def decode_map(t):
    d = t("events").select("event_id", decode(F.concat(F.lit('{"null":null,'), F.substr("props", F.lit(2))), "map<string,bigint>")["value"].alias("m"))
    return d.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["null"].alias("missing"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def decode_any(t):
    return t("events").select("event_id", F.variant_get(dynamic("props"), "$.k", "bigint").alias("k"))


@_query("SELECT event_id, 9007199254740992::DOUBLE AS x, '1.50' AS y FROM events")
def decode_any_numbers(t):
    s = F.lit('{"x":9007199254740993,"y":1.50}')
    e = t("events").select("event_id", F.concat(s, F.substr(F.lit("  "), F.lit(1), (F.col("event_id") % 2).cast("int"))).alias("s"))
    return e.select("event_id", F.variant_get(dynamic("s", "float64"), "$.x", "double").alias("x"), F.variant_get(dynamic("s", "text"), "$.y", "string").alias("y"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@_query(f"SELECT event_id, CASE WHEN {_K} * 3 BETWEEN -128 AND 127 THEN {_K} * 3 END AS v, {_K} * 3 NOT BETWEEN -128 AND 127 AS is_error FROM events")
def decode_range_tinyint(t):
    k = decode("props", "k bigint")["value"]["k"]
    d = t("events").select("event_id", decode(_doc('{"v":', k * 3, "}"), "v tinyint").alias("d"))
    return d.select("event_id", F.col("d.value.v").cast("bigint").alias("v"), F.col("d.error").isNotNull().alias("is_error"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS a, CASE WHEN p_partkey % 2 = 1 THEN 'type' END AS kind FROM part")
def decode_float_to_int_error(t):
    doc = _doc('{"a":', F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 1, ".0").otherwise(""), "}")
    d = t("part").select("p_partkey", decode(doc, "a bigint").alias("d"))
    return d.select("p_partkey", F.col("d.value.a").alias("a"), F.col("d.error.kind").alias("kind"))


@_query("SELECT p_partkey, NULL::BIGINT AS a, p_partkey AS b, 'string' AS value, 'a' AS field FROM part")
def decode_mismatch_continue(t):
    d = t("part").select("p_partkey", decode(_doc('{"a":"x","b":', F.col("p_partkey"), "}"), "a bigint, b bigint").alias("d"))
    return d.select("p_partkey", F.col("d.value.a").alias("a"), F.col("d.value.b").alias("b"), F.col("d.error.value").alias("value"), F.col("d.error.field").alias("field"))


@_query("SELECT p_partkey, p_partkey AS s FROM part WHERE p_partkey % 3 <> 0")
def decode_number_into_string_error(t):
    q = F.when(F.col("p_partkey") % 3 == 0, "").otherwise('"')
    d = t("part").select("p_partkey", decode(_doc('{"s":', q, F.col("p_partkey"), q, "}"), "s string").alias("d"))
    return d.filter("d.error is null").select("p_partkey", F.col("d.value.s").cast("bigint").alias("s"))


@_query("SELECT r_regionkey, NULL::BIGINT AS a, NULL::VARCHAR AS b, 0::BIGINT AS za, '' AS zb FROM region")
def decode_null(t):
    doc = _doc('{"a":null,"b":null,"c":', F.col("r_regionkey"), "}")
    d = t("region").select("r_regionkey", decode(doc, "a bigint, b string").alias("d"), decode(doc, "a bigint, b string", DecodeOptions(zero_fill=True)).alias("z"))
    return d.select("r_regionkey", "d.value.a", "d.value.b", F.col("z.value.a").alias("za"), F.col("z.value.b").alias("zb"))


@_query("SELECT p_partkey, p_partkey AS a FROM part")
def decode_dup_last_wins(t):
    return t("part").select("p_partkey", decode(_doc('{"a":1,"a":', F.col("p_partkey"), "}"), "a bigint")["value"]["a"].alias("a"))


@_query("SELECT n_nationkey, n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def decode_casefold(t):
    d = decode(_doc('{"KEY":', F.col("n_nationkey"), ',"Name":"', F.col("n_name"), '"}'), "key bigint, name string")
    return t("nation").select("n_nationkey", d["value"]["key"].alias("key"), d["value"]["name"].alias("name"))


@_query("SELECT c_custkey, c_custkey AS id, c_custkey % 2 = 0 AS flag, c_name AS name FROM customer")
def decode_quoted(t):
    r = Record([Field("id", "bigint", ",string"), Field("flag", "boolean", ",string"), Field("name", "string", ",string")])
    doc = _doc('{"id":"', F.col("c_custkey"), '","flag":"', (F.col("c_custkey") % 2 == 0), '","name":"\\"', F.col("c_name"), '\\""}')
    return t("customer").select("c_custkey", decode(doc, r.struct())["value"].alias("v")).select("c_custkey", "v.id", "v.flag", "v.name")


@_query("SELECT c_custkey, c_name AS name FROM customer")
def decode_base64(t):
    d = decode(_doc('{"b":"', F.base64(F.col("c_name").cast("binary")), '"}'), "b binary")
    return t("customer").select("c_custkey", d["value"]["b"].cast("string").alias("name"))


@_query("SELECT p_partkey, [p_partkey, 7, 0, 0] AS a, [p_partkey, 7, 0, 0] AS b FROM part")
def decode_fixed_array(t):
    r = Record([Field("a", "array<bigint>", fixed=4)])
    doc = _doc('{"a":[', F.col("p_partkey"), ",7]}")
    return t("part").select("p_partkey", decode(doc, r.struct())["value"]["a"].alias("a"), fixed_array(decode(doc, "a array<bigint>")["value"]["a"], 4).alias("b"))


@_query("SELECT n_nationkey, n_nationkey::BIGINT AS k, n_name AS v FROM nation")
def decode_intkey_map(t):
    d = decode(_doc('{"', F.col("n_nationkey"), '":"', F.col("n_name"), '"}'), "map<bigint,string>")["value"]
    return t("nation").select("n_nationkey", F.map_keys(d)[0].alias("k"), F.map_values(d)[0].alias("v"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 255 END::BIGINT AS u8, 18446744073709551615::HUGEINT::VARCHAR AS u64 FROM supplier")
def decode_unsigned(t):
    r = Record([Field("u8", "uint8"), Field("u64", "uint64")])
    doc = _doc('{"u8":', F.when(F.col("s_suppkey") % 2 == 0, "255").otherwise("-1"), ',"u64":18446744073709551615}')
    v = decode(doc, r.struct())["value"]
    return t("supplier").select("s_suppkey", v["u8"].cast("bigint").alias("u8"), v["u64"].cast("string").alias("u64"))


@_query("SELECT p_partkey, '1.50' AS n, '{ \"k\" : [1, 2.0] }' AS raw, '[1, 2.0]' AS part FROM part")
def decode_number_and_raw(t):
    r = Record([Field("n", "string", kind="number"), Field("raw", "string", kind="raw")])
    doc = _doc('{"id":', F.col("p_partkey"), ',"n":1.50,"raw":{ "k" : [1, 2.0] }}')
    v = decode(doc, r.struct())["value"]
    return t("part").select("p_partkey", v["n"].alias("n"), v["raw"].alias("raw"), raw_member(raw_member(doc, "raw"), "k").alias("part"))


@_query("SELECT n_nationkey, upper(n_name) || '!' AS shout, '{\"x\":\"<' || upper(n_name) || '!>\"}' AS back FROM nation")
def hooks(t):
    register_codec("shout", decode=lambda s: s.upper() + "!", encode=lambda v: f"<{v}>", text=True)
    r = Record([Field("x", "string", kind="hook:shout")])
    v = t("nation").select("n_nationkey", decode(_doc('{"x":"', F.col("n_name"), '"}'), r.struct())["value"].alias("v"))
    return v.select("n_nationkey", F.col("v.x").alias("shout"), encode("v", r.struct()).alias("back"))


@_query("SELECT o_orderkey, o_orderdate AS at, o_orderdate + INTERVAL 123456 MICROSECOND AS later FROM orders")
def decode_time(t):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    r = Record([Field("t", "timestamp")])
    a = time_value(F.concat(stamp, F.lit("Z")))
    b = decode(_doc('{"t":"', stamp, '.123456789+00:00"}'), r.struct())["value"]["t"]
    return t("orders").select("o_orderkey", a.cast("timestamp_ntz").alias("at"), b.cast("timestamp_ntz").alias("later"))


@_query("SELECT p_partkey, p_partkey % 4 <> 1 AS ok FROM part")
def valid_flag(t):
    k = F.col("p_partkey") % 4
    doc = F.concat(_doc('{"a":[1,2,"', F.col("p_name"), '"]}'), F.when(k == 1, F.when(F.col("p_partkey") % 8 == 1, ",}").otherwise(" x")).when(k == 2, "\n ").otherwise(""))
    return t("part").select("p_partkey", is_valid(doc).alias("ok"))


@_query("SELECT n_nationkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS j FROM nation")
def encode_struct(t):
    n = t("nation")
    return n.select("n_nationkey", encode(F.struct(*n.columns), n.schema).alias("j"))


@_query(
    "SELECT r_regionkey, to_json({'r': {'key': r_regionkey, 'name': r_name}, 'nations': list({'k': n_nationkey, 'n': n_name} ORDER BY n_nationkey)})::VARCHAR AS j "
    "FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"
)
def encode_nested(t):
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("nations"))
    v = F.struct(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("r"), "nations")
    return rows.select("r_regionkey", encode(v, "r struct<key: int, name: string>, nations array<struct<k: int, n: string>>").alias("j"))


@_query("SELECT n_nationkey, '{\"' || n_name || '\":' || n_nationkey || ',\"7\":null}' AS j, '{}' AS e, '{\"7\":[true]}' AS i FROM nation")
def encode_map(t):
    m = F.create_map("n_name", "n_nationkey", F.lit("7"), F.lit(None).cast("int"))
    empty = F.when(F.col("n_nationkey") >= 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    return t("nation").select("n_nationkey", encode(m, "map<string,int>").alias("j"), encode(empty, "map<string,int>").alias("e"), encode(F.create_map(F.lit(7), F.array(F.lit(True))), "map<int,array<boolean>>").alias("i"))


@_query("SELECT s_suppkey, '{\"a\":' || CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE s_suppkey::VARCHAR END || ',\"b\":null,\"c\":[]}' AS j FROM supplier")
def encode_nulls(t):
    v = F.struct(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("a"), F.lit(None).cast("string").alias("b"), F.array().cast("array<int>").alias("c"))
    return t("supplier").select("s_suppkey", encode(v, "a bigint, b string, c array<int>").alias("j"))


@_query("SELECT s_suppkey, '{' || CASE WHEN s_suppkey % 2 = 1 THEN '\"a\":' || s_suppkey || ',' ELSE '' END || '\"b\":null,\"d\":{}}' AS j FROM supplier")
def encode_omitempty(t):
    r = Record([Field("a", "bigint", ",omitempty"), Field("b", "string"), Field("c", "array<int>", ",omitempty"), Field("d", Record([Field("x", "int", ",omitempty")]), ",omitempty")])
    v = F.struct(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).otherwise(0).alias("a"), F.lit(None).cast("string").alias("b"), F.array().cast("array<int>").alias("c"), F.struct(F.lit(0).alias("x")).alias("d"))
    return t("supplier").select("s_suppkey", encode(v, r.struct()).alias("j"))


_PLAIN = "CASE WHEN {x} = floor({x}) THEN ({x}::BIGINT)::VARCHAR ELSE ({x})::VARCHAR END"


@_query(f"SELECT p_partkey, {_PLAIN.format(x='p_retailprice')} AS f, '1000000000000000000000' AS big FROM part")
def encode_float_fixed(t):
    return t("part").select("p_partkey", float_text("p_retailprice").alias("f"), float_text(F.lit(1e21) + F.col("p_size") * 0).alias("big"))


@_query("SELECT p_partkey, '1e+21' AS big, '1e-7' AS small, '0.000001' AS edge, '-0' AS zero, '0.1' AS single FROM part")
def encode_float_exp(t):
    x = F.col("p_size") * 0.0
    f = lambda v, **o: float_text(F.lit(v) + x, exp_auto=True, **o)
    return t("part").select("p_partkey", f(1e21).alias("big"), f(1e-7).alias("small"), f(1e-6).alias("edge"), float_text(-x, exp_auto=True).alias("zero"), f(0.1, single=True).alias("single"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN '{\"x\":1.5}' END AS text, CASE WHEN s_suppkey % 2 = 0 THEN 'value' END AS kind FROM supplier")
def encode_nan_error(t):
    v = F.struct(F.when(F.col("s_suppkey") % 2 == 1, F.lit(1.5)).otherwise(F.lit(float("nan"))).alias("x"))
    d = t("supplier").select("s_suppkey", encode_checked(v, "x double").alias("d"))
    return d.select("s_suppkey", "d.text", "d.error.kind")


@_query("SELECT o_orderkey, '{\"t\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z\",\"u\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.25Z\"}' AS j FROM orders")
def encode_time(t):
    o = t("orders").withColumn("u", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 250000 MICROSECONDS"))
    return o.select("o_orderkey", encode(F.struct(F.col("o_orderdate").cast("timestamp").alias("t"), "u"), "t timestamp, u timestamp").alias("j"))


@_query("SELECT page_id, md5(replace(replace(replace(to_json(html)::VARCHAR, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS h FROM pages")
def encode_html(t):
    return t("pages").select("page_id", F.md5(json_quote("html", EncodeOptions(escape_html=True)).cast("binary")).alias("h"))


@_query("SELECT n_nationkey, '\"' || n_name || '\\u2028\\u2029\"' AS j, '\"' || n_name || ' \"' AS k FROM nation")
def encode_lineterms(t):
    two = F.concat("n_name", F.lit("  "))
    return t("nation").select("n_nationkey", json_quote(two, EncodeOptions().std_compat()).alias("j"), json_quote(F.concat("n_name", F.lit(" ")), EncodeOptions().std_compat().fast_escape()).alias("k"))


@_query("SELECT doc_id, md5(to_json(text)::VARCHAR) AS h FROM documents")
def encode_text(t):
    return t("documents").select("doc_id", F.md5(json_quote("text").cast("binary")).alias("h"))


@_query("SELECT n_nationkey, '\"' || n_name || '\\u001f\\u000b\\n\\\\u000B/\"' AS j FROM nation")
def encode_control(t):
    return t("nation").select("n_nationkey", json_quote(F.concat("n_name", F.lit("\x1f\x0b\n\\u000B/"))).alias("j"))


@_query("SELECT c_custkey, '{\"id\":\"' || c_custkey || '\",\"b\":\"true\",\"s\":\"\\\"' || c_name || '\\\"\"}' AS j FROM customer")
def encode_quoted(t):
    r = Record([Field("id", "bigint", ",string"), Field("b", "boolean", ",string"), Field("s", "string", ",string")])
    return t("customer").select("c_custkey", encode(F.struct(F.col("c_custkey").alias("id"), F.lit(True).alias("b"), F.col("c_name").alias("s")), r.struct()).alias("j"))


@_query("SELECT c_custkey, '{\"b\":\"' || to_base64(encode(c_name)) || '\",\"n\":null}' AS j FROM customer")
def encode_binary(t):
    return t("customer").select("c_custkey", encode(F.struct(F.col("c_name").cast("binary").alias("b"), F.lit(None).cast("binary").alias("n")), "b binary, n binary").alias("j"))


@_query("SELECT p_partkey, '{\"raw\":{ \"a\": ' || p_partkey || ' },\"none\":null,\"n\":1.50,\"z\":0}' AS j FROM part")
def encode_raw(t):
    r = Record([Field("raw", "string", kind="raw"), Field("none", "string", kind="raw"), Field("n", "string", kind="number"), Field("z", "string", kind="number")])
    v = F.struct(_doc('{ "a": ', F.col("p_partkey"), " }").alias("raw"), F.lit("").alias("none"), F.lit("1.50").alias("n"), F.lit("").alias("z"))
    return t("part").select("p_partkey", encode(v, r.struct()).alias("j"))


@_query("SELECT r_regionkey, 'pre:' || '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")
def encode_append(t):
    r = t("region")
    return r.select("r_regionkey", append_encode(F.lit("pre:"), F.struct(*r.columns), r.schema).alias("j"))


@_query("SELECT r_regionkey, '{' || chr(10) || '>  \"k\": ' || r_regionkey || ',' || chr(10) || '>  \"a\": [],' || chr(10) || '>  \"b\": [' || chr(10) || '>    1,' || chr(10) || '>    2' || chr(10) || '>  ]' || chr(10) || '>}' AS j FROM region")
def encode_indented(t):
    v = F.struct(F.col("r_regionkey").alias("k"), F.array().cast("array<int>").alias("a"), F.array(F.lit(1), F.lit(2)).alias("b"))
    return t("region").select("r_regionkey", encode_indent(v, "k int, a array<int>, b array<int>", ">", "  ").alias("j"))


@_query("SELECT n_nationkey, '{\"Base\":' || n_nationkey || ',\"own\":\"' || n_name || '\",\"-\":1}' AS j FROM nation")
def encode_embedded_tags(t):
    base = Record([Field("Base", "int"), Field("own", "string"), Field("gone", "int", "-")])
    r = Record([Field("base", base, embedded=True), Field("Own", "string", "own"), Field("dash", "int", "-,"), Field("hidden", "int", "-")])
    return t("nation").select("n_nationkey", encode(F.struct(F.col("n_nationkey").alias("Base"), F.col("n_name").alias("own"), F.lit(1).alias("-")), r.struct()).alias("j"))


@_query("SELECT event_id, true AS same FROM events")
def roundtrip(t):
    e = t("events").select("event_id", F.struct("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.array("user_id").alias("ids")).alias("v"))
    schema = "event_id bigint, event_type string, value double, ts timestamp, ids array<bigint>"
    return e.select("event_id", (decode(encode("v", schema), schema)["value"] == F.col("v").cast(f"struct<{schema}>")).alias("same"))


@_query("SELECT event_id, '{\"v\":{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '},\"m\":{\"x\":{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '},\"y\":[1.5,\"<\",null]}}' AS j FROM events")
def encode_dynamic(t):
    m = F.create_map(F.lit("x"), F.parse_json("props"), F.lit("y"), F.parse_json(F.lit('[1.50, "<", null]')))
    return t("events").select("event_id", encode(F.struct(F.parse_json("props").alias("v"), m.alias("m")), "v variant, m map<string,variant>").alias("j"))


@_query("SELECT n_nationkey, n_name AS name, n_regionkey::BIGINT AS region, '{\"the name\":\"' || n_name || '\",\"-\":' || n_regionkey || '}' AS j FROM nation")
def decode_odd_names(t):
    r = Record([Field("the name", "string"), Field("dash", "bigint", "-,")]).struct()
    d = decode(_doc('{"other":[],"the name":"', F.col("n_name"), '","-":', F.col("n_regionkey"), "}"), r)["value"]
    return t("nation").select("n_nationkey", d.alias("d")).select("n_nationkey", F.col("d")["the name"].alias("name"), F.col("d")["-"].alias("region"), encode("d", r).alias("j"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '{\"t\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z\"}' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'value' END AS kind FROM orders")
def encode_year_error(t):
    late = F.timestamp_micros(F.lit(253402300800000000) + F.col("o_orderkey"))
    v = F.struct(F.when(F.col("o_orderkey") % 3 == 0, late).otherwise(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return t("orders").select("o_orderkey", encode_checked(v, "t timestamp").alias("d")).select("o_orderkey", "d.text", "d.error.kind")


@_query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{\"x\":' || n_nationkey || '}' END AS j, CASE WHEN n_nationkey % 2 = 1 THEN 'hook' END AS kind FROM nation")
def encode_hook_error(t):
    def even(v: int) -> str:
        if v % 2:
            raise ValueError("odd")
        return str(v)

    register_codec("even", encode=even)
    r, v = Record([Field("x", "int", kind="hook:even")]).struct(), F.struct(F.col("n_nationkey").alias("x"))
    return t("nation").select("n_nationkey", encode(v, r).alias("j"), encode_checked(v, r)["error"]["kind"].alias("kind"))


@_query("SELECT s_suppkey, 'é' AS a, (16 + len(s_suppkey::VARCHAR))::INTEGER AS type_at, (12 + len(s_suppkey::VARCHAR))::INTEGER AS syntax_at FROM supplier")
def decode_offsets(t):
    mismatch = decode(_doc('{"a":"é","b":"', F.col("s_suppkey"), '"}'), "a string, b bigint")
    syntax = decode(_doc('{"a":"é","', F.col("s_suppkey"), '";1}'), "a string")
    return t("supplier").select("s_suppkey", mismatch["value"]["a"].alias("a"), mismatch["error"]["offset"].alias("type_at"), syntax["error"]["offset"].alias("syntax_at"))


@_query(
    "SELECT c_custkey, c_name AS name, 'v' || c_nationkey AS label, c_custkey * 1000003 AS id, 2::BIGINT AS seats, c_acctbal AS price, false AS is_error FROM customer"
)
def decode_deep(t):
    """A list of records with label maps, quoted ids, maps with integer keys, escapes and keys that the schema lacks."""
    doc = _doc(
        '{"kind":"List","items":[{"metadata":{"labels":{"app":"v', F.col("c_nationkey"), '","tier":"\\u00e9\\n"},"annotations":{},"uid":null},"spec":{"name":"', F.col("c_name"),
        '","containers":[{"image":"a\\/b","ports":[80,443]},{"args":["-c","\\"x\\""]}]},"status":{"phase":[[[1.5,2]],[]]}}],"max_id_str":"', F.col("c_custkey") * 1000003,
        '","areas":{"7":[1,2],"205":[]},"price":', F.col("c_acctbal"), ',"extra":{"deep":[{"x":[]}]}}',
    )
    item = Record([
        Field("metadata", Record([Field("labels", "map<string,string>"), Field("annotations", "map<string,string>"), Field("uid", "string")])),
        Field("spec", Record([Field("name", "string"), Field("containers", "array<struct<image: string, ports: array<int>, args: array<string>>>")])),
        Field("status", Record([Field("phase", "array<array<array<double>>>")])),
    ]).struct()
    r = T.StructType([T.StructField("items", T.ArrayType(item)), *Record([Field("max_id_str", "bigint", ",string"), Field("areas", "map<bigint,array<bigint>>"), Field("price", "double")]).struct()])
    d = t("customer").select("c_custkey", decode(doc, r).alias("d")).select("c_custkey", "d.*")
    one = F.col("value.items")[0]
    return d.select("c_custkey", one["spec"]["name"].alias("name"), one["metadata"]["labels"]["app"].alias("label"), F.col("value.max_id_str").alias("id"), F.size(F.col("value.areas")[F.lit(7).cast("bigint")]).cast("bigint").alias("seats"), F.col("value.price").alias("price"), F.col("error").isNotNull().alias("is_error"))


@_query("SELECT p_partkey, '[' || p_partkey AS rest FROM part")
def unread_rest(t):
    return t("part").select("p_partkey", unread(_doc('{"x":', F.col("p_partkey"), "} [", F.col("p_partkey"))).alias("rest"))


_LINES = "CASE WHEN p_partkey % 5 = 0"


@_query(f"SELECT p_partkey, {_LINES} THEN NULL ELSE p_partkey END AS x, {_LINES} THEN 'syntax' WHEN p_partkey % 5 = 1 THEN 'type' END AS kind FROM (SELECT p_partkey FROM part) WHERE p_partkey % 5 <> 1 UNION ALL SELECT p_partkey, NULL, 'type' FROM part WHERE p_partkey % 5 = 1")
def ndjson_skip_errors(t):
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.lit("{bad}")).when(k == 1, F.lit('{"x":"no"}')).otherwise(_doc('{"x":', F.col("p_partkey"), "}"))
    rows = decode_records(t("part").select("p_partkey", line.alias("value")), "x bigint", "skip")
    return rows.select("p_partkey", F.col("value.x").alias("x"), F.col("error.kind").alias("kind"))


@_query("SELECT p_partkey, p_partkey AS x FROM part WHERE p_partkey % 5 <> 0")
def ndjson_drop_errors(t):
    line = F.when(F.col("p_partkey") % 5 == 0, F.lit("{bad}")).otherwise(_doc('{"x":', F.col("p_partkey"), "}"))
    return decode_records(t("part").select("p_partkey", line.alias("value")), "x bigint", "drop").select("p_partkey", F.col("value.x").alias("x"))


@_query("SELECT p_partkey, 0 AS position, p_partkey AS x, false AS bad FROM part UNION ALL SELECT p_partkey, 1, NULL, true FROM part UNION ALL SELECT p_partkey, 2, p_partkey + 1, false FROM part")
def ndjson_concat_values(t):
    text = _doc('{"x":', F.col("p_partkey"), '} {"x":,\n', '\n{"x":\n', F.col("p_partkey") + 1, "}")
    found = split_values(t("part").select("p_partkey", text.alias("value")))
    return found.select("p_partkey", "position", decode("value", "x bigint")["value"]["x"].alias("x"), F.col("error").isNotNull().alias("bad"))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base.rstrip('/')}/ndjson-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="ndjson-")


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def ndjson_file_roundtrip(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    path = _folder(c.sparkSession) + "/rows"
    write_ndjson(c, path)
    return read_values(c.sparkSession, path, c.schema, "skip").select("value.*")


@_query("SELECT n_nationkey, n_name FROM nation")
def stream_ndjson(t):
    n = t("nation").select("n_nationkey", "n_name")
    spark, path = n.sparkSession, _folder(n.sparkSession)
    write_ndjson(n, path + "/in")
    rows = read_stream(spark, path + "/in", n.schema, "drop").select("value.*")
    write_stream(rows, path + "/out", path + "/check", once=True).awaitTermination()
    return decode_records(spark.read.text(path + "/out"), n.schema).select("value.*")
