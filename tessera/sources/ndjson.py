"""Newline-delimited and concatenated JSON: batch source and sink, with three ways to meet bad records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERROR_DDL
from ..operators.codec import rest, values
from ..operators.decode import decode
from ..operators.encode import encode
from ..options import DecodeOptions, EncodeOptions
from ..schema import Record, plain

MODES = ("skip", "drop", "fail")


def decode_records(lines: DataFrame, schema: "T.DataType | Record | str", mode: str = "fail", options: DecodeOptions = DecodeOptions(), skip: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (value, error, raw) of a frame with the text column `value`; blank lines are no records.

    mode "skip" keeps bad records with their error, "drop" leaves them out, "fail" raises at the first one that is read.
    skip: a predicate on the error's kind; records whose error it refuses fail, as the rest of a stream would.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    others = [c for c in lines.columns if c not in ("value", "error", "raw")]
    rows = lines.select(*others, F.col("value").alias("raw")).filter(~F.col("raw").rlike(r"^[ \t\r]*$"))
    rows = rows.withColumn("_decoded", decode("raw", schema, options))
    # the term that Spark takes for random keeps a filter on the result from being pushed below it and decoding again
    rows = rows.select(*others, F.col("_decoded.value").alias("value"), F.col("_decoded.error").alias("error"), "raw", F.rand(0).alias("_once"))
    if mode == "drop":
        return rows.filter(F.col("error").isNull() & (F.col("_once") >= 0)).drop("_once")
    if mode != "fail" and skip is None:
        return rows.drop("_once")
    refused = F.col("error").isNotNull()
    if skip is not None:
        refused = refused & ~F.coalesce(skip(F.col("error.kind")), F.lit(False))
    return rows.filter(_stop(refused) & (F.col("_once") >= 0)).drop("_once")


def _stop(refused: Column) -> Column:
    """A filter, which no choice of columns takes out: it raises at the first refused record and lets all others pass."""
    return F.when(refused, F.raise_error(F.concat(F.lit("bad JSON record: "), F.col("error.message"))).cast("boolean")).otherwise(F.lit(True))


def read_ndjson(spark: SparkSession, path: str, schema: "T.DataType | Record | str", mode: str = "fail", options: DecodeOptions = DecodeOptions(), skip: Callable[[Column], Column] | None = None) -> DataFrame:
    """One record a line, from one file, a folder or a pattern; splits of a file are read apart."""
    return decode_records(spark.read.text(path), schema, mode, options, skip)


def split_values(texts: DataFrame, column: str = "value") -> DataFrame:
    """The concatenated values of each text, in order: the other columns, position, value (verbatim text) and error.

    Values may span lines or share one. After a malformed value reading goes on behind the first newline after that
    value's start; where there is none, the rest of the text is left.
    """
    others = [c for c in texts.columns if c != column and c not in ("position", "value", "error")]
    error = pa.struct([("kind", pa.string()), ("message", pa.string()), ("offset", pa.int32()), ("value", pa.string()), ("target", pa.string()), ("field", pa.string())])
    part = pa.list_(pa.struct([("position", pa.int32()), ("value", pa.string()), ("error", error)]))

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [{"position": i, "value": t, "error": e} for i, (t, e) in enumerate(values(v))] for v in x.to_pylist()], part)

    split = F.arrow_udf(run, f"array<struct<position: int, value: string, error: {ERROR_DDL}>>")
    return texts.select(*others, F.explode(split(F.col(column))).alias("_v")).select(*others, "_v.position", "_v.value", "_v.error")


def unread(c: "Column | str") -> Column:
    """What split_values() leaves of a text: the malformed or unfinished value behind which it could not go on."""
    s = F.col(c) if isinstance(c, str) else c
    return F.arrow_udf(lambda x: pa.array([None if v is None else rest(v) for v in x.to_pylist()], pa.string()), "string")(s)


def read_values(spark: SparkSession, path: str, schema: "T.DataType | Record | str", mode: str = "fail", options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Files of concatenated values; a file is one task's work, since a value's end is only known by reading up to it."""
    found = split_values(spark.read.text(path, wholetext=True))
    good = decode_records(found.filter("error is null").select("value"), schema, mode, options)
    if mode == "drop":
        return good
    bad = found.filter("error is not null").select(F.lit(None).cast(plain(schema)).alias("value"), "error", F.col("value").alias("raw"))
    if mode == "fail":
        bad = bad.filter(_stop(F.col("error").isNotNull()))
    return good.unionByName(bad)


def write_ndjson(df: DataFrame, path: str, options: EncodeOptions = EncodeOptions(), mode: str = "errorifexists") -> None:
    """Each row as one JSON object and a newline; the write fails as a whole if a value has no JSON form."""
    text = encode(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, options.but(indent="", prefix=""))
    df.select(F.coalesce(text, F.raise_error(F.lit("a row has no JSON form"))).alias("value")).write.mode(mode).text(path)


def iterate(df: DataFrame) -> Iterator[object]:
    """The decoded values of a frame one by one, for callers that read like a decoder does."""
    for row in df.toLocalIterator():
        yield row["value"]
