"""NDJSON as a stream: a stateless source of decoded records and a text sink with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import encode
from ..options import DecodeOptions, EncodeOptions
from ..schema import Record
from ..sources.ndjson import decode_records


def read_stream(spark: SparkSession, path: str, schema: "T.DataType | Record | str", mode: str = "fail", options: DecodeOptions = DecodeOptions(), files_per_trigger: int | None = None) -> DataFrame:
    """Records of the files that arrive in a folder: value, error, raw."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return decode_records(reader.text(path), schema, mode, options)


def write_stream(df: DataFrame, path: str, checkpoint: str, options: EncodeOptions = EncodeOptions(), once: bool = False) -> StreamingQuery:
    """Each row as one line of JSON; the file sink's log makes every record appear once."""
    text = encode(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, options)
    lines = df.select(F.coalesce(text, F.raise_error(F.lit("a row has no JSON form"))).alias("value"))
    writer = lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
