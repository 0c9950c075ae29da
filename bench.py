"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from pathlib import Path

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.functions.text import is_valid, json_quote, prepare  # noqa: E402
from tessera.operators.decode import decode  # noqa: E402
from tessera.operators.encode import encode  # noqa: E402
from tessera.options import DecodeOptions, EncodeOptions  # noqa: E402

ITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    names = [x.split()[0] for x in ITEM.split(", ")]
    items = read("lineitem").repartition(int(cpus)).select(F.struct(*names).alias("v")).cache()
    # read back from Parquet, so that no later plan takes the cached result for its own
    folder = tempfile.mkdtemp(prefix="bench-")
    items.select(encode("v", ITEM).alias("s")).write.mode("overwrite").parquet(folder)
    text = spark.read.parquet(folder).repartition(int(cpus)).cache()
    props = read("events").repartition(int(cpus)).select("props").cache()
    pages = read("pages").repartition(int(cpus)).select("html").cache()
    docs = read("documents").repartition(int(cpus)).select("text").cache()
    size = {k: df.agg(F.sum(F.octet_length(c))).first()[0] for k, df, c in (("text", text, "s"), ("props", props, "props"), ("pages", pages, "html"), ("docs", docs, "text"))}
    items.count()
    runs: dict[str, tuple[DataFrame, int]] = {
        "valid": (text.select(is_valid("s")), size["text"]),
        "decode_tiny": (props.select(decode("props", "k bigint")), size["props"]),
        "decode_record": (text.select(decode("s", ITEM)), size["text"]),
        "decode_record_exact_keys": (text.select(decode("s", ITEM, DecodeOptions(fold_keys=False))), size["text"]),
        "decode_record_codec": (text.select(decode("s", ITEM, DecodeOptions(native=False))), size["text"]),
        "decode_dynamic": (text.select(F.try_parse_json("s")), size["text"]),
        "encode_record": (items.select(encode("v", ITEM)), size["text"]),
        "encode_text": (docs.select(json_quote("text")), size["docs"]),
        "encode_html": (pages.select(json_quote("html", EncodeOptions(escape_html=True))), size["pages"]),
    }
    seconds, rate = {}, {}
    for name, (df, n) in runs.items():
        done(df.limit(1000))
        best = float("inf")
        for _ in range(2):
            began = time.time()
            done(df)
            best = min(best, time.time() - began)
        seconds[name], rate[name] = round(best, 3), round(n / best / 1e6 / int(cpus), 2)
    found = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "json_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "mb_per_second_per_core": rate, "sf": float(found[1]) if found else None}))
    sys.stdout.flush()
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
