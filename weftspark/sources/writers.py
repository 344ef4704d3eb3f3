"""Writers of rows, of results that are merged into older ones, and of tables that are kept by what made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators.mixing import mixture
from weftspark.sources.readers import last_lines, lines


def append_lines(rows: DataFrame, folder: str) -> None:
    """Rows added to a folder of JSON lines; which of several rows of a key counts is settled when it is read."""
    rows.write.mode("append").json(folder)


def reorganized(spark: SparkSession, path: str, schema: str, out: str, key: str = "question_id") -> None:
    """The last row of each key, in the order of the keys, to another folder."""
    last_lines(lines(spark, path, schema), key).orderBy(key).write.mode("overwrite").json(out)


def save(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One table in place of whatever was there, so that parts of an earlier run can't be read with it."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def cache_key(**parameters: object) -> str:
    """First 16 hex digits of the sha256 of all parameters in canonical JSON."""
    text = json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """The table of these parameters, built and written if it isn't there complete."""
    path = f"{folder}/{cache_key(**parameters)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        save(build(), path)
    return spark.read.parquet(path)


def mixture_report(rows: DataFrame) -> str:
    """JSON with the number of rows and of those of each source, and their parts; sources are few."""
    found = mixture(rows).orderBy("source").collect()
    return json.dumps({"total": sum(r.n for r in found), "dataset_numbers": {r.source: r.n for r in found}, "dataset_ratio": {r.source: r.ratio for r in found}}, ensure_ascii=False)


def merged(old: Mapping, new: Mapping) -> dict:
    """Results of an earlier run with those of a new one: keys of either; objects are joined, the new one's entries first; other values stay the old ones."""
    out = dict(new)
    for k, v in old.items():
        if isinstance(v, Mapping) and isinstance(new.get(k), Mapping):
            out[k] = {**v, **new[k]}
        else:
            out[k] = v
    return out


def outputs(rows: DataFrame, generator: str, path: str, order: str = "idx") -> None:
    """Outputs in the order of their index with the name of the generator, as one file of JSON lines."""
    rows.withColumn("generator", F.lit(generator)).orderBy(order).coalesce(1).write.mode("overwrite").json(path)
