"""Landed responses: one record per source call, holding the raw text.

A payload table has the columns ``source``, ``gauge_id``, ``call_id`` and ``payload``. It comes
from a directory of response files, laid out as ``source=usgs/gauge_id=1/<anything>``, or from a
compacted table with the same columns, which is the better form for very many small responses. Keys
such as a network lead the columns, and the directories (``network_id=7/source=usgs/...``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle import schemas

_PARTITIONS = "source STRING, gauge_id INT"


def _named(files: DataFrame, keys: T.StructType) -> DataFrame:
    path = F.col("_metadata.file_path").alias("call_id")
    return files.select(*keys.names, "source", "gauge_id", path, F.col("value").alias("payload"))


def _file_schema(keys: T.StructType) -> str:
    return ", ".join(["value STRING", *(f"{f.name} {f.dataType.simpleString()}" for f in keys), _PARTITIONS])


def read_landing(spark: SparkSession, path: str, keys: T.StructType = schemas.NO_KEYS) -> DataFrame:
    """Response files of a landing directory; keys, ``source`` and ``gauge_id`` prune directories."""
    return _named(spark.read.schema(_file_schema(keys)).text(path, wholetext=True), keys)


def stream_landing(
    spark: SparkSession, path: str, max_files: int = 10_000, keys: T.StructType = schemas.NO_KEYS
) -> DataFrame:
    """The same as a stream of newly landed files, at most ``max_files`` of them in a micro-batch."""
    reader = spark.readStream.schema(_file_schema(keys)).option("maxFilesPerTrigger", max_files)
    return _named(reader.text(path, wholetext=True), keys)


def read_payload_table(spark: SparkSession, path: str, keys: T.StructType = schemas.NO_KEYS) -> DataFrame:
    """A compacted payload table in parquet."""
    return spark.read.schema(schemas.keyed(schemas.PAYLOADS, keys)).parquet(path)
