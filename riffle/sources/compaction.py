"""Landed files packed into payload tables of few, large files, each response exactly once.

A run packs what no committed run holds. Its rows go under ``payloads/batch=<n>``, and a row in the small table
``batches`` commits them; a run that dies in between leaves rows that no reader selects, and the next one, which has
the same number, replaces them. Landed files are not changed after they landed; they may be deleted once a committed run
holds them. One run at a time packs a landing directory.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle import schemas
from riffle.sources import payloads

#: Bytes of responses that one file of a payload table holds.
FILE_BYTES = 128 * 2**20

_BATCHES = T.StructType([T.StructField("files", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("batch", T.IntegerType())])

_PLAN = "source string, call_id string, bytes long, bin long"


def batches(spark: SparkSession, path: str) -> DataFrame:
    """``files, bytes, batch`` of the committed runs."""
    try:
        return spark.read.schema(_BATCHES).parquet(f"{path}/batches")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _BATCHES)
        raise


def read_compacted(spark: SparkSession, path: str, keys: T.StructType = schemas.NO_KEYS) -> DataFrame:
    """The payload table of all committed runs; a filter on ``source`` prunes its folders."""
    done = [row["batch"] for row in batches(spark, path).select("batch").collect()]  # a number per run
    schema = schemas.keyed(schemas.PAYLOADS, keys)
    if not done:
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    stored = spark.read.schema(with_batch).parquet(f"{path}/payloads")
    return stored.filter(F.col("batch").isin(done)).select(*schema.names)


def read_both(spark: SparkSession, landing: str, path: str, keys: T.StructType = schemas.NO_KEYS) -> DataFrame:
    """Compacted responses, and landed ones that are not compacted yet."""
    packed = read_compacted(spark, path, keys)
    landed = payloads.read_landing(spark, landing, keys)
    return packed.unionByName(landed.join(packed.select("call_id"), "call_id", "left_anti").select(*packed.columns))


def bins(files: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``files`` (``source, call_id, bytes``) with the number of the bin that each goes to, by source.

    Files are ranked by (source, call id) through a range partitioning; where a file's bytes begin in its source is the sum over
    earlier partitions, a row each, and over its own partition up to it, and a bin is a stretch of ``file_bytes`` of them. So a
    bin exceeds that by one file at most.
    """
    order = ["source", "call_id"]
    ranged = files.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "source").orderBy("call_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranged.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    totals = begun.groupBy("source", "part").agg(F.max(F.col("before") + F.col("bytes")).alias("all"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))
    placed = begun.join(offsets, ["source", "part"])
    number = F.floor((F.col("before") + F.col("offset")) / F.lit(file_bytes)).cast("long")
    return placed.select("source", "call_id", "bytes", number.alias("bin"))


def compact(
    spark: SparkSession,
    landing: str,
    path: str,
    keys: T.StructType = schemas.NO_KEYS,
    file_bytes: int = FILE_BYTES,
) -> int:
    """Packs landed files that no committed run holds; returns how many. Nothing is committed if there are none.

    The landing directory must hold a file, as for ``payloads.read_landing``.
    """
    landed = payloads.read_landing(spark, landing, keys)
    packed = read_compacted(spark, path, keys)
    fresh = landed.join(packed.select("call_id"), "call_id", "left_anti")
    sized = fresh.select("source", "call_id", F.octet_length("payload").cast("long").alias("bytes"))
    batch = (batches(spark, path).agg(F.max("batch")).first()[0] or 0) + 1
    # What one run packs is fixed here: files that land later wait for the next one.
    plan_path = f"{path}/plans/batch={batch}"
    bins(sized, file_bytes).write.mode("overwrite").parquet(plan_path)
    plan = spark.read.schema(_PLAN).parquet(plan_path)
    sums = [F.count("*").alias("files"), F.sum("bytes").alias("bytes"), (F.max("bin") + 1).alias("bins")]
    sources = plan.groupBy("source").agg(*sums).orderBy("source").collect()  # a row per kind of source
    if not sources:
        return 0
    files, size = (sum(row[c] for row in sources) for c in ("files", "bytes"))
    # One task writes one bin: bins are numbered through, source by source.
    ends = list(accumulate(row["bins"] for row in sources))
    starts = spark.createDataFrame([(row["source"], end - row["bins"]) for row, end in zip(sources, ends)], "source string, start long")
    numbered = plan.join(F.broadcast(starts), "source").select("call_id", (F.col("bin") + F.col("start")).cast("int").alias("task"))
    rows = landed.join(numbered, "call_id")
    dealt = rows.repartitionById(ends[-1], "task").sortWithinPartitions(*keys.names, "source", "gauge_id", "call_id")
    columns = schemas.keyed(schemas.PAYLOADS, keys).names
    dealt.select(*columns).write.mode("overwrite").partitionBy("source").parquet(f"{path}/payloads/batch={batch}")
    told = spark.range(1).select(F.lit(files).cast("long").alias("files"), F.lit(size).cast("long").alias("bytes"))
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")
    return files
