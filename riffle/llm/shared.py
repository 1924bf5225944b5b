"""Helpers the operators share: the shared folder, vectors, words and digests."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of rows that go to a Python worker at once. Rows are worked on one by one, so larger batches only cost memory.
BATCH_BYTES = 4 * 2**20


def bounded_batches(spark: SparkSession) -> None:
    """Keep what workers hold at once small for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the setting is absent and the session runs on this machine alone (tests) a temporary folder is made and set.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='riffle-')}")
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty place in the shared folder, with the scheme of its file system, so that tasks that
    write files of their own and Spark mean the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again, so that later jobs do not
    recompute them and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def usable_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``mark, id, vec`` of the rows with an id and a non-empty vector of finite components, written once: the mark tells
    rows apart that share an id."""
    ok = (
        f"`{vec_id}` IS NOT NULL AND `{vector}` IS NOT NULL AND size(`{vector}`) > 0 AND forall(`{vector}`, "
        "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    kept = df.filter(ok).select(F.monotonically_increasing_id().alias("mark"), F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vec"))
    return stored(kept, "vectors")


def bucket(column: str, parts: int, seed: int = 0):
    """A bucket number from 0 that depends on the value alone."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(parts)).cast("int")


def by_dimension(table: pa.Table, vec_id: str, vector: str, mark: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, float64 matrix and marks per vector length, sorted by id and mark."""
    found = {}
    lengths = pc.list_value_length(table[vector]).to_numpy()
    for n in np.unique(lengths):
        part = table.filter(pa.array(lengths == n))
        ids, marks = part[vec_id].to_numpy(), part[mark].to_numpy()
        matrix = pc.list_flatten(part[vector]).to_numpy().astype(np.float64).reshape(len(ids), int(n))
        order = np.lexsort((marks, ids))
        found[int(n)] = (ids[order], matrix[order], marks[order])
    return found


def places(marks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted mark stands in ``marks``, or -1."""
    order = np.argsort(marks)
    at = np.minimum(np.searchsorted(marks, wanted, sorter=order), max(0, len(marks) - 1))
    return np.where(marks[order[at]] == wanted, order[at], -1) if len(marks) else np.full(len(wanted), -1)


def tiles(vectors: DataFrame, is_query: str, rows_per_block: int, queries_per_block: int):
    """Candidates (``mark, id, vec``) and queries (``query_mark, query_id, query``) cogrouped by (candidate block, query block).

    Both sides are copied to the tiles of their row or column of the grid, like the factors of a
    blocked matrix product; a row's block follows from its mark, so rows that share an id spread like others.
    Returns None if there is no query.
    """
    n = vectors.agg(F.count("*").alias("rows"), F.count_if(F.expr(is_query)).alias("queries")).first()
    if not n["queries"]:
        return None
    across, down = -(-n["rows"] // rows_per_block), -(-n["queries"] // queries_per_block)
    candidates = vectors.withColumn("cb", bucket("mark", across)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    )
    queries = vectors.filter(is_query).withColumn("qb", bucket("mark", down, 1))
    queries = queries.select(
        F.col("mark").alias("query_mark"),
        F.col("id").alias("query_id"),
        F.col("vec").alias("query"),
        "qb",
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"),
    )
    return candidates.groupBy("cb", "qb").cogroup(queries.groupBy("cb", "qb"))
