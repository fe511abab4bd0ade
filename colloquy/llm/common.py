"""Helpers shared by the training-data operators: checkpoints and components."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only
    where it is unset and Spark runs in one process (tests) a temporary one is made; on a
    cluster that would be a folder of the driver alone, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder and the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch: texts can be long, and a batch is in memory several times.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns; nulls and 64-bit ids stay exact."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for f in arrow for v in (out[f.name],)], schema=arrow)

    return df.mapInArrow(run, schema)


def worker_state(name: str, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = vars(sys.modules.setdefault("_colloquy_worker", types.ModuleType("_colloquy_worker")))
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``limit`` bytes at most; a longer row stands alone."""
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(batch.column(column)), pa.int64()), 0)).to_numpy()
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and
    small-star steps; rows ``(node, component)``, where ``component`` is the smallest
    node reachable. Nodes without edges, and the smallest nodes themselves, are absent. Null ends and loops are ignored.

    Each step only needs minima by key, which Spark combines before the shuffle, and
    joins that adaptive execution can split, so a node with very many edges is no
    bottleneck. The edges of each round are checkpointed.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a is not null and _b is not null and u > v")
        .select("u", "v")
        .distinct()
    )
    e = cut(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
