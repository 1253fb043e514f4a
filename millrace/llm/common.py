"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows that one Arrow batch holds when Python sees whole texts; keeps a batch of long texts small.
TEXT_BATCH_ROWS = 256
#: Row groups of intermediate tables; a writer holds one of them in memory.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage and survives lost executors.

    ``compact`` deals the rows into partitions of even size first, for results that are small beside what they come
    from: few files instead of one small file for each task.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.hint("rebalance") if compact else df).write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once when rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def map_rows(df: DataFrame, schema: str | StructType, row: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]]) -> DataFrame:
    """Apply a generator over tuples to each partition through Arrow batches.

    ``row()`` is called once per partition on the executor and gives the generator function, so models load there.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = row()

        def tuples() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        held: list[tuple] = []
        for out in step(tuples()):
            held.append(out)
            if len(held) >= 2048:
                yield pack(held, arrow)
                held = []
        if held:
            yield pack(held, arrow)

    return df.mapInArrow(apply, schema)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bounded_sample(df: DataFrame, keys: list[str], limit: int) -> list:
    """About ``limit`` rows, chosen by a hash of the keys (all rows where there are fewer); at most twice as many.

    The rows are counted first and the hash is compared with a bound, so no task sends more than its own share.
    """
    from pyspark.sql import functions as F

    n = df.count()
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(limit / n * (1 << 30)))
    return sorted(df.limit(2 * limit).collect(), key=str)
