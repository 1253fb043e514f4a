"""Rows through Python in batches whose size is bounded by what they hold, not by their number."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch that a worker is given, and signs and rows of one that it gives back.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of texts that Python workers are given; batches of numbers stay as they are. The setting is left in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _signs(value) -> int:
    return len(value) if isinstance(value, str) else sum(map(len, value)) if isinstance(value, list) else 0


def map_texts(df: DataFrame, schema: str, rows_of: Callable[..., Iterable[tuple]]) -> DataFrame:
    """The tuples that ``rows_of`` makes of each row's values; a worker holds one small batch of rows and one of results."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, signs = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows_of(*(column[i].as_py() for column in batch.columns)):
                    held.append(row)
                    signs += sum(map(_signs, row))
                    if len(held) >= BATCH_ROWS or signs >= BATCH_BYTES:
                        yield pack(held)
                        held, signs = [], 0
        if held:
            yield pack(held)

    return df.mapInArrow(run, schema)
