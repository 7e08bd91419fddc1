"""Row-wise Python work over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches sent to Python hold at most so many bytes, but one row at least.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's Python stages by size, whatever the rows hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(frame: DataFrame, setup: Callable[[], Callable[[dict], tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """One row of ``schema`` for each row of ``frame``.

    ``setup()`` runs once per task and returns the function from a row (as a dict) to a tuple.
    """
    bounded_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row = setup()
        for batch in batches:
            names = batch.schema.names
            rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            made = [of_row(dict(zip(names, row, strict=True))) for row in rows]
            if made:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return frame.mapInArrow(run, ddl)
