"""Groups of rows inside a task, read one batch at a time.

A table dealt out by a key and sorted by it inside its partitions is read as Arrow batches, and
each group is handed on as soon as its last row is seen: no call per group between Spark and
Python, and never more than one batch and one group in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows an Arrow batch in this session.

    A batch is held by the executor and by its Python worker, and rows here are whole texts: the
    usual 10,000 of them take tens of MB on either side for every task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per run of equal ``key`` (a column without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if held and (i or held[0].column(key)[0].as_py() != keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def per_group(df: DataFrame, key: str, order: list[str], function: Callable[[pa.Table], dict[str, list] | None], schema: str) -> DataFrame:
    """``function`` on every group of ``key``, rows in ``order``; it returns columns or None.

    The caller bounds the size of a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in arrow.names}
        for group in grouped(batches, key):
            found = function(group)
            if found:
                for name in out:
                    out[name].extend(found[name])
                if len(out[arrow.names[0]]) >= 5_000:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    out = {name: [] for name in arrow.names}
        if out[arrow.names[0]]:
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``function`` on every Arrow batch; it returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch), schema=arrow)

    return df.mapInArrow(run, schema)
