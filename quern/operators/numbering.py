"""Dense numbers in a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut, shuffle_width


def number(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` with ``name`` = start, start + 1, ... by ``order`` (which should be total).

    Range partitions are sorted on their own; only one count per partition reaches the driver.
    """
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            pos = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pos], names=[*batch.schema.names, "_pos"])

    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(count, schema))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    at, offsets = start, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(at).cast("long")]
        at += n
    base = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(start).cast("long")
    return placed.withColumn(name, base + F.col("_pos")).drop("_part", "_pos")
