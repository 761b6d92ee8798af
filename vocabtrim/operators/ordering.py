"""Distributed row numbering.

``row_number() OVER (ORDER BY ...)`` without ``PARTITION BY`` moves every row
into one task, and ``PARTITION BY class`` does the same for a class that holds a
third of the data.  :func:`with_row_number` gives the same numbers with a range
shuffle instead: rows are range-partitioned and sorted on (group, order), each
partition numbers its rows locally, and a table with one row per
(partition, group) — bounded by ``partitions + groups`` — supplies the offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PID, _LOCAL, _N, _FIRST, _OFF = "_vt_pid", "_vt_local", "_vt_n", "_vt_first", "_vt_off"


def _num_partitions(df: DataFrame, requested: int | None) -> int:
    if requested:
        return requested
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn",
                    groups: Sequence[str] = (), num_partitions: int | None = None,
                    checkpoint: bool = True) -> DataFrame:
    """Add a 1-based ``name`` = row_number() over (partition by groups order by order).

    ``order`` must be a total order inside each group (add a unique tie-breaker),
    which makes the numbering repeatable after a task or executor is lost.  With
    ``checkpoint`` the sorted frame is written to the shared checkpoint folder so
    the offsets and the rows come from one materialisation.

    There is one path at every size, and no row is lost: a NULL group is a group like
    any other.
    """
    keys = [F.col(g).asc() for g in groups] + list(order)
    n = _num_partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_LOCAL, F.monotonically_increasing_id()
                            - F.shiftleft(F.col(_PID).cast("long"), 33)))
    if checkpoint:
        ranged = checkpoint_once(ranged)
    per_part = (ranged.groupBy(_PID, *groups)
                .agg(F.count(F.lit(1)).alias(_N), F.min(_LOCAL).alias(_FIRST)))
    w = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(_PID, *groups, _FIRST,
                              F.coalesce(F.sum(_N).over(w), F.lit(0)).alias(_OFF))
    offsets = offsets.select(F.col(_PID).alias("_vt_p"), _FIRST, _OFF,
                             *[F.col(g).alias(f"_vt_g{i}") for i, g in enumerate(groups)])
    if not groups:
        # at most one row per partition: a proven bound, safe to broadcast
        offsets = F.broadcast(offsets)
    same = F.col(_PID) == F.col("_vt_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_vt_g{i}"))
    out = ranged.join(offsets, same).drop("_vt_p", *[f"_vt_g{i}" for i in range(len(groups))])
    return (out.withColumn(name, (F.col(_OFF) + F.col(_LOCAL) - F.col(_FIRST) + 1).cast("long"))
               .drop(_PID, _LOCAL, _FIRST, _OFF))


def checkpoint_once(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared folder that computes ``df`` only once.

    ``checkpoint(eager=True)`` runs one job to evaluate the frame and a second
    one to write the files; without a persisted copy the second job recomputes
    the whole lineage.  The copy is dropped as soon as the files exist.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read (a budget count, a ranking, a
    join) to the shared checkpoint folder once, instead of recomputing its
    lineage for each of them.  Used for vocabulary-sized tables, not corpora."""
    return checkpoint_once(df)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint folder and read it back: one
    job, after which the lineage starts at the files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scalar(df: DataFrame, expr: Column):
    """Evaluate a one-row aggregate on the driver (budgets and loop counts only)."""
    return df.agg(expr.alias("v")).first()["v"]
