"""Running sums over one order of all rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.sinks import written

ROWS = 200_000


def running_sums(rows: DataFrame, order: str, columns: dict[str, str], descending: bool = False, rows_a_part: int = ROWS) -> DataFrame:
    """Adds for each of ``columns`` (name: source) its sum over the rows up to this one; ``order`` can be compared, and is unique.

    Rows are dealt by ranges of ``order`` and written; a range's rows are summed by a window, and the totals of the
    ranges before it, a row a range, are added.
    """
    n = max(1, -(-rows.count() // rows_a_part))
    by = F.desc(order) if descending else F.asc(order)
    rows = written(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "scan-parts")
    inside = W.partitionBy("__part").orderBy(by)
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{name}") for name, c in columns.items()])
    ahead = W.orderBy(F.desc("__part") if descending else F.asc("__part")).rowsBetween(W.unboundedPreceding, -1)  # a row a part
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__{name}").over(ahead), F.lit(0)).alias(f"__{name}") for name in columns])
    out = rows.join(F.broadcast(totals), "__part")
    for name, c in columns.items():
        out = out.withColumn(name, F.sum(c).over(inside) + F.col(f"__{name}"))
    return out.drop("__part", *[f"__{name}" for name in columns])
