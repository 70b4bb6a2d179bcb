"""What the training-data operators share: tables, the shared scratch folder, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are compared; smaller than any other id.
NULL_ID = -(2**63)
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one long that a join broadcasts: 16 MB.
FEW_ROWS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df``, a written table of ids, as the broadcast side of a join if it has ``most`` rows or fewer; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def files_released(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the table they were for is written, not when the driver next collects its garbage."""
    was = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, was)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name; other columns can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 1024) -> DataFrame:
    """``mapInArrow`` in slices of ``rows`` rows. ``make`` runs once a task and returns the function of a slice, which gives a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":  # Spark's default: too many whole texts at once
        conf.set(ARROW_ROWS, "2048")
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(fields)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = f(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([made[x.name].cast(x.type) if isinstance(made[x.name], pa.Array) else pa.array(made[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, fields)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings; null is the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]
