"""Writing: shared scratch tables, manifests, replacing, merging."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: a local folder in local mode, an error on a cluster, whose executors share none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors don't matter."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that nothing reads any more."""
    path, fs = _file(df.sparkSession, df._written_at)
    fs.delete(path, True)


@contextmanager
def files_released(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the table they were for is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` where its scan has fewer parts than the cluster has cores; as it is otherwise.

    A file of one row group is one task, however large the work on its rows; inputs of many files need no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def content_hash(df: DataFrame) -> DataFrame:
    """One row, (rows, digest): the same for the same rows in any order or partitioning.

    Each row's SHA-256 of its JSON gives a number; their sum over all rows is exact in decimal.
    """
    cells = F.sha2(F.encode(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), "UTF-8"), 256)
    part = F.conv(F.substring(cells, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of each key the row that comes last in ``order``: what remains of upserts."""
    last = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order]))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")


def merged(existing: DataFrame, incoming: DataFrame, key: list[str], delete: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Last write wins: rows of ``incoming`` replace those of equal key; keys in ``delete`` go.

    Of incoming rows of one key the last by ``order`` stays, of equal ones that of the largest JSON, so the result
    doesn't depend on the rows' order.
    """
    both = existing.withColumn("__v", F.lit(0)).unionByName(incoming.withColumn("__v", F.lit(1)))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in existing.columns]))
    out = latest(both, key, ["__v", *order, whole.desc()]).drop("__v")
    return out if delete is None else out.join(delete.select(*key), key, "left_anti")


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``, after undoing a ``replace_table`` that ended between its two renames.

    Then the new table is whole beside the path, but the writer has not heard that it counts: the old one comes back.
    """
    target, fs = _file(spark, path)
    beside = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.*-*")) or []
    found = {"old": [], "new": []}
    for x in beside:
        kind = x.getPath().getName()[len(target.getName()) + 1 :].split("-")[0]
        if kind in found:
            found[kind].append(x)
    if not fs.exists(target) and found["old"]:
        last = max(found["old"], key=lambda x: x.getModificationTime())
        fs.rename(last.getPath(), target)
        found["old"].remove(last)
    for x in found["old"] + found["new"]:
        fs.delete(x.getPath(), True)
    return bool(fs.exists(target))


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then swap; an empty result is an error that leaves the old table.

    One writer at a time. Between the two renames there is no table at the path: readers retry, and a writer that
    ended there is undone by ``recover``, which this calls first.
    """
    spark = df.sparkSession
    recover(spark, path)
    target, fs = _file(spark, path)
    fresh, old = (_file(spark, f"{path}.{s}-{uuid.uuid4().hex}")[0] for s in ("new", "old"))
    df.write.parquet(fresh.toString())
    if spark.read.parquet(fresh.toString()).limit(1).count() == 0:
        fs.delete(fresh, True)
        raise ValueError("nothing to write")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(fresh, target):
        raise OSError(f"can't put the new table at {path}")
    if fs.exists(old):
        fs.delete(old, True)


def write_jsonl(df: DataFrame, path: str, manifest: str | None = None) -> DataFrame:
    """JSON lines, and a manifest of the rows' count and digest; returns the manifest's row."""
    df.write.mode("overwrite").json(path)
    row = content_hash(df)
    if manifest:
        row.coalesce(1).write.mode("overwrite").json(manifest)
    return row
