"""Exchanges and cuts of lineage that hold on a cluster that loses executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import dropping_shuffles


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one, on local masters only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark, "_stratum_folder", None)
        if not where:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = spark._stratum_folder = tempfile.mkdtemp(prefix="stratum-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; partitions and their order stay.

    The shuffle files made on the way go at once; the files that remain need none of them and go with the session.
    ``keep_partitioning``: later steps know how the rows are dealt, and do not deal them again. For that
    the plan must not change as it runs.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
        fs, p = _path(spark, sc._jsc.sc().getCheckpointDir().get())
        fs.deleteOnExit(p)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    with dropping_shuffles(spark):
        try:
            if keep_partitioning:
                spark.conf.set("spark.sql.adaptive.enabled", "false")
            return df.select("*").checkpoint(eager=True)  # a query of its own, so that it takes the settings up
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted with the session."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` as a Parquet table in the shared folder, to be deleted with the session at the latest; its path."""
    spark = df.sparkSession
    path = fresh_folder(spark, f"{name}-{uuid.uuid4().hex}")
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def partitions(spark: SparkSession) -> int:
    """As many buckets as the session's shuffles have partitions, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_ids(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which ``repartition(n, ...)`` deals exactly one to each partition: by their hashes among some more numbers."""
    rows = spark.range(40 * n + 400).select(F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in rows}
    return [int(found[p]) for p in range(n)]


def by_bucket(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Bucket b of n goes to partition b, so that each partition holds one bucket."""
    return df.repartitionById(n, F.col(column).cast("int"))


def set_aside(df: DataFrame, own) -> tuple[DataFrame, dict[str, str]]:
    """Columns whose names clash with those an operator adds, under other names meanwhile, and the way back."""
    taken = {c.lower() for c in df.columns}
    back = {}
    for c in df.columns:
        if c.lower() in own:
            k = 0
            while (name := f"_held{k}_{c}").lower() in taken:
                k += 1
            taken.add(name.lower())
            back[name] = c
    return df.withColumnsRenamed({c: h for h, c in back.items()}), back


def put_back(df: DataFrame, back: dict[str, str], appended=()) -> DataFrame:
    """Columns set aside under their own names again; those that clash with appended ones go."""
    gone = [h for h, c in back.items() if c.lower() in appended]
    return df.drop(*gone).withColumnsRenamed({h: c for h, c in back.items() if h not in gone})
