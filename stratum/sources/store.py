"""Tables that later steps read again, as Parquet in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside drop their own shuffle files as they end: for results that are kept as files."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the file: columns are pruned, executors may come and go, plans stay short.

    The folder is ``spark.checkpoint.dir``; where that is unset a temporary one, on local masters only.
    Tables go with the session, the shuffle files made on the way at once.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_stratum_tables", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark._stratum_tables = tempfile.mkdtemp(prefix="stratum-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    path = f"{where.rstrip('/')}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
