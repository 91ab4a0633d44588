"""Tables in the folder that driver and executors share, which cut the lineage of what is read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without one a session in local mode gets a temporary folder, which goes
    with the process; on a cluster no folder of one machine would do, and this fails."""
    path = spark.conf.get(SETTING, None) or (_own[0] if _own else None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sketchgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append(path := "file://" + folder)
    return path.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this application has written, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
