"""Tables that operators write into the folder that all executors share, to cut the lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="loam-")
    return _own_dir[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loam/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, bucketed: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back, so lost executors cost no recomputation.

    bucketed: a column that the rows are dealt by, into as many sorted buckets as shuffles have partitions, so that later
    joins on it neither shuffle nor sort this table again.
    """
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{own}"
    if bucketed:
        tag = "loam_" + own.replace("-", "_")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, bucketed).sortBy(bucketed).option("path", path).saveAsTable(tag)
        out = spark.table(tag)
        out.loam_table = tag
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.loam_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    if getattr(df, "loam_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.loam_table}")
    if getattr(df, "loam_path", None):
        _delete(df.sparkSession, df.loam_path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more: it does so as the driver's garbage is collected, else only by spark.cleaner.periodicGC.interval."""
    gc.collect()
    spark._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete all that the operators of this application wrote into the shared folder, once no result of theirs is read any more."""
    _delete(spark, _folder(spark))
