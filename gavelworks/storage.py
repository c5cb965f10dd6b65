"""Where intermediate results go: lineage is cut with checkpoint() in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session without the setting gets one of its own."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="gavelworks-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that cut() or keep() gave and that nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        if getattr(df, "kept_at", None):
            _delete(df.sparkSession, df.kept_at)
        elif plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
            _delete(df.sparkSession, plan.rdd().getCheckpointFile().get())


#: With this set, the shuffle files of a query are deleted when it has ended, and not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """df, written once as a compressed table in the shared folder and read from there; deleted when the session's JVM ends.

    Unlike cut() it takes little disk and is read by column; it is for wide rows that several branches read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept
