"""Session helpers: where shared intermediate tables live."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A new local folder is made only where the cluster names none and all executors are threads of this very process
    (tests, a laptop). On any other master an unset folder is an error: executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("parley.shared.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master!r})")
        folder = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("parley.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder which nothing else uses; ``release`` removes it."""
    path = f"{shared_folder(spark)}/parley/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove intermediate tables, by default all that this application has written; results read before stay good."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(made) if paths is None else paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        if path in made:
            made.remove(path)
