"""Tables written once to the folder that driver and executors share, and read back: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local run gets its own folder, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("factloom.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.shared.dir", folder)
    return folder.rstrip("/")


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind staged tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/factloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
