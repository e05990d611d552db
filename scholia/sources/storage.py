"""Tables in and out: the shared folder for stored intermediate tables, run directories, JSON stage files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a local session takes a temporary folder,
    and any other has an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scholia-tables-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, by: str) -> DataFrame:
    """stored(), a folder for each value of the column `by`: reads of one value open its folder alone."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_directory(spark: SparkSession, root: str, stamp: str) -> str:
    """root/stamp, or root/stamp-2, -3, ... where that exists; made."""
    jvm, n = spark._jvm, 1
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    while True:
        path = f"{root.rstrip('/')}/{stamp}" + (f"-{n}" if n > 1 else "")
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not fs.exists(where) and fs.mkdirs(where):
            return path
        n += 1


def canonical_json(df: DataFrame) -> DataFrame:
    """(json): each row as compact JSON with sorted keys; nulls are written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_stage(df: DataFrame, run_dir: str, stage: str, mode: str = "errorifexists") -> str:
    """A stage's rows as JSON lines under the run directory; a stage that is there is not written again."""
    path = f"{run_dir}/{stage}"
    canonical_json(df).write.mode(mode).text(path)
    return path


def read_stage(spark: SparkSession, run_dir: str, stage: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{run_dir}/{stage}")


def output_files(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, length) of a run's files outside debug folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir)
    return files.filter(~F.col("path").contains("/debug/")).select("path", "length", "content")
