"""Intermediate tables that several later steps read.

A staged table is Parquet in the shared folder named by ``spark.checkpoint.dir``: it outlives the
executors that wrote it, cuts lineage, and gives later joins a real size to plan with.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, else the session's warehouse, if that is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        on_this_machine = folder.startswith("file:") or "://" not in folder
        if on_this_machine and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{folder.rstrip('/')}/echofold-staged"


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application staged; frames made from it cannot be read afterwards."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/{context.applicationId}")
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh location for one staged table."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back, from folders by the given columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
