"""Shared folder tables for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else one in the warehouse.

    Both are shared by the driver and all executors of a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written to a fresh subfolder of the shared folder and read back.

    Writing cuts the lineage: a lost executor costs the running stage only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def pick(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the wanted columns, ``names`` maps them to their types.

    A missing column is filled with nulls; extra columns never clash.
    """
    have = set(df.columns)
    return df.select(*(
        (F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)).alias(c)
        for c, t in names.items()
    ))
