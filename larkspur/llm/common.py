"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and the master is local (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="larkspur-")
    spark.sparkContext.setCheckpointDir(path)
    return path


class Tables:
    """Intermediate results as Parquet in the shared folder: lineage ends there, and a lost executor loses nothing.

    What no later plan reads can be dropped at once (`drop`, `clear`); the rest goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
        self.made = 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        schema = df.schema
        df.write.parquet(path)
        if self.made == 1:
            folder, system = self._at(self.root)
            system.deleteOnExit(folder)
        out = self.spark.read.schema(schema).parquet(path)
        out.larkspur_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            folder, system = self._at(df.larkspur_path)
            system.delete(folder, True)

    def clear(self) -> None:
        """Delete all tables."""
        folder, system = self._at(self.root)
        system.delete(folder, True)

    def _at(self, path: str) -> tuple:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def columns(df: DataFrame, besides: set[str] = frozenset()) -> list[str]:
    """The columns that an operator passes on: not those that it makes itself, nor those with the reserved prefix __lk_."""
    return [c for c in df.columns if c.lower() not in besides and not c.startswith("__lk_")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
