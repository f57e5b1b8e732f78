"""Written intermediate tables: they cut the lineage of a loop and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import cached_property
from itertools import count
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Frees a query's shuffles when it ends; otherwise they stay until the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session may fall back on a folder of
    its own, since only there every task sees the same disk; it becomes the session's checkpoint folder."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgermatch-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def at_size(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the trans. Its files may look small enough to be sent to all tasks (ids
    compress well) when its rows are not, so it is sorted and merged instead."""
    return df.hint("merge")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is computed within leaves no shuffle files behind."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


class RunFolder:
    """Tables of one run, below a name of its own. The shared folder is asked for when the first
    table is written."""

    #: Options of the writer, and whether the shuffles behind a table go as soon as it is written.
    options: ClassVar[dict[str, str]] = {}
    frees = False

    def __init__(self, spark: SparkSession, above: RunFolder | None = None):
        self.spark = spark
        self._above = above
        self._number = count(1)

    @cached_property
    def path(self) -> str:
        return f"{self._above.path if self._above else shared_folder(self.spark)}/run-{uuid.uuid4().hex}"

    def below(self) -> RunFolder:
        """A folder within this one, to be removed before it."""
        return type(self)(self.spark, self)

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df``, in a folder for each value of ``by`` if given, and read it back."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("errorifexists").options(**self.options)
        with shuffles_freed(self.spark) if self.frees else nullcontext():
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the run's tables, once nothing reads them any more."""
        if "path" in self.__dict__:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def scratch(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """As :meth:`table`, under the next free name."""
        return self.table(df, f"scratch-{next(self._number)}", by)


class LedgerFolder(RunFolder):
    """Tables as large as the trans or breakups. Ids, dates and amounts take about half the bytes as packed differences."""

    options: ClassVar[dict[str, str]] = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",
    }
    frees = True
