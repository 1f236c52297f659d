"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 1 << 20  # of an Arrow batch, unless the session names a bound of its own

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Makes a session ready for operators that run Python: the package on the executors, and Arrow batches bounded
    by bytes, so that long texts need little memory. A bound that the session already has stays."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python need not have it installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="kelpline-package-"), "kelpline.zip")
    with zipfile.ZipFile(place, "w") as file:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(place)
    _shipped.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* of a data folder; only Spark's readers touch the path."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of *df*, that of its files for stored tables; 0 where it knows nothing."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if estimate > 1 << 58 else estimate  # what is unknown counts as the largest of all numbers


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``). Where none is set: one beside the warehouse's tables
    if those lie in a store that a cluster shares, and a folder of this machine only if the whole application runs on it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        master = context.master
        if master == "local" or master.startswith("local["):
            named = tempfile.mkdtemp(prefix="kelpline-checkpoint-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", warehouse):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares: the warehouse lies on one machine")
            named = f"{warehouse.rstrip('/')}/kelpline-checkpoint"
        context.setCheckpointDir(named)
    return named


class Scratch:
    """Tables of a job in the shared folder, removed at the end of a ``with`` block, also of one that fails. Storing a table cuts its lineage: a lost executor costs no more than
    a read, and the planner sees its true size (a checkpoint would hand on the product of its inputs' estimates)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/kelpline-{uuid.uuid4().hex}"
        self.count = 0
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, by: Sequence[str] = (), written: dict[str, str] | None = None) -> DataFrame:
        """*df*, stored, in folders by the columns *by* and with the writer's options *written*, and read again."""
        self.count += 1
        place = f"{self.folder}/{self.count}"
        df.write.options(**written or {}).parquet(place, partitionBy=list(by) or None)
        return self.spark.read.schema(df.schema).parquet(place)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def remove(self, number: int) -> None:
        """Removes the table that was cut as the *number*-th; nothing may still read it."""
        self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}"), True)

    def drop(self) -> None:
        """Removes the tables; nothing may still read them."""
        self.files.delete(self.path, True)

    def drop_at_exit(self) -> None:
        """Removes the tables when the application ends, for results that read them lazily."""
        self.files.mkdirs(self.path)
        self.files.deleteOnExit(self.path)


def cut(df: DataFrame) -> DataFrame:
    """*df*, stored in the shared folder until the application ends, and read again."""
    scratch = Scratch(df.sparkSession)
    scratch.drop_at_exit()
    return scratch.cut(df)
