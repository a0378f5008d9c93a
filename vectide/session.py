"""Session helpers: lineage cuts and sizing that survive executor loss."""

from __future__ import annotations

import contextlib
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may get a scratch one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError(
                    "Set spark.checkpoint.dir to a folder every executor can reach."
                )
            folder = tempfile.mkdtemp(prefix="vectide-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back.

    Lineage ends at the files, so a lost executor costs no recomputation. Unlike
    `checkpoint()`, the table carries its real size: joins with it can be
    planned by size, and loops do not compound estimates from round to round.
    Rows of megabytes may want `rows_per_file`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that `cut` wrote, once nothing reads it any more.

    For loops whose rounds each write a table as large as the last: the folder holds two of them.
    """
    spark = table.sparkSession
    for folder in {os.path.dirname(file) for file in table.inputFiles()}:
        if os.path.basename(folder).startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a few jobs; the former ones come back."""
    saved = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in saved.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def task_slots(spark: SparkSession) -> int:
    """Partitions that keep every core busy for a compute-bound stage."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
    )


def process_cache(name: str) -> dict:
    """A dictionary that all tasks of one worker process share.

    Functions of this package are shipped by value, so a module's globals are new in every task; what
    hangs on a module that the process keeps is not.
    """
    keeper = sys.modules.setdefault("_vectide_process", types.ModuleType("_vectide_process"))
    return keeper.__dict__.setdefault(name, {})
