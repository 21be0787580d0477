"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Paths that `settle` has written inside a `settle_last`.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("steadfetch")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        # As many shuffle partitions as cores already; merging small ones would idle cores.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`.

    A local session without the setting gets a temporary folder. A cluster must name a
    folder that all its machines see: one on a single machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="steadfetch-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes `df` once as Parquet below the checkpoint folder and reads it back from there.

    Used where two passes must see the same rows (model output, range partition numbers)
    or where recomputing a stage would be dear. The table read back has a size that
    Spark can plan with, prunes columns, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    names = [f"c{i}" for i in range(len(df.columns))]
    shape = df.schema
    plain = df.toDF(*names)
    plain = plain.withColumns({
        n: F.col(n).cast("string") for n, f in zip(names, shape.fields) if f.dataType.typeName() == "void"
    })
    # Read once or twice and then kept until the application ends: small counts for more than fast.
    plain.write.option("compression", "zstd").parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def settle_last(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Settles what `build` returns and deletes the tables that were settled on the way to it."""
    held: list[str] = []
    outer = _passing.set(held)
    try:
        last = build()
        _passing.reset(outer)
        outer = None
        return settle(last)
    finally:
        if outer is not None:
            _passing.reset(outer)
        for path in held:
            _delete(spark, path.rsplit("/", 1)[0])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application settled; call it when no result is needed any more."""
    _delete(spark, _scratch_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
