"""Publishing tables: verified writes, resume by key, reuse, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def content(df: DataFrame) -> list[Column]:
    """Count of rows and a sum of their hashes: equal for equal rows in any order."""
    known = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*known).cast("decimal(38,0)")).alias("hash")]


def publish(
    df: DataFrame, path: str, mode: str = "errorifexists", check: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Publishes a parquet table: written beside `path`, checked there, and renamed into place.

    The staged table must hold the rows that went in, by count and by a hash of their content, and `check`
    (which raises) must accept it; if not, it is deleted and what readers see at `path` stays as it was.
    Modes: `errorifexists`; `overwrite`, which puts the old table aside and deletes it once the new one is in
    place; `append`, which checks the new rows only and moves their files in. Renames are single steps on
    file systems that have them; a store that copies instead shows files one by one.
    """
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"no publishing mode {mode}")
    spark = df.sparkSession
    if mode == "errorifexists" and exists(spark, path):
        raise FileExistsError(f"{path} already exists")
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    staged, aside = f"{base}.staged-{mark}", f"{base}.old-{mark}"
    fs, at = _file_system(spark, base)
    try:
        seen = Observation()
        df.observe(seen, *content(df)).write.parquet(staged)
        table = spark.read.parquet(staged)
        held = table.agg(*content(table)).first()
        if (held["n"], held["hash"]) != (seen.get["n"], seen.get["hash"]):
            raise RuntimeError(f"{staged} holds {held['n']} rows, {seen.get['n']} were written")
        if check is not None:
            check(table)
    except Exception:
        fs.delete(at(staged), True)
        raise
    if mode == "append" and exists(spark, base):
        _move_files(fs, at, staged, base, mark)
    else:
        replaced = exists(spark, base)
        if replaced:
            _rename(fs, at, base, aside)
        try:
            _rename(fs, at, staged, base)
        except Exception:
            if replaced:
                _rename(fs, at, aside, base)
            raise
        if replaced:
            fs.delete(at(aside), True)
    return spark.read.parquet(path)


def _file_system(spark: SparkSession, path: str):
    def at(name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(name)

    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _rename(fs, at, source: str, target: str) -> None:
    if not fs.rename(at(source), at(target)):
        raise RuntimeError(f"cannot rename {source} to {target}")


def _move_files(fs, at, staged: str, path: str, mark: str) -> None:
    """Moves the data files of `staged` into `path`, under names that no other publish uses."""
    for entry in fs.listStatus(at(staged)):
        name = entry.getPath().getName()
        if entry.isFile() and not name.startswith(("_", ".")):
            _rename(fs, at, f"{staged}/{name}", f"{path}/{mark}-{name}")
    fs.delete(at(staged), True)


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not among the finished ones, in whatever order both come."""
    return todo.join(done.select(*keys), keys, "left_anti")


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path` if it was completed before, else the one `build` gives."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> str:
    """Metrics, curves and answer tables as JSON lines, replacing an older report."""
    df.write.mode("overwrite").json(path)
    return path
