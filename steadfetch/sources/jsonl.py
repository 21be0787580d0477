"""JSON lines: scans with a schema, gzip by suffix, shard globs, tolerance, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread

_CORRUPT = "_corrupt_record"


def scan(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of a file, folder, or glob. A path without files raises.

    Gzip is told by the suffix. Such a file is read by one task, so the rows of a few
    of them are dealt out to all cores; many files keep the cores busy as they are.
    """
    rows = spark.read.schema(schema).json(path)
    paths = [path] if isinstance(path, str) else path
    return spread(rows) if any(p.endswith(".gz") for p in paths) else rows


def scan_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, lines that are no records). A cut-off last line is one of the latter."""
    parsed = F.from_json(
        "value", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    rows = spark.read.text(path).select("value", parsed.alias("_r"))
    good = rows.where(F.col(f"_r.{_CORRUPT}").isNull()).select("_r.*").drop(_CORRUPT)
    bad = rows.where(F.col(f"_r.{_CORRUPT}").isNotNull()).select(F.col("value").alias("line"))
    return good, bad


def write(df: DataFrame, path: str, compress: bool = False, mode: str = "errorifexists") -> str:
    """One UTF-8 JSON object per line, nulls left out; gzip files on request."""
    writer = df.write.mode(mode)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.json(path)
    return path
