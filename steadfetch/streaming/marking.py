"""Marking and robustness over streams, and progress of a running query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import marking
from ..operators.inference import BatchFn
from ..session import settle
from ..sources.tables import exists


# Verdicts lie in this many buckets by their key, so a batch reads the keys of its own buckets only.
BUCKETS = 256


def _bucket():
    return F.pmod(F.xxhash64(*marking.PAIR_KEYS), F.lit(BUCKETS)).cast("int")


def _unmarked(batch: DataFrame, out: str, number: int) -> DataFrame:
    """One row per pair of the batch that no other batch has marked; the verdicts themselves are the ledger."""
    spark = batch.sparkSession
    fresh = settle(batch.dropDuplicates(marking.PAIR_KEYS).withColumn("bucket", _bucket()))
    if not exists(spark, out):
        return fresh
    ledger = spark.read.parquet(out)
    needed = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    done = ledger.where(F.col("bucket").isin(needed) & (F.col("batch") != number)).select("bucket", *marking.PAIR_KEYS)
    return fresh.join(done, ["bucket", *marking.PAIR_KEYS], "left_anti")


def start_marking(
    pairs: DataFrame, out: str, checkpoint: str, teacher: BatchFn | None = None, judge: BatchFn | None = None
) -> StreamingQuery:
    """Appends the verdicts of each batch to `out`; each pair is marked once, by (query_idx, pert_idx, doc_rank).

    A pair that comes again, in the same batch, a later one, or after a restart from an empty checkpoint, is
    left out before the teacher is asked. Every batch has its own folder, in buckets by key, which a
    repeated batch replaces, so a batch that was killed leaves its verdicts once.
    """
    def mark_batch(batch: DataFrame, number: int) -> None:
        new = _unmarked(batch, out, number)
        verdicts = marking.verdict_rows(marking.mark(new.drop("bucket"), teacher, judge)).withColumn("bucket", _bucket())
        verdicts.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return (
        pairs.writeStream.foreachBatch(mark_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_robustness(verdicts: DataFrame) -> DataFrame:
    """Counts and mean mark per (query, document) so far, for update mode."""
    return marking.robustness(verdicts)


def observed(verdicts: DataFrame, name: str = "progress") -> DataFrame:
    """Adds per-batch counters, to be read from the query's progress."""
    return verdicts.observe(
        name,
        F.count(F.lit(1)).alias("n_done"),
        F.count_if(F.col("correct")).alias("n_correct"),
        F.count_if(F.col("judge_raw") == "yes (em)").alias("n_judge_skipped"),
    )


def start_counting(verdicts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counters to a folder of its own, so that runs of any length add up.

    A batch that runs again after a failure overwrites its own counters.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.agg(
            F.count(F.lit(1)).alias("n_done"), F.count_if(F.col("correct")).alias("n_correct"),
            F.count_if(F.col("judge_raw") == "yes (em)").alias("n_judge_skipped"),
        ).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        verdicts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The sums of all batches so far; one row."""
    names = ("n_done", "n_correct", "n_judge_skipped")
    return spark.read.parquet(out).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def progress_rows(query: StreamingQuery, name: str = "progress") -> list[tuple[int, int, int, int]]:
    """(batch, done, correct, judge calls saved) of the last batches, which the
    query still remembers: for watching a run. `start_counting` keeps all of them."""
    rows = []
    for event in query.recentProgress:
        seen = event.observedMetrics.get(name)
        if seen is not None:
            rows.append((event.batchId, seen["n_done"], seen["n_correct"], seen["n_judge_skipped"]))
    return rows


def start_running_robustness(verdicts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts of each batch, one row per (query, document) it marks, to a folder of its own.

    The stream holds no state: what a pair has so far is the sum over the folders (`latest`), or over the folded
    table and the folders since (`newest`), so a batch costs what it brings, however many pairs came before it.
    """
    def keep(batch: DataFrame, number: int) -> None:
        running_robustness(batch).drop("robustness").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        verdicts.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _summed(counts: DataFrame, *more) -> DataFrame:
    """Adds up counts per (query, document); sums combine per task before they move."""
    return counts.groupBy("query_idx", "doc_key").agg(
        F.sum("n_marks").alias("n_marks"), F.sum("n_correct").alias("n_correct"), *more
    )


def latest(counts: DataFrame) -> DataFrame:
    """Counts and mean mark per (query, document) over all batches so far."""
    return _summed(counts).withColumn("robustness", F.col("n_correct") / F.col("n_marks"))


def _pending(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(batch, folder) of the updates that have been written in full and not folded."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not exists(spark, out):
        return []
    fs = at(out).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [(e.getPath().getName(), e.getPath().toString()) for e in fs.listStatus(at(out)) if e.isDirectory()]
    named = [(int(name.removeprefix("batch=")), path) for name, path in folders if name.startswith("batch=")]
    return sorted((number, path) for number, path in named if exists(spark, f"{path}/_SUCCESS"))


def fold(spark: SparkSession, out: str, state: str) -> int:
    """Adds the counts below `out` to the bucketed table `state`; returns how many batches were folded.

    Only buckets that the counts touch are read and rewritten. A row of the state carries the last batch that is in
    it, and batches up to that one are not added again, so folding the same folders twice changes nothing; they
    are deleted once the state holds them. One caller at a time, and not while the stream writes.
    """
    batches = _pending(spark, out)
    if not batches:
        return 0
    parts = [spark.read.parquet(path).withColumn("batch", F.lit(number).cast("bigint")) for number, path in batches]
    bucket = F.pmod(F.xxhash64("query_idx", "doc_key"), F.lit(BUCKETS)).cast("int")
    fresh = settle(reduce(DataFrame.unionByName, parts).withColumn("bucket", bucket))
    merged = fresh
    if exists(spark, state):
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        held = settle(spark.read.parquet(state).where(F.col("bucket").isin(touched)).select(fresh.columns))
        known = held.select("query_idx", "doc_key", F.col("batch").alias("_known"))
        added = fresh.join(known, ["query_idx", "doc_key"], "left").where("_known IS NULL OR batch > _known").drop("_known")
        merged = held.unionByName(added)
    dealt = _summed(merged, F.max("batch").alias("batch"), F.any_value("bucket").alias("bucket")).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(state)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for _, path in batches:
        at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(path), True)
    return len(batches)


def newest(spark: SparkSession, out: str, state: str) -> DataFrame:
    """Counts and mean mark per (query, document): the folded table, and whatever batches came since."""
    rows = [spark.read.parquet(path) for _, path in _pending(spark, out)]
    if exists(spark, state):
        rows.append(spark.read.parquet(state).drop("bucket", "batch"))
    return latest(reduce(DataFrame.unionByName, rows))
