"""Streams over files written from the given tables; each run ends when all files are read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..session import scratch_path, settle
from ..sources.tables import given
from ..streaming import completion
from ..streaming import marking as stream_marking
from .catalog import query, sql_hash, with_ctes
from .evaluation_queries import MARKS, VERDICT_SQL, marking_pairs
from .pool_queries import SCORED, pairs
from .question_queries import ASSEMBLED, assembled

# One task writes about this many rows of a stream at most.
FILE_ROWS = 1_000_000


def as_stream(
    spark: SparkSession, rows: DataFrame, name: str, per_trigger: int = 2, most: int = 0, by: list[str] | None = None
) -> DataFrame:
    """The rows as a stream of files, a few per trigger, in no useful order.

    `by` names columns that tell rows apart: files are then dealt by their hash, which needs no sort of the rows.
    `most` is a bound on the number of rows: above FILE_ROWS for a core there are more files, and as many more
    per trigger, so that tasks stay small and batches as many as they were.
    """
    path, cores = scratch_path(spark, name), spark.sparkContext.defaultParallelism
    times = max(1, math.ceil(most / (cores * FILE_ROWS)))
    rows.repartition(cores * times, *(by or [])).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger * times).parquet(path)


def mark_rows(spark: SparkSession, folder: str) -> DataFrame:
    return marking_pairs(spark, folder).withColumns({
        "doc_rank": F.lit(0).cast("bigint"), "pert_idx": F.lit(0), "pert_type": F.lit(1), "score": F.lit(0.0),
        "passage_idx": F.col("query_idx"),
    })


# Some queries lose a slot and stay incomplete; every first slot comes twice.
LOST = f"({sql_hash('query_idx')}) % 50 = 0"


@query("l1_group_completion", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, perturbed_query, wrong_belief, true AS is_complete "
    f"FROM flat WHERE NOT ({LOST})", *ASSEMBLED))
def group_completion(spark: SparkSession, folder: str) -> DataFrame:
    flat = settle(assembled(spark, folder))
    lost = (F.col("slot_idx") == 3) & (F.pmod(stable_hash(F.col("query_idx")), F.lit(50)) == 0)
    sent = flat.where(~lost).unionByName(flat.where("slot_idx = 0"))
    groups = completion.completed(as_stream(spark, sent, "slots"))
    out = scratch_path(spark, "completed")
    run = groups.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "completed_checkpoint")
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    # A first slot that comes after its group left opens a new group that never fills.
    return spark.read.parquet(out).select(
        "query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"), "perturbed_query", "wrong_belief", "is_complete"
    )


@query("l1_timed_out_groups", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, perturbed_query, wrong_belief, NOT (" + LOST + ") AS is_complete "
    f"FROM flat WHERE NOT ({LOST} AND slot_idx = 3)", *ASSEMBLED))
def timed_out_groups(spark: SparkSession, folder: str) -> DataFrame:
    """As above in event time: groups that lost a slot leave incomplete, duplicates emit nothing, no state is left."""
    flat = settle(assembled(spark, folder))
    day = 86_400_000  # the watermark begins at 1970, whose first moment would be late
    at = F.timestamp_millis(F.lit(day) + F.pmod(F.col("query_idx"), F.lit(1000)) * 1000 + F.col("slot_idx"))
    timed = flat.withColumn("at", at)
    lost = (F.col("slot_idx") == 3) & (F.pmod(stable_hash(F.col("query_idx")), F.lit(50)) == 0)
    path, out, checkpoint = (scratch_path(spark, name) for name in ("timed", "timed_out", "timed_checkpoint"))
    tick = timed.limit(1).withColumns({"query_idx": F.lit(-1).cast("bigint"), "slot_idx": F.lit(None).cast(timed.schema["slot_idx"].dataType), "at": F.timestamp_millis(F.lit(2 * day))})
    sent = timed.where(~lost).unionByName(timed.where("slot_idx = 0"))
    late = timed.where("slot_idx = 1")
    # First all slots, then late duplicates, then rows that only move the watermark far on: timeouts see it a batch later.
    for rows in (sent.repartition(spark.sparkContext.defaultParallelism), late, tick, tick):
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 4).parquet(path)
        groups = completion.completed(stream.withWatermark("at", "1 hour"), timeout_ms=60_000, event_time="at")
        run = groups.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        done = run.trigger(availableNow=True).start()
        done.awaitTermination()
    left = sum(op.numRowsTotal for event in done.recentProgress[-1:] for op in event.stateOperators)
    if left:
        raise RuntimeError(f"{left} groups are still held")
    return spark.read.parquet(out).select(
        "query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"), "perturbed_query", "wrong_belief", "is_complete"
    )


@query("l2_repeated_pairs", with_ctes(VERDICT_SQL, *MARKS))
def repeated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair comes twice, in different files, and the stream runs again from an empty checkpoint: one verdict each."""
    rows = mark_rows(spark, folder)
    out = scratch_path(spark, "ledger")
    stream = as_stream(spark, rows.unionByName(rows), "repeated", per_trigger=3)
    for run in range(2):
        stream_marking.start_marking(stream, out, scratch_path(spark, f"ledger_checkpoint_{run}")).awaitTermination()
    return spark.read.parquet(out).select("query_idx", "pred", "judge_raw", "correct")


@query("l2_incremental_marks", with_ctes(VERDICT_SQL, *MARKS))
def incremental_marks(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    out, checkpoint = scratch_path(spark, "verdicts"), scratch_path(spark, "verdicts_checkpoint")
    stream = as_stream(spark, rows, "pairs")
    for _ in range(2):  # the second run finds nothing new
        stream_marking.start_marking(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("query_idx", "pred", "judge_raw", "correct")


def verdict_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder).select(
        "query_idx", "doc_key", "pert_idx", "correct", F.when(F.col("correct"), "yes (em)").otherwise("no").alias("judge_raw")
    )
    # A candidate has five rewrites.
    most = 5 * given(spark, folder, "lineitem").count()
    return as_stream(spark, rows, "marks", per_trigger=4, most=most, by=["query_idx", "doc_key", "pert_idx"])


@query("l3_running_robustness", with_ctes(
    "SELECT query_idx, doc_key, n_marks, n_correct, round(robustness, 9) AS robustness FROM scores", *SCORED))
def running_robustness(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "running"), scratch_path(spark, "running_checkpoint")
    stream_marking.start_running_robustness(verdict_stream(spark, folder), out, checkpoint).awaitTermination()
    return stream_marking.latest(spark.read.parquet(out)).withColumn("robustness", F.round("robustness", 9))


@query("l3_folded_robustness", with_ctes(
    "SELECT query_idx, doc_key, n_marks, n_correct, round(robustness, 9) AS robustness, 0::BIGINT AS n_updates_left FROM scores", *SCORED))
def folded_robustness(spark: SparkSession, folder: str) -> DataFrame:
    """The means after many small batches in two runs, each folded into the state."""
    rows = settle(pairs(spark, folder).select("query_idx", "doc_key", "correct"))
    path, out, checkpoint, state = (scratch_path(spark, n) for n in ("folds", "folded", "fold_checkpoint", "state"))
    cores = spark.sparkContext.defaultParallelism
    times = max(math.ceil(cores / 4), math.ceil(rows.count() / 8 / FILE_ROWS))
    for half in range(2):
        own = rows.where(F.pmod(stable_hash(F.col("query_idx"), F.col("doc_key"), F.col("correct")), F.lit(2)) == half)
        # Four batches, each of several files, so that all cores write and none has much.
        own.repartition(4 * times).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", times).parquet(path)
        stream_marking.start_running_robustness(stream, out, checkpoint).awaitTermination()
        stream_marking.fold(spark, out, state)
    left = stream_marking.fold(spark, out, state)
    return stream_marking.newest(spark, out, state).select(
        "query_idx", "doc_key", "n_marks", "n_correct", F.round("robustness", 9).alias("robustness"), F.lit(left).cast("bigint").alias("n_updates_left")
    )


@query("l4_progress", with_ctes(
    "SELECT count(*) AS n_done, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) AS n_judge_skipped FROM pairs",
    *SCORED))
def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of all batches of a run, summed up."""
    out = scratch_path(spark, "counted")
    run = stream_marking.start_counting(verdict_stream(spark, folder), out, scratch_path(spark, "counted_checkpoint"))
    run.awaitTermination()
    return stream_marking.counted(spark, out)
