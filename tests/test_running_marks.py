from pyspark.sql import functions as F

from steadfetch.session import scratch_path
from steadfetch.sources.tables import exists
from steadfetch.streaming import marking

VERDICT = "query_idx bigint, doc_key string, correct boolean"


def sent(spark, path, checkpoint, out, rows):
    spark.createDataFrame(rows, VERDICT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(VERDICT).parquet(path)
    run = marking.start_running_robustness(stream, out, checkpoint)
    run.awaitTermination()
    return run


def shown(df):
    return sorted((r["query_idx"], r["doc_key"], r["n_marks"], r["n_correct"], r["robustness"]) for r in df.collect())


def test_running_means_need_no_state_of_the_stream(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("marks", "counts", "checkpoint"))
    sent(spark, path, checkpoint, out, [(1, "a", True), (1, "a", False), (2, "b", True)])
    run = sent(spark, path, checkpoint, out, [(1, "a", True), (3, "c", False)])
    assert not any(event.stateOperators for event in run.recentProgress)
    # A batch writes what it brings, not what was there before.
    assert spark.read.parquet(out).where("batch = 1").count() == 2
    assert spark.read.parquet(out).where("batch = 1").agg(F.sum("n_marks")).first()[0] == 2
    assert shown(marking.latest(spark.read.parquet(out))) == [(1, "a", 3, 2, 2 / 3), (2, "b", 1, 1, 1.0), (3, "c", 1, 0, 0.0)]


def test_a_folder_that_comes_again_is_folded_once(spark):
    path, out, checkpoint, state = (scratch_path(spark, n) for n in ("marks", "counts", "checkpoint", "state"))
    sent(spark, path, checkpoint, out, [(1, "a", True), (2, "b", True)])
    again = spark.read.parquet(f"{out}/batch=0").collect()
    assert marking.fold(spark, out, state) == 1 and not exists(spark, f"{out}/batch=0")
    sent(spark, path, checkpoint, out, [(1, "a", False), (4, "d", True)])
    # Folding had ended before the first folder was deleted, say.
    spark.createDataFrame(again).write.parquet(f"{out}/batch=0")
    assert marking.fold(spark, out, state) == 2
    expected = [(1, "a", 2, 1, 0.5), (2, "b", 1, 1, 1.0), (4, "d", 1, 1, 1.0)]
    assert shown(marking.newest(spark, out, state)) == expected
    sent(spark, path, checkpoint, out, [(4, "d", False)])
    assert shown(marking.newest(spark, out, state)) == [*expected[:2], (4, "d", 2, 1, 0.5)]
