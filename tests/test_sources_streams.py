import glob
import json

import pytest
from pyspark.sql import functions as F

from steadfetch.operators import rewrites
from steadfetch.plans import question_queries, stream_queries
from steadfetch.session import scratch_path, settle
from steadfetch.sources import jsonl, publish, schemas, tables
from steadfetch.streaming import completion, marking


def test_lines_keep_unicode_and_leave_out_nulls(spark):
    path = jsonl.write(spark.createDataFrame([(1, "é漢", None)], "a int, b string, c string").coalesce(1),
                       scratch_path(spark, "x"))
    (name,) = glob.glob(f"{path}/*.json")
    with open(name, encoding="utf-8") as f:
        assert f.read() == '{"a":1,"b":"é漢"}\n'


def test_missing_path_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.scan(spark, "/nowhere/shard_*.jsonl", schemas.PASSAGE).count()


def test_missing_fields_become_null(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"query_idx": 3, "candidates": [{"idx": 4, "text": "t"}]}\n')
    row = jsonl.scan(spark, str(path), schemas.RETRIEVAL).first()
    assert row["query_idx"] == 3 and row["question"] is None
    assert row["candidates"][0]["idx"] == 4 and row["candidates"][0]["passage_idx"] is None


def test_cut_off_tail(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"query_idx": 1}\n{"query_idx": 2}\n{"query_i')
    good, bad = jsonl.scan_tolerant(spark, str(path), "query_idx bigint")
    assert sorted(r[0] for r in good.collect()) == [1, 2]
    assert [r["line"] for r in bad.collect()] == ['{"query_i']


def test_published_table_is_checked(spark):
    path = scratch_path(spark, "t")
    assert publish.publish(spark.range(100), path).count() == 100
    with pytest.raises(Exception, match="already exists"):
        publish.publish(spark.range(1), path)


def test_a_failed_publish_leaves_the_old_table(spark):
    path = scratch_path(spark, "t")
    publish.publish(spark.range(10), path)

    def refuse(table):
        assert table.count() == 3
        raise ValueError("refused")

    for mode in ("overwrite", "append"):
        with pytest.raises(ValueError, match="refused"):
            publish.publish(spark.range(3), path, mode, refuse)
        assert spark.read.parquet(path).count() == 10
    assert publish.publish(spark.range(20, 25), path, "append").count() == 15
    assert publish.publish(spark.range(7), path, "overwrite").count() == 7
    assert publish.publish(spark.range(0), scratch_path(spark, "none"), "append").count() == 0
    parent, name = path.rsplit("/", 1)
    left = spark._jvm.org.apache.hadoop.fs.Path(parent)
    entries = left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left)
    assert [e.getPath().getName() for e in entries] == [name]


def test_ids_of_truthfulness_questions_stay(spark):
    rows = spark.createDataFrame([(1, "q", "b", ["x"]), (2, "q", "y", None)], "n int, question string, best_answer string, correct_answers array<string>")
    assert sorted(map(tuple, tables.truthful_queries(rows, "n").collect())) == [(1, "q", ["x"]), (2, "q", ["y"])]


def test_remaining_work_goes_by_key(spark):
    done = spark.createDataFrame([(5,), (7,), (7,)], "id bigint")
    assert sorted(r[0] for r in publish.remaining(spark.range(9), done, ["id"]).collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_shards_hold_at_most_the_limit(spark):
    path = tables.write_shards(spark.range(1000).coalesce(1), scratch_path(spark, "s"), rows_per_file=300)
    assert sorted(r["n_rows"] for r in tables.census(spark.read.parquet(path)).collect()) == [100, 300, 300, 300]
    assert tables.census_totals(spark.read.parquet(path)).first()["n_files"] == 4


def test_slices_in_folders(spark):
    df = spark.range(6).withColumn("slice", F.col("id") % 3)
    path = tables.write_slices(df, scratch_path(spark, "slices"))
    assert len(glob.glob(f"{path}/slice=*/*.json.gz")) >= 3
    assert spark.read.json(path).count() == 6


def test_large_scan_stays_where_it_is(spark):
    df = spark.range(0, 100, 1, 64)
    assert tables.spread(df) is df


def flat_rows(spark, small):
    return settle(question_queries.assembled(spark, small))


def run(groups, out, checkpoint):
    groups.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def test_stream_equals_batch_and_restarts(spark, small):
    flat = flat_rows(spark, small)
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    expected = {
        (r["query_idx"], p["slot_idx"], p["perturbed_query"])
        for r in rewrites.nest(flat).collect() for p in r["perturbations"]
    }
    first = flat.where("slot_idx < 3").unionByName(flat.where("slot_idx = 1"))
    first.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(completion.completed(stream), out, checkpoint)
    assert spark.read.schema(completion.OUTPUT).parquet(out).count() == 0
    flat.where("slot_idx >= 3").repartition(3).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        run(completion.completed(stream), out, checkpoint)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(expected)
    assert {(r["query_idx"], r["slot_idx"], r["perturbed_query"]) for r in rows} == expected


def test_a_killed_batch_and_repeated_pairs_give_one_verdict(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(q, d, 0, 1, f"what is {d}", f"it is {d}.", [f"{d}"], 0.5, 7) for q in range(6) for d in range(4)],
        "query_idx bigint, doc_rank bigint, pert_idx int, pert_type int, perturbed_query string, text string, golds array<string>, score double, passage_idx bigint",
    )
    stream = stream_queries.as_stream(spark, rows.unionByName(rows.where("query_idx < 3")), "killed", per_trigger=2)
    out, checkpoint = scratch_path(spark, "v"), scratch_path(spark, "vc")
    real, calls = marking.marking.verdict_rows, []

    def dies_once(marked):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(marked)

    monkeypatch.setattr(marking.marking, "verdict_rows", dies_once)
    with pytest.raises(Exception, match="killed"):
        marking.start_marking(stream, out, checkpoint).awaitTermination()
    for fresh in (checkpoint, scratch_path(spark, "vc2")):
        marking.start_marking(stream, out, fresh).awaitTermination()
    got = [(r["query_idx"], r["doc_rank"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [(q, d) for q in range(6) for d in range(4)]


def test_progress_of_a_run(spark):
    rows = spark.createDataFrame([(i % 2 == 0, "yes (em)" if i % 4 == 0 else "no") for i in range(20)],
                                 "correct boolean, judge_raw string")
    watched = marking.observed(stream_queries.as_stream(spark, rows, "w"))
    query = watched.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "c")).trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    seen = marking.progress_rows(query)
    assert len(seen) == 4
    assert [sum(r[i] for r in seen) for i in (1, 2, 3)] == [20, 10, 5]


def test_report_replaces_the_older_one(spark):
    path = scratch_path(spark, "report")
    for n in (5, 2):
        publish.write_report(spark.range(n), path)
    lines = [json.loads(x) for f in glob.glob(f"{path}/*.json") for x in open(f)]
    assert sorted(x["id"] for x in lines) == [0, 1]


def test_queries_of_a_bucket_share_a_state(spark):
    """However many queries are open, a batch calls Python once per bucket."""
    columns = {c: F.lit(None).cast(t) for c, t in (f.split(" ") for f in (
        "question string,correct_answer string,all_answers array<string>,perturbation_type int,perturbation_text string,"
        "perturbed_query string,wrong_belief string,t2_variant string,topic string,is_empty boolean").split(","))}
    rows = spark.range(3000).select(F.col("id").alias("query_idx"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot_idx")).withColumns(columns)
    rows = rows.unionByName(rows.where("query_idx < 5").withColumn("query_idx", F.lit(None).cast("bigint")))
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("many", "many_out", "many_checkpoint"))
    for part, total in ((rows.where("slot_idx < 3"), 9), (rows.where("slot_idx >= 2"), 0)):
        part.coalesce(1).write.mode("append").parquet(folder)
        groups = completion.completed(spark.readStream.schema(rows.schema).parquet(folder), buckets=8)
        done = groups.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        done.awaitTermination()
        assert sum(op.numRowsTotal for op in done.recentProgress[-1].stateOperators) == total
    got = spark.read.parquet(out)
    assert got.where("is_complete").count() == 15_005 and got.distinct().count() == 15_005


def test_a_large_stream_has_more_files_and_as_many_batches(spark, monkeypatch):
    """Tasks that write a stream stay small, and the files of a trigger grow in number instead."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    rows = spark.range(4000).select((F.col("id") % 2 == 0).alias("correct"), F.lit("no").alias("judge_raw"))
    cores = spark.sparkContext.defaultParallelism
    out = scratch_path(spark, "large")
    run = marking.start_counting(stream_queries.as_stream(spark, rows, "l", per_trigger=2, most=4000), out, scratch_path(spark, "lc"))
    run.awaitTermination()
    assert marking.counted(spark, out).first()["n_done"] == 4000
    assert len(glob.glob(f"{out}/batch=*")) == -(-cores // 2)
    source = json.loads(run.lastProgress.json)["sources"][0]["description"]
    files = glob.glob(source.split("[file:")[1].rstrip("]") + "/*.parquet")
    assert len(files) == cores * -(-4000 // (cores * 100))
