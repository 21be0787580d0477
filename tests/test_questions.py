import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadfetch.operators import queryset, rewrites

SCHEMA = "query_idx bigint, question string, correct_answer string, all_answers array<string>"


def queries(spark, answers):
    return spark.createDataFrame([(i, f"who is it {i}", a, [a]) for i, a in enumerate(answers)], SCHEMA)


def beliefs(df, pool, **kw):
    return {r["query_idx"]: r["beliefs"] for r in queryset.sample_beliefs(df, pool, **kw).collect()}


def test_only_own_answer_gives_unknown(spark):
    df = queries(spark, ["Rome"])
    pool = spark.createDataFrame([("Rome",), ("ROME",)], "belief string")
    assert beliefs(df, pool) == {0: ["Unknown", "Unknown"]}
    assert beliefs(df, pool, k=3, pad=False) == {0: ["Unknown"]}


def test_short_pool_is_padded_or_short(spark):
    df = queries(spark, ["Rome"])
    pool = spark.createDataFrame([("rome",), ("Oslo",)], "belief string")
    assert beliefs(df, pool) == {0: ["Oslo", "Unknown"]}
    assert beliefs(df, pool, k=3, pad=False) == {0: ["Oslo"]}


@pytest.mark.parametrize("k", [2, 3])
def test_draws_are_distinct_even_and_never_own(spark, k):
    names = ["Ada", "ada", "Bob", "Cid", "Dan", "Eve", "Fay"]
    df = queries(spark, (names * 300)[:2000])
    pool = spark.createDataFrame([(n,) for n in names], "belief string")
    drawn = beliefs(df, pool, k=k)
    counts: dict[str, int] = {}
    for i, got in drawn.items():
        own = (names * 300)[i].lower()
        assert len(set(got)) == k and own not in [g.lower() for g in got]
        for g in got:
            counts[g] = counts.get(g, 0) + 1
    # Each name is open to all queries but its own; the two Adas leave five names to theirs.
    for name, seen in counts.items():
        if name.lower() == "ada":
            expected = 2000 * 5 / 7 * k / 6
        else:
            expected = 2000 * (4 / 7 * k / 6 + 2 / 7 * k / 5)
        assert abs(seen - expected) < 0.08 * expected


def test_slot_types_are_balanced(spark):
    plan = queryset.plan_slots(queries(spark, ["x"] * 300))
    by_block = plan.groupBy(F.floor(F.col("query_idx") / 3), "ptype").count()
    assert {r["count"] for r in by_block.collect()} == {5}


def test_shuffle_does_not_depend_on_partitions(spark):
    df = queries(spark, ["x"] * 200)
    runs = [
        {(r["query_idx"], r["source_idx"]) for r in queryset.shuffled_cap(df.repartition(n), 50).collect()}
        for n in (1, 3, 16)
    ]
    assert runs[0] == runs[1] == runs[2] and sorted(q for q, _ in runs[0]) == list(range(50))


def test_large_cap_takes_the_ordinal_way(spark, monkeypatch):
    df = queries(spark, ["x"] * 200)
    few = {(r["query_idx"], r["source_idx"]) for r in queryset.shuffled_cap(df, 50).collect()}
    monkeypatch.setattr(queryset, "TOP_N_ROWS", 10)
    assert {(r["query_idx"], r["source_idx"]) for r in queryset.shuffled_cap(df, 50).collect()} == few


def task_rows(spark):
    df = queries(spark, ["Rome", "Oslo", "Bonn"])
    return queryset.slot_tasks(queryset.sample_beliefs(df, queryset.belief_pool(df)))


def test_a_generator_that_never_works_falls_back(spark):
    out = rewrites.generate(task_rows(spark), lambda pdf: pd.Series([""] * len(pdf)), rounds=2)
    rows = rewrites.assemble(out).collect()
    assert len(rows) == 15 and out.where("is_fallback and attempt = 2").count() == 15
    for r in rows:
        assert r["perturbed_query"] == r["question"] + ("?" if r["perturbation_type"] != 3 else "")


def test_retries_stop_when_all_is_valid(spark):
    def generate(pdf):
        good = "Since {} ran the whole town long ago, who is it?"
        return pd.Series([good.format(r.wa) if r.attempt == 1 else r.correct_answer for r in pdf.itertuples()])

    out = rewrites.generate(task_rows(spark), generate)
    assert {(r["attempt"], r["is_fallback"]) for r in out.select("attempt", "is_fallback").distinct().collect()} == {(1, False)}


def test_model_batches_do_not_change_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        small = rewrites.generate(task_rows(spark), lambda pdf: pdf["question"] + " or so", rounds=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    large = rewrites.generate(task_rows(spark), lambda pdf: pdf["question"] + " or so", rounds=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_nesting_takes_each_slot_once(spark):
    flat = rewrites.assemble(
        rewrites.generate(task_rows(spark), lambda pdf: pd.Series([""] * len(pdf)), rounds=1)
    )
    nested = rewrites.nest(flat.unionByName(flat)).collect()
    assert [[p["slot_idx"] for p in r["perturbations"]] for r in nested] == [[0, 1, 2, 3, 4]] * 3


def test_balanced_pick_falls_back(spark):
    entry = "struct<perturbation_type:int,perturbed_query:string>"
    df = spark.createDataFrame(
        [(0, "q", ["g"], [(2, "b"), (1, "a"), (1, "z")]), (1, "q", ["g"], [(3, "c")]), (2, "q", ["g"], [])],
        f"query_idx bigint, question string, all_answers array<string>, perturbations array<{entry}>",
    )
    got = {r["query_idx"]: r["query"] for r in rewrites.test_queries(df).collect()}
    assert got == {0: "a", 1: "c", 2: "q"}
