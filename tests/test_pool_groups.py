import pytest
from pyspark.sql import functions as F

from steadfetch.operators import groups, marking, pool, skew, splits
from steadfetch.plans import catalog, pool_queries, ranking_queries  # noqa: F401

CAND = "query_idx bigint, rank bigint, passage_idx bigint, idx bigint, text string, score double"


def clean(spark):
    return spark.createDataFrame([
        (1, 0, 10, None, "a", 0.9), (1, 1, None, 11, "b", None), (1, 2, None, None, "c", 0.5),
        (1, 3, None, None, "c", 0.4), (2, 0, 0, None, "z", 0.3),
    ], CAND)


def perturbed(spark):
    return spark.createDataFrame([
        (1, 0, 11, None, "b", 0.8, 0), (1, 1, 12, None, "d", 0.7, 0), (1, 0, 12, None, "d", 0.6, 1),
        (1, 1, None, None, "a", 0.6, 1), (9, 0, 13, None, "e", 0.5, 0),
    ], CAND + ", pert_idx int")


def asked(spark):
    return spark.createDataFrame(
        [(1, "q1", None, None), (2, "q2", "x", ["x"]), (3, "q3", "y", None)],
        "query_idx bigint, question string, correct_answer string, all_answers array<string>",
    )


@pytest.mark.parametrize("cap", [0, 2, 5])
@pytest.mark.parametrize("keys", [None, [], [1]])
def test_first_occurrence_wins(spark, cap, keys):
    table = spark.createDataFrame([(k, 2) for k in keys], "key bigint, salts int") if keys else None
    hot = None if keys is None else skew.HotKeys(table)
    got = pool.build_pool(clean(spark), perturbed(spark), asked(spark), cap, hot)
    mine = [(r["pool_rank"], r["text"], r["score"]) for r in got.where("query_idx = 1").orderBy("pool_rank").collect()]
    whole = [(0, "a", 0.9), (1, "b", 0.0), (2, "c", 0.5), (3, "d", 0.7), (4, "a", 0.6)]
    assert mine == (whole[:cap] if cap else whole)
    assert got.where("query_idx = 9").count() == 0


def test_nested_pool_keeps_empty_ones_and_goes_on_in_parts(spark):
    got = pool.nest_pool(asked(spark), pool.build_pool(clean(spark), perturbed(spark), asked(spark)), part=2)
    shown = sorted((r["query_idx"], r["part_no"], [c["text"] for c in r["candidates"]], r["correct_answer"]) for r in got.collect())
    assert shown == [(1, 0, ["a", "b"], ""), (1, 1, ["c", "d"], ""), (1, 2, ["a"], ""), (2, 0, ["z"], "x"), (3, 0, [], "y")]


def test_verdict_keys(spark):
    verdicts = spark.createDataFrame(
        [(1, 0, True, 5, "h"), (1, 1, True, None, "abc"), (1, 2, False, None, ""), (1, 9, False, None, None)],
        "query_idx bigint, doc_rank bigint, correct boolean, passage_idx bigint, doc_text_hash string",
    )
    ranked = spark.createDataFrame([(1, 2, "pid:77")], "query_idx bigint, rank bigint, doc_key string")
    got = {r["doc_rank"]: r["doc_key"] for r in marking.resolve_keys(verdicts, ranked).collect()}
    assert got == {0: "pid:5", 1: "sha1:abc", 2: "pid:77"}


def group_inputs(spark, n_zero):
    docs = [(1, i, f"pid:{i}", f"t{i}", 0.1) for i in range(4)]
    pos_side = spark.createDataFrame(docs, "query_idx bigint, rank bigint, doc_key string, text string, score double")
    neg_docs = [(1, p, i, f"pid:{i}", f"t{i}", 0.1) for p in (0, 1) for i in range(2, 20)] + [(1, 0, 50, "pid:5", "t5", 0.1)]
    neg_side = spark.createDataFrame(neg_docs, "query_idx bigint, pert_idx int, rank bigint, doc_key string, text string, score double")
    # Documents 0, 1, 2 have a score above zero; n_zero others have zero; the rest none.
    marks = [(1, f"pid:{i}", 0.5) for i in range(3)] + [(1, f"pid:{i}", 0.0) for i in range(3, 3 + n_zero)]
    scores = spark.createDataFrame(marks, "query_idx bigint, doc_key string, robustness double")
    return pos_side, neg_side, scores


@pytest.mark.parametrize("n_zero, state", [(10, "kept"), (9, "few_negatives")])
def test_exactly_n_negatives_are_enough(spark, n_zero, state):
    pos_side, neg_side, scores = group_inputs(spark, n_zero)
    pos, neg = groups.positives(pos_side, scores), groups.hard_negatives(neg_side, scores)
    records = neg_side.select("query_idx", "pert_idx").distinct()
    states = groups.eligibility(records, pos_side, scores, pos, neg, 10)
    assert [(r["n_pos"], r["n_neg"], r["state"]) for r in states.collect()] == [(3, n_zero, state)] * 2


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_drawn_groups(spark, parts):
    pos_side, neg_side, scores = group_inputs(spark, 15)
    pos_side, neg_side = pos_side.repartition(parts), neg_side.repartition(parts)
    pos, neg = groups.positives(pos_side, scores), groups.hard_negatives(neg_side, scores)
    records = neg_side.select("query_idx", "pert_idx").distinct().withColumns({
        "perturbed_query": F.when(F.col("pert_idx") == 0, "p").otherwise(""), "question": F.lit(None).cast("string"),
        "clean_question": F.lit("c"),
    })
    states = groups.eligibility(records.select("query_idx", "pert_idx"), pos_side, scores, pos, neg, 10)
    out = groups.training_records(groups.draw_positive(states, pos), groups.draw_negatives(states, neg, 10), records)
    got = sorted((r["pert_idx"], r["doc_ord"], r["doc_key"], r["question"], r["robustness_score"]) for r in out.collect())
    assert [g[1] for g in got] == list(range(11)) * 2
    assert {(g[0], g[3]) for g in got} == {(0, "p"), (1, "c")}
    for p in (0, 1):
        mine = [g for g in got if g[0] == p]
        assert mine[0][4] == 0.5 and all(m[4] == 0.0 for m in mine[1:])
        assert len({m[2] for m in mine}) == 11
    if not hasattr(test_drawn_groups, "first"):
        test_drawn_groups.first = got
    assert got == test_drawn_groups.first


def records(spark, n=6):
    return spark.createDataFrame(
        [(q, 0, f"q{q}", f"d{q}{d}", 0.5 if d == 0 else 0.0, d, "listwise+pointwise") for q in range(n) for d in range(3)],
        "query_idx bigint, pert_idx int, question string, document string, robustness_score double, doc_rank bigint, train_mode string",
    )


def test_unsorted_input_gives_whole_groups(spark):
    shuffled = records(spark).repartition(5).orderBy(F.rand(3))
    nested = groups.nest_groups(groups.ordered_records(shuffled, [F.col("doc_rank")]))
    assert sorted((r["key"], [d["text"] for d in r["docs"]]) for r in nested.collect()) == [
        (f"{q}_0", [f"d{q}0", f"d{q}1", f"d{q}2"]) for q in range(6)
    ]


def test_missing_rewrite_number_is_minus_one(spark):
    keys = records(spark, 1).withColumn("pert_idx", F.lit(None).cast("int")).select(groups.group_key()).distinct().collect()
    assert [r[0] for r in keys] == ["0_-1"]


def test_manifest_shows_empty_slices(spark):
    rows = groups.manifest(groups.slice_groups(records(spark, 3), 5), 5).collect()
    got = {r["slice"]: (r["n_groups"], r["n_records"]) for r in rows}
    assert got == {0: (1, 3), 1: (1, 3), 2: (1, 3), 3: (0, 0), 4: (0, 0), None: (3, 9)}


@pytest.mark.parametrize("q, d", [(3, 4), (10, 10), (3, 50), (50, 3), (50, 50), (0, 5), (8, 9)])
def test_pair_encoding_keeps_the_limit(spark, q, d):
    df = spark.createDataFrame([(list(range(100, 100 + q)), list(range(500, 500 + d)))], "q array<int>, d array<int>")
    ids = df.select(groups.join_ids(F.col("q"), F.col("d"), 20).alias("v")).first()["v"]
    nq, nd = sum(100 <= i < 500 for i in ids), sum(i >= 500 for i in ids)
    assert len(ids) == nq + nd + 3 and len(ids) <= 20
    if q + d <= 17:
        assert (nq, nd) == (q, d)
    else:
        assert nq + nd == 17 and abs(nq - nd) <= 1 or min(q, d) in (nq, nd)


def test_sides_share_no_query(spark):
    keys = groups.group_counts(records(spark, 40))
    held = splits.hold_out(splits.query_ids(keys), 0.1)
    train, val = splits.split_groups(keys, held)
    a = {r["query_idx"] for r in train.collect()}
    b = {r["query_idx"] for r in val.collect()}
    assert len(b) == 4 and len(a) == 36 and not a & b
    assert splits.hold_out(splits.query_ids(keys), 0.001).count() == 1
    sizes = splits.folds(splits.query_ids(keys)).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [8] * 5


def test_sampled_items(spark):
    df = spark.createDataFrame(
        [("1_0", [True, False, False, True, False], [0.5, 0.0, 0.0, 1.0, 0.0])],
        "key string, pos_mask array<boolean>, scores array<double>",
    )
    items = splits.positive_items(df)
    for redraw in (False, True):
        rows = splits.sample_items(items, 2, redraw_positive=redraw).orderBy("item_no").collect()
        assert len(rows) == 2
        for r in rows:
            assert r["picked"][0] in (0, 3) and set(r["picked"][1:]) < {1, 2, 4} and len(r["picked"]) == 3
            assert r["labels"][0] > 0 and r["labels"][1:] == [0.0, 0.0]
        if not redraw:
            assert [r["picked"][0] for r in rows] == [0, 3]
    first = splits.sample_items(items, 2, epoch=0).collect()
    assert any(splits.sample_items(items, 2, epoch=e).collect() != first for e in range(1, 5))


def test_drawn_numbers_differ_and_are_even(spark):
    df = spark.range(3000).select("id", F.array(*[splits.draw_numbers(F.lit(free), 4, 7, F.col("id")) for free in (0, 1, 3, 6)]).alias("d"))
    rows = [r["d"] for r in df.collect()]
    for k, free in enumerate((0, 1, 3, 6)):
        assert all(len(set(d[k])) == len(d[k]) == min(4, free) and set(d[k]) <= set(range(free)) for d in rows)
    firsts, pairs = ([d[3][at] for d in rows] for at in (0, 3))
    for found in (firsts, pairs):
        assert all(400 < found.count(n) < 600 for n in range(6))


def in_parts(spark, part):
    scores = {"1_0": [0.5, 0.7, 0.0, 0.0, 1.0, 0.0, 0.2], "2_0": [0.0, 0.5]}
    return spark.createDataFrame(
        [(k, n, [x > 0 for x in v[at : at + part]], v[at : at + part], [[1]] * len(v[at : at + part]))
         for k, v in scores.items() for n, at in enumerate(range(0, len(v), part))],
        "key string, part_no bigint, pos_mask array<boolean>, scores array<double>, input_ids array<array<int>>",
    )


@pytest.mark.parametrize("redraw", [False, True])
def test_parts_of_a_group_change_no_result(spark, redraw):
    split, whole = in_parts(spark, 2), in_parts(spark, 10).drop("part_no")
    assert groups.encoding_stats(split).collect() == groups.encoding_stats(whole).collect()
    assert groups.encoding_stats(split).first()["n_groups"] == 2
    shown = lambda df, *c: sorted(tuple(r[k] for k in ("key", "item_no", "pos_at", *c)) for r in df.collect())
    items = splits.positive_items(whole)
    assert shown(splits.positive_items(split)) == shown(items)
    got = splits.sample_over_parts(split, 2, redraw_positive=redraw)
    assert shown(got, "picked", "labels") == shown(splits.sample_items(items, 2, redraw_positive=redraw), "picked", "labels")


@pytest.mark.parametrize("name", [
    "g7_defaults", "g8_nested_pool", "h19_nested_groups", "h24_masks_and_scores", "h26_encoding_stats", "j6_redrawn_items",
])
def test_queries_do_not_depend_on_parts(spark, small, monkeypatch, name):
    run = lambda: sorted(map(str, catalog.QUERIES[name](spark, small).collect()))
    whole = run()
    for nest in (pool.nest_pool, groups.nest_groups, groups.encoded_groups):
        monkeypatch.setattr(nest, "__defaults__", (2,))
    assert run() == whole


def test_padding(spark):
    df = spark.createDataFrame([(i, list(range(1, i + 2))) for i in range(5)], "id int, input_ids array<int>")
    rows = splits.padded_batches(df, [F.col("id")], 2).orderBy("id").collect()
    assert [len(r["input_ids"]) for r in rows] == [2, 2, 4, 4, 5]
    assert [sum(r["attention_mask"]) for r in rows] == [1, 2, 3, 4, 5]
