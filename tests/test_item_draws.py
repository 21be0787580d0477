import pytest

from steadfetch.operators import splits

ROW = "key string, part_no bigint, pos_mask array<boolean>, scores array<double>"


def scored(n, seed):
    return [float((k * 7 + seed) % 3 == 0) * (k + 1) / n for k in range(n)]


def group(key, scores, part):
    parts = [scores[at : at + part] for at in range(0, len(scores), part)]
    return [(key, no, [x > 0 for x in p], p) for no, p in enumerate(parts)]


def shown(df):
    return sorted((r["key"], r["item_no"], r["pos_at"], r["picked"], r["labels"]) for r in df.collect())


@pytest.mark.parametrize("redraw", [False, True])
def test_small_groups_draw_inside_their_row(spark, redraw):
    df = spark.createDataFrame([g for k in range(20) for g in group(f"{k}_0", scored(3 + k, k), 100)], ROW)
    plan = splits.sample_over_parts(df, 2, redraw_positive=redraw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("redraw", [False, True])
def test_small_large_and_divided_groups_draw_alike(spark, redraw):
    sizes = {"1_0": 5, "2_0": splits.SMALL_GROUP, "3_0": splits.SMALL_GROUP + 1, "4_0": 150, "5_0": 1}
    divided = [g for k, (key, n) in enumerate(sizes.items()) for g in group(key, scored(n, k), 100)]
    whole = [g for k, (key, n) in enumerate(sizes.items()) for g in group(key, scored(n, k), 1000)]
    # A short first part of a longer group, and a group without a positive.
    divided += group("6_0", scored(7, 3), 2) + group("7_0", [0.0, 0.0], 100)
    whole += group("6_0", scored(7, 3), 1000) + group("7_0", [0.0, 0.0], 1000)
    items = splits.positive_items(spark.createDataFrame(whole, ROW).drop("part_no"))
    expected = shown(splits.sample_items(items, 3, redraw_positive=redraw))
    assert shown(splits.sample_over_parts(spark.createDataFrame(divided, ROW), 3, redraw_positive=redraw)) == expected
