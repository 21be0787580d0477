"""Near-duplicate classes against all pairs, by both measures, on random texts with copies of every closeness."""

import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest

from steadfetch import session
from steadfetch.llm import neardup, sketch


def texts(seed, n=60):
    """Random texts, each with some copies in which more and more words differ, a repeated line, or nothing changed."""
    rng = random.Random(seed)
    out = []
    shared = [f"common{k}" for k in range(60)]
    for t in range(n):
        own = [f"t{t}w{k}" for k in range(rng.choice([12, 60, 150]))]
        base = own + (shared if t % 2 else [])
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            if rng.random() < 0.3:
                copy += copy[:10] * rng.randint(1, 12)
            out.append(" ".join(copy))
    return out


def all_pairs(rows, least):
    sets = []
    for text in rows:
        _, value, times = sketch.shingles(pa.array([text]))
        sets.append((value, sketch.weights(times)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if max(sketch.similarity(sets[a], sets[b])) >= least:
                links += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return links, [root(k) for k in range(len(rows))]


@pytest.mark.parametrize("block", [2, 4096])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_NODES", block)
    rows = texts(1)
    links, want = all_pairs(rows, 0.8)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).select("doc_id", "class_id").collect()}
    assert links > 60 and [got[k] for k in range(len(rows))] == want


@pytest.mark.parametrize("nodes, heads", [(2, 1), (4, 2)])
def test_large_neighbourhoods_equal_all_pairs(spark, monkeypatch, nodes, heads):
    monkeypatch.setattr(neardup, "GROUP_NODES", nodes)
    monkeypatch.setattr(neardup, "HEADS", heads)
    rows = texts(2, 30)
    _, want = all_pairs(rows, 0.8)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).select("doc_id", "class_id").collect()}
    assert [got[k] for k in range(len(rows))] == want


def near_misses(n=60, words=200, changed=7):
    """Texts that all differ from one another by about 0.3: likely by signature, and no links."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for t in range(n):
        own = list(base)
        for k in range(changed):
            own[k * words // changed] = f"x{t}y{k}"
        out.append(" ".join(own))
    return out


def signed(rows):
    doc, value, _ = sketch.shingles(pa.array(rows))
    short = sketch.short_signature(sketch.signatures(doc, value, np.ones(len(doc)), len(rows)))
    return pa.array([row.tobytes() * 2 for row in short], pa.binary())


def grouped(rows, first, left):
    n = len(rows)
    zeros = pa.array(np.zeros(n, np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), zeros, zeros, pa.array(left), pa.array([b"%04d" % k for k in range(n)], pa.binary()),
         pa.array(np.arange(n)), signed(rows), pa.array(rows)],
        names=[first, "minor", "block", "left", "node", "mark", "signature", "text"],
    )


def test_near_misses_leave_the_task_as_a_forest():
    """A bucket of n near misses gives fewer than n rows, not n * n / 2, and they connect all."""
    rows = near_misses()
    n = len(rows)
    batch = grouped(rows + rows, "band", [True] * n + [False] * n)
    marks = pa.array(np.tile(np.arange(n), 2))
    batch = batch.set_column(batch.schema.get_field_index("mark"), "mark", marks)
    found = [b for b in neardup._met(0.8)(iter([batch.slice(0, n // 2), batch.slice(n // 2)]))]
    assert n - 1 == sum(b.num_rows for b in found)


def test_compared_texts_leave_the_task_as_links():
    misses = near_misses()
    links = lambda rows: sum(b.num_rows for b in neardup._compared(0.8)(iter([grouped(rows, "grp", [True] * len(rows))])))
    assert all_pairs(misses, 0.8)[0] == 0 and links(misses) == 0
    copies = near_misses(changed=1)
    assert all_pairs(copies, 0.8)[0] == 60 * 59 // 2 and links(copies) == 59


def test_tables_on_the_way_are_deleted(spark):
    """Only the table that the result reads is left in the scratch folder."""
    root = pathlib.Path(session._scratch_root(spark).removeprefix("file:"))
    docs = spark.createDataFrame(list(enumerate(texts(3, 10))), "doc_id bigint, text string")
    for run in (neardup.classes, neardup.representatives):
        before = set(root.glob("*"))
        assert run(docs).count() and len(set(root.glob("*")) - before) == 1


def test_few_texts_are_found_without_moving_the_others(spark, monkeypatch):
    """By broadcast hashes or by a join, each text of a wanted node comes as often as it is there."""
    texts_of = spark.range(200).selectExpr("CAST(CAST(id % 50 AS STRING) AS BINARY) AS node", "CAST(id AS STRING) AS text")
    near = texts_of.where("text < '3'").select("node").distinct()
    want = sorted((bytes(r["node"]), r["text"]) for r in texts_of.join(near, "node").collect())
    plans = []
    for few in (neardup.FEW_NODES, 1):
        monkeypatch.setattr(neardup, "FEW_NODES", few)
        found = neardup._texts_of(near, texts_of)
        assert sorted((bytes(r["node"]), r["text"]) for r in found.collect()) == want
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]


def test_recall_of_the_bands():
    """Registers that agree with chance 0.8 share a band but for some in 100,000."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(20):
        agree = rng.random((10_000, sketch.REGISTERS)) < 0.8
        missed += int((~agree[:, sketch.PLACES].all(axis=2).any(axis=1)).sum())
    assert missed / 200_000 < 1e-4
    assert sketch.PLACES.shape == (sketch.BANDS, sketch.ROWS) and set(sketch.PLACES.ravel()) == set(range(sketch.REGISTERS))


def test_short_signatures_estimate():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 62, (2000, sketch.REGISTERS), dtype=np.uint64)
    for share in (0.4, 0.8, 1.0):
        other = np.where(rng.random(one.shape) < share, one, rng.integers(0, 1 << 62, one.shape, dtype=np.uint64))
        found = sketch.estimate(sketch.short_signature(one), sketch.short_signature(other))
        assert abs(found.mean() - share) < 0.01
