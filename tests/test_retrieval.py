import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfetch.operators import cell_index, retrieval
from steadfetch.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    held = rng.normal(size=(300, 8)).round(1)
    held[250:] = held[:50]  # copies tie on score
    asked = rng.normal(size=(40, 8)).round(1)
    passages = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "passage_idx bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(asked)],
                                    "query_idx bigint, pert_idx bigint, embedding array<double>")
    scores = np.round(asked @ held.T, 6)
    best = {
        (q, rank, int(p)) for q in range(40)
        for rank, p in enumerate(sorted(range(300), key=lambda p: (-scores[q, p], p))[:7])
    }
    return queries, passages, best


def found(hits):
    return {(r["query_idx"], r["rank"], r["passage_idx"]) for r in hits.collect()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_exact_against_a_plain_sort(data, parts):
    queries, passages, best = data
    assert found(retrieval.top_k(queries.repartition(parts), passages.repartition(parts), 7)) == best


def test_blocks_equal_broadcast(data):
    queries, passages, best = data
    hits = retrieval.top_k(queries, passages, 7, broadcast_bytes=0, query_block=9, passage_block=50)
    assert found(hits) == best


def test_probes_over_all_cells_are_exact(data):
    queries, passages, best = data
    centres = retrieval.fit_cells(passages.withColumn("embedding", F.col("embedding").cast("array<float>")), 5)
    assert found(retrieval.probed_top_k(queries, passages, centres, 7, probes=5, passage_block=40)) == best
    few = retrieval.probed_top_k(queries, passages, centres, 7, probes=1)
    share = retrieval.recall(few, retrieval.top_k(queries, passages, 7)).first()["recall"]
    assert 0.2 < share < 1.0


def test_fewer_passages_than_k(data):
    queries, passages, _ = data
    assert retrieval.top_k(queries, passages.limit(3), 7).groupBy("query_idx").count().where("count != 3").count() == 0


def test_text_join_keeps_ranks(spark, data):
    queries, passages, _ = data
    hits = retrieval.top_k(queries, passages, 7)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(0, 300, 2)], "passage_idx bigint, text string")
    kept = retrieval.with_text(hits, texts)
    assert kept.where("passage_idx % 2 = 1").count() == 0
    expected = {(q, r, p) for q, r, p in found(hits) if p % 2 == 0}
    assert found(kept) == expected


def test_stored_index_grows_and_reads_only_probed_cells(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    held = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "passage_idx bigint, embedding array<double>")
    asked = held.where("passage_idx < 20").select(F.col("passage_idx").alias("query_idx"), F.lit(0).alias("pert_idx"), "embedding")
    path = scratch_path(spark, "index")
    cell_index.build(held.where("passage_idx < 300"), path, 6, sample_rows=100)
    before = cell_index.centres_of(spark, path)
    cell_index.append(held.where("passage_idx >= 300"), path)
    assert np.array_equal(before, cell_index.centres_of(spark, path))
    rows = lambda df: sorted((r["query_idx"], r["rank"], r["passage_idx"]) for r in df.collect())
    assert rows(cell_index.search(asked, path, 5, probes=6)) == rows(retrieval.top_k(asked, held, 5))
    one = cell_index.search(asked.limit(1), path, 5, probes=1)
    assert one.count() == 5 and one.where("passage_idx = query_idx AND rank = 0").count() == 1
    assert cell_index.search(asked.where("false"), path, 5).collect() == []
    assert 50 <= cell_index.sample(held, 100).count() <= 150 and cell_index.sample(held, 400).count() == 400


def test_blocks_of_cells_give_the_same_hits(spark):
    rng = np.random.default_rng(6)
    held = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(90, 4)))], "passage_idx bigint, embedding array<double>")
    asked = held.select(F.col("passage_idx").alias("query_idx"), F.lit(0).alias("pert_idx"), "embedding")
    rows = lambda df: sorted((r["query_idx"], r["rank"], r["passage_idx"]) for r in df.collect())
    small = retrieval.top_k(asked, held, 3, broadcast_bytes=0, query_block=20, passage_block=25)
    assert rows(small) == rows(retrieval.top_k(asked, held, 3))


def shuffled(df):
    """Rows that all exchanges of an executed plan wrote."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_small_blocks_do_not_multiply_what_moves(data):
    queries, passages, _ = data
    hits = retrieval.search_cells(queries, passages, 7, ["query_idx", "pert_idx"], query_block=1, passage_block=1)
    # The queries, the passages for one lot, and the passages once more to find equal vectors.
    assert shuffled(hits) <= 40 + 2 * 300


def test_many_lots_equal_one(data, monkeypatch):
    queries, passages, best = data
    monkeypatch.setattr(retrieval, "LOT_BYTES", 4_000)
    assert found(retrieval.top_k(queries, passages, 7, broadcast_bytes=0)) == best
    centres = np.eye(8)[:5]
    assert found(retrieval.probed_top_k(queries, passages, centres, 7, probes=5)) == best


@pytest.mark.parametrize("length", [1.0, 1e-4, 1e5, 1e12, 1e18])
def test_single_precision_loses_no_hit(length):
    """Scores that single precision cannot tell apart, ties, and lengths beyond its range."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    held = (base + rng.normal(size=(500, 64)) * 1e-6) * length
    held[400:] = held[:100]
    asked = (base + rng.normal(size=(20, 64)) * 1e-6) * length
    exact = np.round(np.array([[np.einsum("i,i", q, p) for p in held] for q in asked]), 6)
    rows, scores, ids = retrieval._top_k(asked, held, np.arange(500), 9)
    for q in range(20):
        order = sorted(range(500), key=lambda p: (-exact[q, p], p))[:9]
        got = scores[rows == q]
        assert np.allclose(got, exact[q, order], rtol=1e-14, atol=2e-6 * min(1, length ** 2))
        if length <= 1:
            assert ids[rows == q].tolist() == order


def test_many_copies_of_a_passage(spark):
    """Equal vectors have equal scores, so the smallest ids are the hits and the others need not meet anybody."""
    held = spark.range(3000).select(F.col("id").alias("passage_idx"), F.array(F.lit(0.6), F.when(F.col("id") < 5, 0.1).otherwise(0.8)).alias("embedding"))
    asked = held.select(F.col("passage_idx").alias("query_idx"), F.lit(0).alias("pert_idx"), "embedding")
    hits = retrieval.top_k(asked, held, 3, broadcast_bytes=0)
    assert hits.count() == 9000 and hits.where("passage_idx != rank + 5").count() == 0
    assert shuffled(retrieval.search_cells(asked, held, 3, ["query_idx", "pert_idx"])) < 3000 + 3000


def test_hits_are_searched_once(data):
    """Hits are read back, so counting hot keys, joining and comparing do not search again."""
    queries, passages, _ = data
    centres = np.eye(8)[:5]
    for hits in (retrieval.top_k(queries, passages, 7), retrieval.top_k(queries, passages, 7, broadcast_bytes=0),
                 retrieval.probed_top_k(queries, passages, centres, 7, probes=2)):
        assert "MapInArrow" not in hits._jdf.queryExecution().toString()


def test_candidates_without_text(data):
    queries, passages, best = data
    nested = retrieval.nest_hits(retrieval.top_k(queries, passages, 7), queries=queries).collect()
    assert {(r["query_idx"], c["rank"], c["passage_idx"]) for r in nested for c in r["candidates"]} == best


@pytest.mark.parametrize("lot_bytes", [128 << 20, 20_000])
def test_rescored_pairs_against_all_products(spark, monkeypatch, lot_bytes):
    """Several vectors per key, passages that are there twice, nulls, a key with most hits, keys of another type."""
    monkeypatch.setattr(retrieval, "LOT_BYTES", lot_bytes)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(60, 4)).round(2)
    held = [(i, v.tolist(), f"t{i}") for i, v in enumerate(vectors[:40])]
    held += [(3, [1.0, 2.0, 3.0, 4.0], "again"), (40, None, "none"), (41, [1.0, None, 0.0, 0.0], "half"), (None, [1.0] * 4, "lost")]
    asked = [(q, s, vectors[40 + q + s].tolist()) for q in range(12) for s in range(5)]
    asked += [(0, 5, None), (None, 0, [1.0] * 4)]
    hits = [(q, p, f"k{p}") for q in range(12) for p in range(0, 44, 1 if q == 7 else 6)] + [(None, 1, "x"), (2, None, "y"), (99, 1, "z")]
    expected = []
    for q, p, key in hits:
        for a, s, v in asked:
            for i, w, told in held:
                if q is not None and p is not None and (q, p) == (a, i):
                    whole = v is not None and w is not None and None not in w
                    expected.append((q, p, key, s, told, round(float(np.dot(v, w)), 6) if whole else None))
    scored = retrieval.rescore(
        spark.createDataFrame(hits, "query_idx bigint, passage_idx bigint, doc_key string"),
        spark.createDataFrame(asked, "query_idx int, pert_idx int, embedding array<double>"),
        spark.createDataFrame(held, "passage_idx bigint, embedding array<double>, told string"), ["query_idx"], carry=["pert_idx", "told"],
    )
    assert scored.columns == ["query_idx", "passage_idx", "doc_key", "pert_idx", "told", "scoring_score"]
    order = lambda r: (*r[:5], r[5] is None, r[5] or 0.0)
    got = sorted((tuple(r) for r in scored.collect()), key=order)
    assert len(got) == len(expected)
    for g, e in zip(got, sorted(expected, key=order)):
        assert g[:5] == e[:5] and (g[5] == e[5] if e[5] is None else abs(g[5] - e[5]) < 2e-6)


def test_rescoring_moves_no_vector_per_pair(spark):
    asked = spark.range(1000).select((F.col("id") % 200).alias("query_idx"), F.floor(F.col("id") / 200).alias("pert_idx"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    held = spark.range(50).select(F.col("id").alias("passage_idx"), F.array(F.rand(3), F.rand(4)).alias("embedding"))
    hits = spark.range(6000).select((F.col("id") % 200).alias("query_idx"), F.floor(F.col("id") / 200).alias("passage_idx")).localCheckpoint()
    scored = retrieval.rescore(hits, asked, held, ["query_idx"], carry=["pert_idx"])
    lots = min(spark.sparkContext.defaultParallelism, 2)
    # Hits, query vectors and passages of the lots; who wants what (per task, then per passage) and the passages it goes to.
    assert scored.count() == 30_000
    assert shuffled(scored) <= 6000 + 1000 + 50 * lots + 6000 + 50 * lots * 9 + 50


def test_rescoring_refuses_vectors_of_different_lengths(spark):
    hits = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "query_idx bigint, pert_idx bigint, passage_idx bigint")
    asked = spark.createDataFrame([(0, 0, [1.0, 2.0])], "query_idx bigint, pert_idx bigint, embedding array<double>")
    held = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "passage_idx bigint, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        retrieval.rescore(hits, asked, held).collect()


def test_a_search_carried_on_equals_a_new_one(spark, data):
    """Cells that were visited are not visited again, and the hits found in them still count."""
    queries, passages, _ = data
    keys, centres = ["query_idx", "pert_idx"], retrieval.fit_cells(passages, 5)
    path = scratch_path(spark, "carried")
    cell_index.build(passages, path, 5)
    rows = lambda df: sorted(tuple(r) for r in df.select(*keys, "rank", "passage_idx", "score").collect())
    probed, stored, before = None, None, 0
    for probes in (1, 3, 5, 5):
        probed = retrieval.probed_top_k(queries, passages, centres, 7, probes=probes, found=probed, probed=before)
        stored = cell_index.search(queries, path, 7, probes=probes, found=stored, probed=before)
        before = probes
        assert rows(probed) == rows(retrieval.probed_top_k(queries, passages, centres, 7, probes=probes))
        assert rows(stored) == rows(cell_index.search(queries, path, 7, probes=probes))
    three = {r["query_idx"]: r["_cells"] for r in retrieval.with_cells(queries, keys, centres, 3).collect()}
    rest = {r["query_idx"]: r["_cells"] for r in retrieval.with_cells(queries, keys, centres, 3, skip=1).collect()}
    assert all(rest[q] == cells[1:] for q, cells in three.items()) and len(three) == 40


def test_scores_of_no_interest_are_not_held():
    """A bound that k hits reach changes no hit among the rest; ties with the bound are kept."""
    rng = np.random.default_rng(4)
    held, asked = rng.normal(size=(700, 6)).round(1), rng.normal(size=(30, 6)).round(1)
    held[600:] = held[:100]
    exact = np.round(asked @ held.T, 6)
    bound = np.sort(exact, axis=1)[:, -12]
    search = retrieval._Search(asked, 20, passage_block=64, least=bound.copy())
    search.meet(held, np.arange(700))
    row, score, ident = search.found()
    for q in range(30):
        best = [p for p in sorted(range(700), key=lambda p: (-exact[q, p], p)) if exact[q, p] >= bound[q] - 1e-9][:20]
        assert ident[row == q].tolist() == best


def test_lists_that_are_not_there_are_empty_on_their_way_to_python(spark, monkeypatch):
    """A null list makes every later row of a batch walk over all rows since the last list."""
    seen = []
    sort = type(spark.range(1)).sortWithinPartitions

    def look(df, *columns, **more):
        seen.append(df)
        return sort(df, *columns, **more)

    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", look)
    held = spark.range(50).select(F.col("id").alias("passage_idx"), F.array(F.rand(3), F.rand(4)).alias("embedding"))
    asked = held.select(F.col("passage_idx").alias("query_idx"), F.lit(0).alias("pert_idx"), "embedding")
    hits = retrieval.search_cells(asked, held, 3, ["query_idx", "pert_idx"])
    retrieval.rescore(hits.drop("score"), asked, held).collect()
    assert len(seen) == 2
    for df in seen:
        lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
        assert {"_q", "_p"} <= set(lists) and df.where(" OR ".join(f"{c} IS NULL" for c in lists)).isEmpty()
