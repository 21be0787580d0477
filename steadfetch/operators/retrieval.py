"""Top-k passages by inner product, exact and by probed cells.

Scores are rounded to six places and ties go to the smaller passage id, so results
do not depend on partitioning. A task holds some queries with their k best passages so
far and lets passages stream by. Products are taken in single precision; whatever may be
among the best within the error bound of such a product is scored again in double precision.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, settle_last
from ..sources.tables import spread
from .ordinal import ordinal_in_group
from .skew import HotKeys, hot_keys, split_hot_join

SCORE_PLACES = 6
# Centres of cells go to every task and must fit in this many bytes.
BROADCAST_BYTES = 256 << 20
# So must queries with their k best hits to go to every task; more queries are dealt out in lots.
QUERY_BYTES = 32 << 20
# Queries and their best hits that one task holds.
LOT_BYTES = 128 << 20
# Most queries and passages of one matrix product.
QUERY_BLOCK = 16_384
PASSAGE_BLOCK = 65_536
# A lot has at least this many queries, or all.
_LOT_QUERIES = 4_096
# Passages are looked at so many at a time (an Arrow batch has 10,000), and so many products with them.
_STREAM_ROWS = 10_240
_MATRIX_CELLS = 1 << 22
# A product is made and looked at in tiles of so many columns.
_TILE_COLUMNS = 2_048
# Pairs scored again at a time.
_EXACT_PAIRS = 1 << 16
# Beyond such lengths single precision may overflow.
_SINGLE_RANGE = 1e15
_NO_ID = np.iinfo(np.int64).max


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _best(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int):
    """The k best entries of every row, by score and then by id."""
    order = np.lexsort((ident, -score, row))
    row, score, ident = row[order], score[order], ident[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], ident[keep]


class _Search:
    """Some queries and the k best passages of each among those met so far. Scores below `least` are of no interest."""

    def __init__(
        self, queries: np.ndarray, k: int, query_block: int = QUERY_BLOCK, passage_block: int = PASSAGE_BLOCK,
        least: np.ndarray | None = None,
    ):
        self.queries, self.k = queries, k
        self.worst = np.full(len(queries), -np.inf) if least is None else least
        self.lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), _NO_ID)
        self.width = max(1, min(passage_block, _STREAM_ROWS))
        self.height = max(1, min(query_block, _MATRIX_CELLS // self.width))
        # Products and what is near enough are written to the same place again and again.
        self.cells = np.empty(self.height * min(self.width, _TILE_COLUMNS), np.float32)
        self.near = np.empty(self.cells.size + 8, bool)

    def meet(self, passages: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Lets the queries (`rows` of them, or all) meet passages."""
        n = len(self.queries) if rows is None else len(rows)
        for at in range(0, len(ids), self.width):
            held, named = passages[at:at + self.width], ids[at:at + self.width]
            reach = np.sqrt(np.einsum("ij,ij->i", held, held, dtype=np.float64)).max()
            with np.errstate(over="ignore", invalid="ignore"):
                single = held.astype(np.float32)
            for start in range(0, n, self.height):
                some = slice(start, min(n, start + self.height)) if rows is None else rows[start:start + self.height]
                self._meet(np.arange(some.start, some.stop) if rows is None else some, some, held, single, reach, named)

    def _meet(self, names, some, held, single, reach, ids) -> None:
        bound = self.lengths[some] * reach
        rounding = 0.51 * 10.0 ** -SCORE_PLACES
        asked = self.queries[some]
        worst = self.worst[some]
        if np.all(bound < _SINGLE_RANGE):
            # Twice the bound on the error of a product of this many terms and of its factors.
            margin = bound * ((held.shape[1] + 4) * 2.0 ** -23) + rounding
            asked = asked.astype(np.float32)
            floor = worst - margin
            open_rows = np.flatnonzero(worst == -np.inf)
            if len(open_rows) and len(ids) > self.k:
                floor[open_rows] = _kth(asked[open_rows] @ single.T, self.k) - 2 * margin[open_rows]
            row, col = self._near(asked, single, _below(floor, np.dtype(np.float32)))
        else:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = asked @ held.astype(np.float64).T
            scores[np.isnan(scores)] = -np.inf
            margin = np.nan_to_num(bound, posinf=0.0) * ((held.shape[1] + 4) * 2.0 ** -52) + rounding
            floor = worst - margin
            open_rows = np.flatnonzero(worst == -np.inf)
            if len(open_rows) and len(ids) > self.k:
                floor[open_rows] = _kth(scores[open_rows], self.k) - 2 * margin[open_rows]
            row, col = np.nonzero(scores >= floor[:, None])
        if len(row) == 0:
            return
        row = names[row]
        exact = np.empty(len(row))
        for at in range(0, len(row), _EXACT_PAIRS):
            r, c = row[at:at + _EXACT_PAIRS], col[at:at + _EXACT_PAIRS]
            exact[at:at + _EXACT_PAIRS] = np.einsum("ij,ij->i", self.queries[r], held[c].astype(np.float64))
        self._take(row, np.round(exact, SCORE_PLACES), ids[col])

    def _near(self, asked: np.ndarray, passages: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the products that reach the bound of their row, found in tiles that fit a core's cache."""
        n, rows, cols = len(asked), [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
        for at in range(0, len(passages), _TILE_COLUMNS):
            tile = passages[at:at + _TILE_COLUMNS]
            wide = len(tile)
            scores = self.cells[:n * wide].reshape(n, wide)
            np.matmul(asked, tile.T, out=scores)
            some = np.flatnonzero(scores.max(axis=1) >= floor)
            if len(some) == 0:
                continue
            if 2 * len(some) < n:
                scores = scores[some]
            else:
                some = np.arange(n)
            size = scores.size
            # Few are near, so eight are looked at as one word.
            words = self.near[:(size + 7) // 8 * 8]
            words[size:] = False
            np.greater_equal(scores, floor[some, None], out=words[:size].reshape(scores.shape))
            word = np.flatnonzero(words.view(np.uint64))
            of, place = np.nonzero(words.reshape(-1, 8)[word])
            row, col = np.divmod(word[of] * 8 + place, wide)
            rows.append(some[row])
            cols.append(col + at)
        return np.concatenate(rows), np.concatenate(cols)

    def _take(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        met = score >= self.worst[row]
        row, score, ident = row[met], score[met], ident[met]
        if len(row) == 0:
            return
        changed = np.unique(row)
        _, scores, ids = _best(
            np.concatenate([np.repeat(changed, self.k), row]),
            np.concatenate([self.scores[changed].ravel(), score]),
            np.concatenate([self.ids[changed].ravel(), ident]), self.k,
        )
        self.scores[changed], self.ids[changed] = scores.reshape(-1, self.k), ids.reshape(-1, self.k)
        self.worst[changed] = np.maximum(self.worst[changed], self.scores[changed, -1])

    def found(self):
        """(query row, score, id) of all that is held, row by row."""
        row, place = np.nonzero(self.ids != _NO_ID)
        return row, self.scores[row, place], self.ids[row, place]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _below(floor: np.ndarray, dtype) -> np.ndarray:
    """The bounds in the type of the scores, never rounded up."""
    cast = floor.astype(dtype)
    return np.where(cast > floor, np.nextafter(cast, dtype.type(-np.inf)), cast)


def _top_k(queries: np.ndarray, passages: np.ndarray, ids: np.ndarray, k: int):
    """(query row, score, id) of the k best passages per query row."""
    search = _Search(queries, k)
    search.meet(passages, ids)
    return search.found()


def _schema(queries: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [queries.schema[c] for c in keys]
        + [T.StructField("passage_idx", T.LongType()), T.StructField("score", T.DoubleType())]
    )


def _hits(names: pa.Table, search: _Search):
    """What a search holds, as batches of (keys, passage_idx, score)."""
    rows, scores, ids = search.found()
    for at in range(0, len(rows), _EXACT_PAIRS):
        part = slice(at, at + _EXACT_PAIRS)
        table = names.take(pa.array(rows[part])).append_column("passage_idx", pa.array(ids[part]))
        yield from table.append_column("score", pa.array(scores[part])).combine_chunks().to_batches()


def best_hits(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of all tasks. Each task already holds at most k per query."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("passage_idx"))
    return (
        hits.withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k)
        .withColumn("rank", F.col("_n") - 1)
        .drop("_n")
    )


def top_k(
    queries: DataFrame, passages: DataFrame, k: int = 100, keys: list[str] | None = None,
    broadcast_bytes: int = QUERY_BYTES, query_block: int = QUERY_BLOCK,
    passage_block: int = PASSAGE_BLOCK,
) -> DataFrame:
    """Exact top-k: (keys, rank from 0, passage_idx, score).

    Queries whose measured size fits the budget go to every task once and the passages
    stay where they are. Otherwise they are dealt out in lots, which all passages visit. The result is
    written once, as a search is dear and its hits are often used more than once.
    """
    keys = keys or ["query_idx", "pert_idx"]

    def search() -> DataFrame:
        # Counted, looked at and met: made once.
        asked = settle(queries.select(*keys, "embedding").where(F.col("embedding").isNotNull()))
        n_queries, head = asked.count(), asked.select("embedding").first()
        dim = len(head[0]) if head else 0
        if n_queries * (12 * dim + 48 * k) <= broadcast_bytes:
            hits = _search_with_matrix(asked, passages, k, keys)
        else:
            hits = search_cells(asked, passages, k, keys, query_block, passage_block)
        return best_hits(hits, keys, k)

    return settle_last(queries.sparkSession, search)


def _search_with_matrix(queries: DataFrame, passages: DataFrame, k: int, keys: list[str]) -> DataFrame:
    table = queries.select(*keys, "embedding").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (table.select(keys).combine_chunks(), _matrix(table.column("embedding")))
    )

    def run(batches):
        names, matrix = shared.value
        search = _Search(matrix, k)
        for batch in batches:
            if len(batch):
                search.meet(_stored(batch.column(1)), batch.column(0).to_numpy())
        yield from _hits(names, search)

    held = passages.select("passage_idx", "embedding").where(F.col("embedding").isNotNull())
    return spread(held).mapInArrow(run, _schema(queries, keys))


def _stored(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix, floats as floats."""
    return _matrix(column, np.float32 if column.type.value_type == pa.float32() else np.float64)


def _no_list(dtype: T.ArrayType) -> Column:
    """A list for rows that have none. On its way to Python a row looks at all rows since the last one with a list that is not null."""
    return F.array().cast(dtype)


def search_cells(
    queries: DataFrame, passages: DataFrame, k: int, keys: list[str], query_block: int = QUERY_BLOCK,
    passage_block: int = PASSAGE_BLOCK,
) -> DataFrame:
    """The k best passages of each query, in lots of queries: (keys, passage_idx, score).

    A lot is one task. It holds its queries, of bounded size, and the k best passages of each; all passages are
    sent to every lot and pass by as a stream, so what moves is the queries once and the passages once per lot.
    A column `_least` of queries is a score below which hits are of no interest; null for none.
    With columns `_cells` (array<int>) of queries and `_cell` of passages a query meets the passages of its own cells
    only, and a lot gets the passages of the cells that its queries ask for. Of passages with the same vector those
    with the k smallest ids stand for all, as they have the same score.
    """
    spark = queries.sparkSession
    celled, no_least = "_cells" in queries.columns, F.lit(None).cast("double").alias("_least")
    head = queries.select("embedding").first()
    n, dim = queries.count(), len(head[0]) if head else 0
    no_cells = _no_list(T.ArrayType(T.IntegerType()))
    asked_cells = F.col("_cells") if celled else no_cells
    n_cells = queries.agg(F.max(F.size("_cells"))).first()[0] or 0 if celled else 0
    cores = spark.sparkContext.defaultParallelism
    most = max(1, LOT_BYTES // (8 * dim + 32 * k + 16 * n_cells + 64))
    lots = max(math.ceil(n / most), min(cores, math.ceil(n / _LOT_QUERIES)), 1)
    if lots > cores:
        lots = math.ceil(lots / cores) * cores
    lot = F.pmod(F.xxhash64(*keys), F.lit(lots)).cast("int")
    left = queries.select(
        lot.alias("_lot"), F.lit(0).alias("_kind"), F.lit(0).alias("_cell"), *keys, F.col("embedding").alias("_q"),
        asked_cells.alias("_cells"), F.col("_least") if "_least" in queries.columns else no_least, F.lit(None).cast("bigint").alias("passage_idx"),
        _no_list(passages.schema["embedding"].dataType).alias("_p"),
    )
    alike = Window.partitionBy("embedding").orderBy("passage_idx")
    held = passages.where(F.col("embedding").isNotNull()).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n")
    if celled:
        # One row per cell, with at most as many numbers as there are lots.
        wanted = queries.select(lot.alias("_lot"), F.explode("_cells").alias("_cell")).distinct()
        wanted = settle(wanted.groupBy("_cell").agg(F.collect_list("_lot").alias("_lots")))
        held = held.join(F.broadcast(wanted), "_cell")
    else:
        held = held.withColumns({"_cell": F.lit(0), "_lots": F.sequence(F.lit(0), F.lit(lots - 1))})
    right = held.select(
        F.explode("_lots").alias("_lot"), F.lit(1).alias("_kind"), F.col("_cell").cast("int").alias("_cell"),
        *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in keys],
        _no_list(queries.schema["embedding"].dataType).alias("_q"), no_cells.alias("_cells"),
        no_least, "passage_idx", F.col("embedding").alias("_p"),
    )

    def run(batches):
        asked, search, places = [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n_asked = int(np.searchsorted(table.column("_kind").to_numpy(), 1))
            if n_asked:
                asked.append(table.slice(0, n_asked).select([*keys, "_q", "_cells", "_least"]))
            if n_asked == len(batch) or not asked and search is None:
                continue
            if search is None:
                asked = pa.concat_tables(asked).combine_chunks()
                names, least = asked.select(keys), np.nan_to_num(asked.column("_least").to_numpy(), nan=-np.inf)
                search = _Search(_matrix(asked.column("_q")), k, query_block, passage_block, least)
                places = _rows_by_cell(asked.column("_cells")) if celled else None
                asked = []
            rest = table.slice(n_asked)
            met, ids, vectors = (f(rest.column(c).combine_chunks()) for f, c in (
                (lambda x: x.to_numpy(), "_cell"), (lambda x: x.to_numpy(), "passage_idx"), (_stored, "_p")))
            edges = np.flatnonzero(np.diff(met, prepend=met[0] - 1)).tolist() + [len(met)]
            for a, b in zip(edges, edges[1:]):
                search.meet(vectors[a:b], ids[a:b], places[int(met[a])] if celled else None)
        if search is not None:
            yield from _hits(names, search)

    dealt = left.unionByName(right).repartitionById(lots, F.col("_lot")).sortWithinPartitions("_kind", "_cell")
    return dealt.drop("_lot").mapInArrow(run, _schema(queries, keys))


def _rows_by_cell(cells: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Which rows ask for a cell, by cell."""
    cells = cells.combine_chunks()
    row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    cell = cells.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    names, first = np.unique(cell[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], first[1:])))


def fit_cells(passages: DataFrame, n_cells: int, seed: int = 42, max_iter: int = 10) -> np.ndarray:
    """Unit centroids of the passage vectors, one per cell."""
    vectors = passages.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(vectors)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def nearest_cells(df: DataFrame, keys: list[str], centres: np.ndarray, n: int) -> DataFrame:
    """One row per (row, cell) for the n cells nearest to each vector."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    schema = T.StructType(
        [df.schema[c] for c in keys] + [df.schema["embedding"], T.StructField("_cell", T.IntegerType())]
    )

    def run(batches):
        ids = np.arange(len(shared.value))
        for batch in batches:
            if len(batch) == 0:
                continue
            rows, _, cells = _top_k(_matrix(batch.column(len(keys))), shared.value, ids, n)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                taken.columns + [pa.array(cells, pa.int32())], names=[f.name for f in schema.fields]
            )

    return spread(df.select(*keys, "embedding").where(F.col("embedding").isNotNull())).mapInArrow(run, schema)


def with_cells(queries: DataFrame, keys: list[str], centres: np.ndarray, n: int, skip: int = 0) -> DataFrame:
    """The queries (keys, embedding, perhaps `_least`) with `_cells`, the n cells nearest to each but for the first `skip` of them."""
    shared = queries.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    n = min(n, len(centres))
    skip = min(skip, n)
    rows = queries.select(*keys, "embedding", *[c for c in ("_least",) if c in queries.columns]).where(F.col("embedding").isNotNull())
    schema = T.StructType(rows.schema.fields + [T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            search = _Search(_matrix(batch.column(len(keys))), n)
            search.meet(shared.value, np.arange(len(shared.value)))
            # Nearest first, and the same order for any n.
            cells = pa.ListArray.from_arrays(
                np.arange(len(batch) + 1, dtype=np.int32) * (n - skip), pa.array(search.ids[:, skip:].ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(batch.columns + [cells], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def probed_top_k(
    queries: DataFrame, passages: DataFrame, centres: np.ndarray, k: int = 100, probes: int = 16,
    keys: list[str] | None = None, query_block: int = QUERY_BLOCK, passage_block: int = PASSAGE_BLOCK,
    found: DataFrame | None = None, probed: int = 0,
) -> DataFrame:
    """Approximate top-k: each query meets the passages of its `probes` nearest cells.

    With as many probes as cells the result is exact. It is written once, like that of `top_k`. `found`, the result of
    the same search with `probed` cells, is carried on: its cells are not visited again.
    """
    keys = keys or ["query_idx", "pert_idx"]
    placed = nearest_cells(passages, ["passage_idx"], centres, 1)

    def search() -> DataFrame:
        asked = settle(with_cells(with_least(queries, found, keys, k), keys, centres, probes, probed if found is not None else 0))
        hits = search_cells(asked, placed, k, keys, query_block, passage_block)
        return best_hits(with_found(hits, found), keys, k)

    return settle_last(queries.sparkSession, search)


def with_least(queries: DataFrame, found: DataFrame | None, keys: list[str], k: int) -> DataFrame:
    """Adds `_least`, the k-th best score found before, null where fewer were found."""
    if found is None:
        return queries
    return queries.join(found.where(F.col("rank") == k - 1).select(*keys, F.col("score").alias("_least")), keys, "left")


def with_found(hits: DataFrame, found: DataFrame | None) -> DataFrame:
    """Hits of further cells together with those that were found in other cells before."""
    return hits if found is None else hits.unionByName(found.select(*hits.columns))


def recall(found: DataFrame, exact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: share of the exact hits that were found."""
    on = (keys or ["query_idx", "pert_idx"]) + ["passage_idx"]
    flagged = exact.select(*on).join(found.select(*on, F.lit(1).alias("_hit")), on, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_exact"),
        F.count("_hit").alias("n_found"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"),
    )


def with_text(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Brings the text to the hits. Hits without a passage drop out; ranks stay."""
    return split_hot_join(hits, passages.select("passage_idx", "text"), ["passage_idx"], "passage_idx")


def nest_hits(hits: DataFrame, keys: list[str] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """One record per query with all its candidates in rank order; `top_k` sets how many there are.

    Hits without a column `text` give candidates without one.
    With `queries`, which has the keys, every query gets a record, an empty list if nothing was found.
    """
    keys = keys or ["query_idx", "pert_idx"]
    entry = F.struct(*[c for c in ("rank", "passage_idx", "text", "score") if c in hits.columns])
    nested = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    if queries is None:
        return nested
    whole = queries.select(*keys).distinct().join(nested, keys, "left")
    none = F.array().cast(nested.schema["candidates"].dataType)
    return whole.withColumn("candidates", F.coalesce("candidates", none))


def pert_ordinals(flat: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Adds `pert_idx`, the place of a rewrite inside its query by slot."""
    return ordinal_in_group(flat, ["query_idx"], [F.col("slot_idx")], "pert_idx", hot)


class _Pairs:
    """Hits and the query vectors of one lot, met by passages that pass by."""

    def __init__(self, asked: pa.Table, hits: pa.Table, on: list[str], own: list[str], carried: list[str]):
        self.on, self.own, self.carried = on, own, carried
        self.asked, self.hits = asked.drop_columns("_q").combine_chunks(), hits.combine_chunks()
        self.vectors, self.whole = _vectors(asked.column("_q"), np.float64)
        group = asked.column("_group").to_numpy()
        self.asked_order = np.argsort(group, kind="stable")
        group, wanted = group[self.asked_order], hits.column("_group").to_numpy()
        self.first = np.searchsorted(group, wanted, side="left")
        self.times = np.searchsorted(group, wanted, side="right") - self.first
        met = hits.column("passage_idx").to_numpy()
        self.hit_order = np.argsort(met, kind="stable")
        self.met = met[self.hit_order]

    def score(self, passages: pa.Table, told: list[str]):
        """Batches of (hit, columns of its query vector, columns of its passage, product)."""
        ids = passages.column("_id").to_numpy()
        vectors, whole = _vectors(passages.column("_p"), None)
        first = np.searchsorted(self.met, ids, side="left")
        times = np.searchsorted(self.met, ids, side="right") - first
        of_passage, hit = np.repeat(np.arange(len(ids)), times), self.hit_order[_runs(first, times)]
        for at in range(0, len(hit), _STREAM_ROWS):
            some = hit[at:at + _STREAM_ROWS]
            times = self.times[some]
            q = self.asked_order[_runs(self.first[some], times)]
            h, p = np.repeat(some, times), np.repeat(of_passage[at:at + _STREAM_ROWS], times)
            # Equal hashes of keys do not make equal keys, and null keys meet nothing.
            same = np.ones(len(h), bool)
            for c in self.on:
                alike = pc.equal(self.hits.column(c).take(pa.array(h)), self.asked.column(c).take(pa.array(q)))
                same &= alike.fill_null(False).to_numpy()
            q, h, p = q[same], h[same], p[same]
            if len(h) == 0:
                continue
            known = self.whole[q] & whole[p]
            dot = np.zeros(len(h))
            if known.any():
                dot[known] = np.einsum("ij,ij->i", self.vectors[q[known]], vectors[p[known]].astype(np.float64))
            columns = [self.hits.column(c).take(pa.array(h)) for c in self.own]
            columns += [self.asked.column(c).take(pa.array(q)) for c in self.carried]
            columns += [passages.column(c).take(pa.array(p)) for c in told]
            names = [*self.own, *self.carried, *told, "_dot"]
            yield from pa.table([*columns, pa.array(dot, mask=~known)], names=names).combine_chunks().to_batches()


def _vectors(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a matrix and which of them are not null. Vectors of different lengths are an error."""
    column = column.combine_chunks()
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    held = column.drop_null()
    if len(np.unique(held.value_lengths().to_numpy())) > 1:
        raise ValueError("vectors of different lengths")
    rows = _stored(held) if dtype is None else _matrix(held, dtype)
    if whole.all():
        return rows, whole
    matrix = np.zeros((len(column), rows.shape[1]), rows.dtype)
    matrix[whole] = rows
    return matrix, whole


def _runs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, as many as `times` says."""
    return np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)


def rescore(
    hits: DataFrame, scoring: DataFrame, passages: DataFrame, keys: list[str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Hits found with one query vector, scored with another (`scoring` holds keys, embedding).

    A hit meets every row of `scoring` with its keys; `carry` names further columns of `scoring` or `passages` that
    come along. Hits and query vectors are dealt out in lots, and a passage goes once to each lot with a hit on it, so
    no vector moves per pair. A vector that is null or has a null in it gives a null score.
    """
    on, own = keys or ["query_idx", "pert_idx"], hits.columns
    asks, told = ([c for c in carry or [] if c in df.columns] for df in (scoring, passages))
    n_hits, n_asked = hits.count(), scoring.count()
    head = scoring.select("embedding").where(F.col("embedding").isNotNull()).first()
    cores = hits.sparkSession.sparkContext.defaultParallelism
    held_bytes = n_asked * (8 * (len(head[0]) if head else 0) + 32) + n_hits * (16 * len(own) + 16)
    lots = max(math.ceil(held_bytes / LOT_BYTES), min(cores, math.ceil(n_hits / _LOT_QUERIES)), 1)
    if lots > cores:
        lots = math.ceil(lots / cores) * cores
    # Keys are compared in the types that a union gives them, as in a join.
    wide = {f.name: f.dataType for f in scoring.select(*on).union(hits.select(*on)).schema}
    group = F.xxhash64(*[F.col(c).cast(wide[c]) for c in on])
    named = hits.where(F.col("passage_idx").isNotNull()).withColumn("_group", group)
    # A key with many hits has several parts, and its vectors go to the lots of all of them.
    hot = hot_keys(named, "_group")
    parts = F.coalesce("_salts", F.lit(1))
    dealt = hot.mark(named, "_group").withColumn("_part", F.pmod(F.xxhash64("passage_idx"), parts).cast("int"))
    asked = hot.mark(scoring.withColumn("_group", group), "_group").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    lot = F.pmod(F.xxhash64("_group", "_part"), F.lit(lots)).cast("int").alias("_lot")
    wanted = dealt.select(lot, F.col("passage_idx").alias("_id")).distinct().groupBy("_id").agg(F.collect_list("_lot").alias("_lots"))
    whole = F.when(F.forall("embedding", lambda x: x.isNotNull()), F.col("embedding"))
    no_q, no_p = (_no_list(df.schema["embedding"].dataType) for df in (scoring, passages))
    rows = [
        asked.select(lot, F.lit(0).alias("_kind"), "_group", "_part", *on, *[F.col(c).alias(f"_asks_{c}") for c in asks], whole.alias("_q"), no_p.alias("_p")),
        dealt.select(lot, F.lit(1).alias("_kind"), "_group", "_part", *own, no_q.alias("_q"), no_p.alias("_p")),
        passages.select(F.col("passage_idx").alias("_id"), *[F.col(c).alias(f"_told_{c}") for c in told], whole.alias("_p"))
        .join(wanted, "_id").withColumns({"_lot": F.explode("_lots"), "_kind": F.lit(2), "_q": no_q}).drop("_lots"),
    ]
    sent = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    sent = sent.repartitionById(lots, F.col("_lot")).sortWithinPartitions("_kind").drop("_lot")
    asks, told = [f"_asks_{c}" for c in asks], [f"_told_{c}" for c in told]

    def run(batches):
        asked, held, pairs = [], [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            a, b = np.searchsorted(table.column("_kind").to_numpy(), [1, 2]).tolist()
            if a:
                asked.append(table.slice(0, a).select(["_group", "_part", *on, *asks, "_q"]))
            if b > a:
                held.append(table.slice(a, b - a).select(["_group", "_part", *own]))
            if b == len(batch) or not (asked and held or pairs):
                continue
            if pairs is None:
                pairs = _Pairs(pa.concat_tables(asked), pa.concat_tables(held), ["_part", *on], own, asks)
                asked, held = [], []
            yield from pairs.score(table.slice(b), told)

    shape = T.StructType([sent.schema[c] for c in [*own, *asks, *told]] + [T.StructField("_dot", T.DoubleType())])
    return sent.mapInArrow(run, shape).select(
        *[F.col(c).cast(hits.schema[c].dataType) for c in own], *[F.col(c).alias(c[6:]) for c in [*asks, *told]],
        F.round("_dot", SCORE_PLACES).alias("scoring_score"),
    )
