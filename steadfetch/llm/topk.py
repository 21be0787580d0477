"""Exact top-k inner products by a dual-tree search over cover trees.

The upper tree is a cover tree over a bounded sample, shared by queries and data; every row goes to
its nearest leaf, and covering radii and norms come from all rows. Rows of a leaf form blocks of
bounded size, each with a small tree of its own. Pairs of (query group, data group) are followed from
the root down; a pair is dropped when no inner product in it can beat the worst k-th score of the
query group. What is left meets block by block, where the two small trees are searched the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal
from ..session import settle
from .frames import pack

BLOCK = 2048
# Rows that the upper tree is fitted on, its most leaves, and query blocks that meet a data block at once.
SAMPLE, LEAVES, TOGETHER = 4096, 256, 32
LEAF_ROWS = 64
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components times `scale`, rounded down; null for a vector that takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & F.coalesce(usable, F.lit(False)), whole)


class Node:
    """A group of rows around one of them: covering radius, largest norm, smallest (id, row)."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, centre: int):
        self.rows, self.centre = rows, points[centre]
        own = points[rows]
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.norm = float(np.sqrt((own**2).sum(axis=1).max()))
        self.least_id = ids[rows].min()
        self.children: list[Node] = []


def spread(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first centres (row numbers) and each row's nearest one: nested nets of all scales."""
    centres = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    nearest = np.zeros(len(points), np.int64)
    while len(centres) < most and away.max() > 0:
        far = int(away.argmax())
        centres.append(far)
        new = ((points - points[far]) ** 2).sum(axis=1)
        nearest[new < away] = len(centres) - 1
        away = np.minimum(away, new)
    return np.array(centres), nearest


def grow(points: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree of one block: each node's rows go to its farthest-first children."""
    rows = np.arange(len(points)) if rows is None else rows
    node = Node(points, rows, ids, int(rows[0]) if centre is None else centre)
    if len(rows) > LEAF_ROWS and node.radius > 0:
        centres, nearest = spread(points[rows], 8)
        for k, c in enumerate(centres):
            node.children.append(grow(points, ids, rows[nearest == k], int(rows[c])))
    return node


def highest(centre_q, radius_q, norm_q, centre_d, radius_d, norm_d):
    """The largest possible inner product between two groups, rounded down; works on arrays too."""
    product = (centre_q * centre_d).sum(axis=-1)
    size_q, size_d = np.sqrt((centre_q**2).sum(axis=-1)), np.sqrt((centre_d**2).sum(axis=-1))
    by_radius = product + radius_q * size_d + radius_d * size_q + radius_q * radius_d
    gap = np.maximum(np.sqrt(((centre_q - centre_d) ** 2).sum(axis=-1)) - radius_q - radius_d, 0)
    by_gap = (norm_q**2 + norm_d**2 - gap**2) / 2
    best = np.minimum(np.minimum(by_radius, by_gap), norm_q * norm_d)
    return np.floor(best + 1e-6 + 1e-9 * np.abs(best))


class Hits:
    """The k best (score, id, row) of each query so far; starts with a lower bound of the k-th."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), LOWEST, np.int64)
        self.id = np.full((queries, k), NO_ID, np.int64)
        self.row = np.full((queries, k), -1, np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[at], scores], axis=1)
        id_ = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], axis=1)
        row = np.concatenate([self.row[at], np.broadcast_to(rows, scores.shape)], axis=1)
        order = np.lexsort((row, id_, -np.maximum(score, LOWEST + 1)), axis=1)[:, :k]
        for mine, all_ in ((self.score, score), (self.id, id_), (self.row, row)):
            mine[at] = np.take_along_axis(all_, order, axis=1)

    def worst(self, at: np.ndarray) -> tuple[int, int]:
        """The lowest k-th score of a group of queries, and the largest id that holds such a place."""
        last = self.score[at, -1]
        low = last.min()
        return int(low), int(self.id[at, -1][last == low].max())


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def search(qtree: Node, q: dict, dtree: Node, d: dict, hits: Hits) -> None:
    """Follows the pairs of two trees, best bound first; skips what cannot enter any query's best k."""
    todo = [(qtree, dtree)]
    while todo:
        a, b = todo.pop()
        bound = highest(a.centre, a.radius, a.norm, b.centre, b.radius, b.norm)
        low, low_id = hits.worst(a.rows)
        if bound < low or (bound == low and b.least_id > low_id):
            continue
        if not a.children and not b.children:
            scores = products(q["points"][a.rows], d["points"][b.rows])
            own = q["rows"][a.rows][:, None] == d["rows"][b.rows][None, :]
            hits.offer(a.rows, np.where(own, LOWEST, scores), d["ids"][b.rows], d["rows"][b.rows])
        elif b.children and (not a.children or b.radius >= a.radius):
            near = sorted(b.children, key=lambda c: -float((a.centre * c.centre).sum()))
            todo.extend((a, c) for c in reversed(near))
        else:
            todo.extend((c, b) for c in a.children)


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled up with zeros."""
    lengths = np.array([len(v) for v in column])
    out = np.zeros((len(column), max(lengths.max(initial=0), 1)), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    return out


def _wide(points: np.ndarray, width: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, width - points.shape[1]))) if points.shape[1] < width else points[:, :width]


_BLOCK = "block bigint, leaf int, ids binary, rows binary, points binary, width int, centre binary, radius double, norm double, least_id bigint"


def _to_block(table: pa.Table) -> pa.Table:
    """One row that holds a block's rows in the order of their ids, and what covers them."""
    table = table.combine_chunks().sort_by([("row", "ascending")])
    points = _matrix(table["vector"].combine_chunks())
    ids = np.array([NO_ID if x is None else x for x in table["id"].to_pylist()], np.int64)
    node = Node(points.astype(np.float64), np.arange(len(points)), ids, 0)
    values = {
        "block": table["block"][0].as_py(), "leaf": table["leaf"][0].as_py(), "ids": ids.tobytes(),
        "rows": table["row"].to_numpy().astype(np.int64).tobytes(), "points": points.tobytes(), "width": points.shape[1],
        "centre": node.centre.tobytes(), "radius": node.radius, "norm": node.norm, "least_id": int(node.least_id),
    }
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
    return pa.table({n: pa.array([v], t) for (n, v), t in zip(values.items(), kinds)})


def _from_block(row: dict, width: int) -> dict:
    points = np.frombuffer(row["points"], np.int64).reshape(-1, row["width"])
    return {"ids": np.frombuffer(row["ids"], np.int64), "rows": np.frombuffer(row["rows"], np.int64), "points": _wide(points, width)}


_HIT = "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint"


def _meet(k: int):
    """One data block with some query blocks: each query's best k there, if they may be among its best."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for data in left.to_pylist():
            rows = right.to_pylist()
            width = max([data["width"], *[r["width"] for r in rows]])
            d = _from_block(data, width)
            dtree = grow(d["points"].astype(np.float64), d["ids"])
            for row in rows:
                q = _from_block(row, width)
                hits = Hits(len(q["ids"]), k)
                known = row.get("bounds")
                if known is not None:
                    # Places that only something better may take: the k-th so far, in every place.
                    bound = np.frombuffer(known, np.int64).reshape(-1, 2)
                    hits.score[:] = bound[:, :1]
                    hits.id[:] = bound[:, 1:]
                search(grow(q["points"].astype(np.float64), q["ids"]), q, dtree, d, hits)
                at, place = np.nonzero((hits.row >= 0) & (hits.score > LOWEST))
                for values, found in zip(out, (q["rows"][at], q["ids"][at], hits.id[at, place], hits.row[at, place], hits.score[at, place])):
                    values.append(found)
        columns = [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out]
        columns[2] = pa.array(columns[2].to_numpy(), pa.int64(), mask=columns[2].to_numpy() == NO_ID)
        return pa.table(columns, names=["query_row", "query_id", "vec_id", "vec_row", "score"])

    return run


def _leaf_of(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _wide(_matrix(batch.column(1)), centres.shape[1]).astype(np.float64)
            nearest = (squares - 2 * points @ centres.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32())], names=["id", "vector", "asks", "leaf"]
            )

    return run


def _pairs(leaves: list[dict], centres: np.ndarray, worst: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs (query leaf, data leaf) that the upper tree cannot rule out, from the root down."""
    order = np.arange(len(centres))
    info = {r["leaf"]: r for r in leaves}

    class Top:
        def __init__(self, members: np.ndarray):
            self.members = [int(m) for m in members if int(m) in info]
            self.centre = centres[members[0]]
            away = lambda m: float(np.sqrt(((centres[m] - self.centre) ** 2).sum()))
            asked = [m for m in self.members if m in worst]
            self.reach = max([away(m) + info[m]["radius"] for m in self.members], default=0.0)
            self.norm = max([info[m]["norm"] for m in self.members], default=0.0)
            self.low = min([worst[m][0] for m in asked], default=None)
            self.children = []
            if len(members) > 1:
                first, nearest = spread(centres[members], 4)
                if len(first) > 1:
                    self.children = [Top(members[nearest == k][np.argsort(members[nearest == k] != members[c])]) for k, c in enumerate(first)]

    found, todo = [], [(root := Top(order), root)]
    while todo:
        a, b = todo.pop()
        if a.low is None or not b.members or highest(a.centre, a.reach, a.norm, b.centre, b.reach, b.norm) < a.low:
            continue
        if not a.children and not b.children:
            found += [(x, y) for x in a.members if x in worst for y in b.members]
        elif b.children and (not a.children or b.reach >= a.reach):
            todo.extend((a, c) for c in b.children)
        else:
            todo.extend((c, b) for c in a.children)
    return found


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asks`, its k highest integer inner products.

    Components become floor(scale x component). Every row but the query's own is a candidate; ties go
    to the smaller id (a null id is the largest). All candidates are returned if there are fewer than
    k. A vector that is null or has a null or non-finite component takes no part; shorter vectors
    count as filled up with zeros, an empty one as all zeros. Rows that share an id are different rows.

    The upper tree is fitted on `SAMPLE` rows and has `LEAVES` leaves at most; all rows are indexed and
    the result is exact whatever the sample. Blocks hold `BLOCK` rows at most, in the order of ids, so
    copies of a vector, however many, are ruled out by their larger ids once k are known.
    """
    spark = vectors.sparkSession
    rows = pack(vectors.withColumn("_asks", asks), id=id_column, vector=vector, asks="_asks")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), quantised(F.col("vector"), scale).alias("vector"),
                       F.coalesce("asks", F.lit(False)).alias("asks")).where("vector IS NOT NULL")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    if not len(sample):
        return empty
    points = _matrix(sample).astype(np.float64)
    count = rows.count()
    centres = points[spread(points, int(np.clip(count // BLOCK, 1, LEAVES)))[0]]
    placed = rows.mapInArrow(_leaf_of(centres), "id bigint, vector array<bigint>, asks boolean, leaf int")
    placed = placed.withColumn("_any", F.monotonically_increasing_id())
    numbered = dense_ordinal(placed, [F.col("leaf"), F.col("id").isNull(), F.col("id"), F.xxhash64("vector"), F.col("_any")], "row")
    # A block is a leaf's share of BLOCK consecutive rows: a number that no other leaf has.
    numbered = numbered.withColumn("block", F.floor(F.col("row") / BLOCK) * (LEAVES + 1) + F.col("leaf"))
    numbered = numbered.select("block", "leaf", "id", "row", "vector", "asks")
    blocks = settle(numbered.drop("asks").groupBy("block").applyInArrow(_to_block, _BLOCK))
    asked = settle(numbered.where("asks").drop("asks").groupBy("block").applyInArrow(_to_block, _BLOCK))

    # Each query block first meets a block of its own leaf: the k-th scores found bound all others.
    own = blocks.groupBy("leaf").agg(F.min("block").alias("first"))
    at_home = asked.join(own, "leaf").withColumn("home", F.col("first")).drop("first")
    homes = blocks.join(own.select(F.col("first").alias("block")), "block", "left_semi").withColumn("home", F.col("block"))
    first = settle(homes.groupBy("home").cogroup(at_home.groupBy("home")).applyInArrow(_meet(k), _HIT))
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    kth = first.withColumn("n", F.row_number().over(place)).where(F.col("n") == k)
    kth = kth.select("query_row", F.col("score").alias("low"), F.coalesce("vec_id", F.lit(int(NO_ID))).alias("low_id"))
    bounded = _with_bounds(asked, numbered.where("asks").select("block", F.col("row").alias("query_row")), kth)

    # Leaves are few, so their pairs are followed on the driver; blocks meet by joins.
    info = blocks.groupBy("leaf").agg(F.max("norm").alias("norm")).join(_reach(numbered, centres), "leaf").collect()
    low = bounded.groupBy("leaf").agg(F.min("low").alias("low")).collect()
    kept = _pairs([r.asDict() for r in info], centres, {r["leaf"]: (r["low"], 0) for r in low})
    if not kept:
        return empty
    leaf_pairs = spark.createDataFrame(kept, "leaf int, data_leaf int")
    shape = ["block", "leaf", "centre", "radius", "norm"]
    small_q = bounded.select(*shape, "low", "low_id").withColumnsRenamed({c: f"q_{c}" for c in shape})
    small_d = blocks.select(*shape, "least_id").withColumnsRenamed({c: f"d_{c}" for c in shape})
    met = small_q.join(F.broadcast(leaf_pairs.withColumnRenamed("leaf", "q_leaf")), "q_leaf").join(
        small_d, F.col("data_leaf") == F.col("d_leaf")
    )
    pairs = settle(met.mapInArrow(_promising, "q_block bigint, d_block bigint"))
    # A data block meets query blocks in bounded portions.
    portion = F.floor((F.row_number().over(Window.partitionBy("d_block").orderBy("q_block")) - 1) / TOGETHER)
    pairs = settle(pairs.withColumn("portion", portion))
    met_data = pairs.select(F.col("d_block").alias("block"), F.col("d_block").alias("data_at"), F.col("portion").alias("data_portion"))
    met_asked = pairs.select(F.col("q_block").alias("block"), F.col("d_block").alias("asked_at"), F.col("portion").alias("asked_portion"))
    data, asking = blocks.join(met_data.distinct(), "block"), bounded.join(met_asked, "block")
    hits = (
        data.groupBy("data_at", "data_portion").cogroup(asking.groupBy("asked_at", "asked_portion")).applyInArrow(_meet(k), _HIT)
    )
    # The bounds leave out what was found at home.
    every = hits.unionByName(first).dropDuplicates(["query_row", "vec_row"])
    ranked = every.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vec_row"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_bounds(asked: DataFrame, members: DataFrame, kth: DataFrame) -> DataFrame:
    """Query blocks with each query's k-th (score, id) so far, and the lowest of them."""
    values = members.join(kth, "query_row", "left").select(
        "block", "query_row", F.coalesce("low", F.lit(int(LOWEST))).alias("low"), F.coalesce("low_id", F.lit(int(NO_ID))).alias("low_id")
    )

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query_row", "ascending")])
        low, low_id = table["low"].to_numpy(), table["low_id"].to_numpy()
        return pa.table({
            "block": table["block"].slice(0, 1), "bounds": pa.array([np.stack([low, low_id], axis=1).tobytes()], pa.binary()),
            "low": pa.array([low.min()], pa.int64()), "low_id": pa.array([low_id[low == low.min()].max()], pa.int64()),
        })

    bounds = values.groupBy("block").applyInArrow(gather, "block bigint, bounds binary, low bigint, low_id bigint")
    return settle(asked.join(bounds, "block"))


def _reach(numbered: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each leaf's covering radius around its centre, over all its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy()
            matrix = _matrix(batch.column(1)).astype(np.float64)
            width = max(matrix.shape[1], centres.shape[1])
            away = np.sqrt(((_wide(matrix, width) - _wide(centres, width)[leaf]) ** 2).sum(axis=1))
            far = np.zeros(len(centres))
            np.maximum.at(far, leaf, away)
            seen = np.unique(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(far[seen])], names=["leaf", "radius"])

    far = numbered.select("leaf", "vector").mapInArrow(run, "leaf int, radius double")
    return far.groupBy("leaf").agg(F.max("radius").alias("radius"))


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that may hold something better than the query block's lowest k-th score."""
    for batch in batches:
        kept = []
        for r in batch.to_pylist():
            q, d = np.frombuffer(r["q_centre"]), np.frombuffer(r["d_centre"])
            width = max(len(q), len(d))
            q, d = np.pad(q, (0, width - len(q))), np.pad(d, (0, width - len(d)))
            bound = highest(q, r["q_radius"], r["q_norm"], d, r["d_radius"], r["d_norm"])
            kept.append(not (bound < r["low"] or (bound == r["low"] and r["least_id"] > r["low_id"])))
        yield batch.select(["q_block", "d_block"]).filter(pa.array(kept, pa.bool_()))
