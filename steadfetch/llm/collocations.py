"""Collocations: frequency-ranked ids count in direct-address tiles, frequent pairs are ranked again.

Texts become slices of word codes once. What two neighbours are called, words or frequent pairs, is a
number by frequency; a pair of numbers is a cell of a tile. Slices count their own pairs first, then
groups of slices, until one row is left per tile, so that neither a frequent pair nor a full tile
gathers the rows of all slices in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal
from ..session import settle
from .frames import pack, tidied

# Side of a tile: a dense tile of counts takes 32 MB.
TILE = 2048
# Slices are cut at about this many bytes of text of one language.
SLICE_BYTES = 1 << 22
# Partial counts of a tile that one task adds up in a round.
FAN_IN = 512
# Cells that wait to be added, and the share of a tile from which they are added densely.
WAITING, DENSE = 1 << 20, 1 / 16

_NO = -1
# Capital ASCII letters become small; what ends a piece becomes a line end, a tab a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_CODEC = "zstd"


def _squeezed(values: np.ndarray) -> bytes:
    """A count of bytes and the compressed numbers."""
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec(_CODEC).compress(data, asbytes=True)


def _opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec(_CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and the piece each lies in; null texts have none."""
    data = b"\n".join(pc.drop_null(texts).cast(pa.binary()).to_pylist()).translate(_TABLE)
    lines = pc.split_pattern(pa.array([data], pa.large_binary()).cast(pa.large_string()), "\n").flatten()
    lines = pc.ascii_trim(lines, " ")
    lines = lines.filter(pc.greater(pc.binary_length(lines), 0))
    split = pc.ascii_split_whitespace(lines)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return split.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to slices: the different words by falling count, their counts, and codes with -1 between pieces."""
    number = TaskContext.get().partitionId() << 33
    for batch in tidied(batches):
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, code))
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(texts):
                base = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
                words, piece = pieces_of(texts[begin:end])
                begin = end
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                counts = np.bincount(at, minlength=len(coded.dictionary))
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                codes = np.full(len(at) + int(piece[-1]) + 1, _NO, np.int32)
                codes[np.arange(len(at)) + piece] = rank[at]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([lang], pa.string()), one(coded.dictionary.take(pa.array(order)).cast(pa.string())),
                    one(pa.array(counts[order])), pa.array([_squeezed(codes)], pa.binary()),
                ], names=["slice", "lang", "words", "counts", "codes"])
                number += 1


def _runs(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    first = np.ones(len(sorted_keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(first)


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """One binary value per run of `values`."""
    bounds = np.append(begins, len(values)) * values.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def _tiles(slice_: int, one: np.ndarray, other: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counted pairs of numbers as one row per tile."""
    ti, tj = one // TILE, other // TILE
    cell = (one % TILE) * TILE + other % TILE
    order = np.lexsort((cell, tj, ti))
    ti, tj, cell, counts = ti[order], tj[order], cell[order].astype(np.int32), counts[order].astype(np.int64)
    begins = _runs([ti, tj])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(begins), slice_)), pa.array(ti[begins]), pa.array(tj[begins]), _binary(cell, begins), _binary(counts, begins)],
        names=["slice", "ti", "tj", "cells", "counts"],
    )


_TILE_ROW = "slice bigint, ti bigint, tj bigint, cells binary, counts binary"


class _Slice:
    """A slice's codes and the numbers of its words."""

    def __init__(self, codes: bytes, at: pa.Array, ids: pa.Array):
        self.codes = _opened(codes, np.int32).astype(np.int64)
        most = int(self.codes.max(initial=0)) + 1
        self.numbers = np.full(most + 1, _NO)  # the last one is for what stands between pieces
        self.numbers[at] = ids
        self.words = self.numbers[self.codes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of neighbours with a number each, and how often they occur."""
        both = np.flatnonzero((self.words[:-1] >= 0) & (self.words[1:] >= 0))
        width = len(self.numbers)
        key = np.sort(self.codes[both] * width + self.codes[both + 1])
        begins = _runs([key])
        counts = np.diff(np.append(begins, len(key)))
        return self.numbers[key[begins] // width], self.numbers[key[begins] % width], counts


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of sorted batches with equal keys; a key's stretches follow each other."""
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        begins = _runs(columns)
        for a, b in zip(begins, np.append(begins[1:], batch.num_rows)):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices to tiles of their pairs of words."""
    for batch in tidied(batches):
        for k in range(batch.num_rows):
            own = _Slice(batch["codes"][k].as_py(), batch["at"][k].values.to_numpy(), batch["ids"][k].values.to_numpy())
            yield _tiles(batch["slice"][k].as_py(), *own.pairs())


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


class _Sum:
    """Counts of one tile: cells wait in lists, and are added densely or as sorted coordinates."""

    def __init__(self):
        self.waiting, self.size = [], 0

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((cells, counts))
        self.size += len(cells)
        if self.size > WAITING:
            self.waiting = [self.total()]
            # What has been added once takes no more than a tile.
            self.size = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        cells, counts = (np.concatenate([w[k] for w in self.waiting]) for k in (0, 1))
        if len(cells) >= TILE * TILE * DENSE:
            # Sums of whole numbers below 2^53 are exact.
            dense = np.bincount(cells, weights=counts, minlength=TILE * TILE)
            cells = np.flatnonzero(dense).astype(np.int32)
            return cells, dense[cells].astype(np.int64)
        order = np.argsort(cells, kind="stable")
        begins = _runs([cells[order]])
        return cells[order][begins], np.add.reduceat(counts[order], begins) if len(begins) else counts


def _added(least: int | None):
    """Tile rows sorted by (ti, tj, part) to one row each, or to (one, other, a) of the pairs that occur `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, _Sum()

        def row() -> pa.RecordBatch:
            cells, counts = total.total()
            ti, tj, part = now
            if least is None:
                return pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([ti]), pa.array([tj]), pa.array([cells.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                    names=["slice", "ti", "tj", "cells", "counts"],
                )
            often = counts >= least
            cells, counts = cells[often].astype(np.int64), counts[often]
            return pa.RecordBatch.from_arrays(
                [pa.array(ti * TILE + cells // TILE), pa.array(tj * TILE + cells % TILE), pa.array(counts)], names=["one", "other", "a"]
            )

        for key, stretch in _grouped(tidied(batches), ("ti", "tj", "part")):
            if key != now:
                if now is not None:
                    yield row()
                now, total = key, _Sum()
            total.add(_bytes(stretch["cells"], np.int32), _bytes(stretch["counts"], np.int64))
        if now is not None:
            yield row()

    return run


def _counted(tiles: DataFrame, slices: int, least: int) -> DataFrame:
    """(one, other, a) of all pairs that occur `least` times: rounds add up FAN_IN rows of a tile each."""
    groups, part = slices, F.col("part")
    while True:
        groups = -(-groups // FAN_IN)
        # Slices are numbered from 0 by `part`, then groups of them.
        dealt = tiles.withColumn("part", F.floor(part / FAN_IN).cast("bigint"))
        dealt = dealt.repartition("ti", "tj", "part").sortWithinPartitions("ti", "tj", "part")
        dealt = dealt.select("ti", "tj", "part", "cells", "counts")
        if groups <= 1:
            return settle(dealt.mapInArrow(_added(least), "one bigint, other bigint, a bigint"))
        tiles = settle(dealt.mapInArrow(_added(None), _TILE_ROW)).withColumnRenamed("slice", "part")
        part = F.col("part")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile rows sorted by (ti, tj, part, kind): first a tile's frequent cells with their numbers, then slices' cells.

    Slices get back the cells that are frequent, with their numbers.
    """
    now, names = None, None
    for key, stretch in _grouped(tidied(batches), ("ti", "tj", "part", "kind")):
        if key[:3] != now:
            now, names = key[:3], None
        if key[3] == 0:
            cells, values = _bytes(stretch["cells"], np.int32), _bytes(stretch["counts"], np.int64)
            names = np.full(TILE * TILE, _NO) if names is None else names
            names[cells] = values
        elif names is not None:
            cells = _bytes(stretch["cells"], np.int32)
            lengths = pc.binary_length(stretch["cells"]).to_numpy(zero_copy_only=False) // 4
            row = np.repeat(np.arange(len(lengths)), lengths)
            values = names[cells]
            keep = values >= 0
            kept = np.bincount(row[keep], minlength=len(lengths))
            some = np.flatnonzero(kept)
            begins = (np.cumsum(kept) - kept)[some]
            yield pa.RecordBatch.from_arrays([
                stretch["slice"].take(pa.array(some)), stretch["ti"].take(pa.array(some)), stretch["tj"].take(pa.array(some)),
                _binary(cells[keep], begins), _binary(values[keep], begins),
            ], names=["slice", "ti", "tj", "cells", "counts"])


def _tripled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slice, kind), a slice's codes and then its frequent pairs, to tiles of (pair, next word)."""
    now, own, pairs = None, None, []

    def tiles() -> pa.RecordBatch:
        one, other, value = (np.concatenate([p[k] for p in pairs]) for k in range(3))
        # Numbers of words back to the slice's codes.
        order = np.argsort(own.numbers, kind="stable")
        local = lambda ids: order[np.searchsorted(own.numbers[order], ids)]
        width = len(own.numbers)
        key = local(one) * width + local(other)
        by = np.argsort(key)
        key, value = key[by], value[by]
        here = np.flatnonzero((own.words[:-1] >= 0) & (own.words[1:] >= 0))
        found = own.codes[here] * width + own.codes[here + 1]
        at = np.minimum(np.searchsorted(key, found), len(key) - 1)
        number = np.full(len(own.codes), _NO)
        hit = key[at] == found
        number[here[hit]] = at[hit]
        # A run of three is frequent only if both its pairs are.
        start = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        triple = np.sort(number[start] * width + own.codes[start + 2])
        begins = _runs([triple])
        counts = np.diff(np.append(begins, len(triple)))
        return _tiles(now, value[triple[begins] // width], own.numbers[triple[begins] % width], counts)

    for (slice_, kind), stretch in _grouped(tidied(batches), ("slice", "kind")):
        if slice_ != now:
            if own is not None and pairs:
                yield tiles()
            now, own, pairs = slice_, None, []
        if kind == 0:
            own = _Slice(stretch["codes"][0].as_py(), stretch["at"][0].values.to_numpy(), stretch["ids"][0].values.to_numpy())
            continue
        lengths = pc.binary_length(stretch["cells"]).to_numpy(zero_copy_only=False) // 4
        cells = _bytes(stretch["cells"], np.int32).astype(np.int64)
        ti, tj = (np.repeat(stretch[c].to_numpy(), lengths) for c in ("ti", "tj"))
        pairs.append((ti * TILE + cells // TILE, tj * TILE + cells % TILE, _bytes(stretch["counts"], np.int64)))
    if own is not None and pairs:
        yield tiles()


def _slices(docs: DataFrame, text: str, lang: str) -> DataFrame:
    packed = pack(docs, lang=lang, text=text)
    rows = packed.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "slice bigint, lang string, words array<string>, counts array<bigint>, codes binary"
    return settle(rows.mapInArrow(_sliced, schema))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, words, pairs, triples): what occurs at least `least` times, with exact counts.

    `totals` has lang and n (all words), `words` lang, word, f and its number `id`, `pairs` lang, the numbers and
    words of both, f1, f2, a and its number `pair_id`, `triples` the first pair's pair_id, the last word's id and a.
    """
    slices = _slices(docs, text, lang)
    listed = slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    sums = settle(listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")))
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    words = settle(dense_ordinal(sums.where(F.col("f") >= least), [F.col("lang"), F.col("f").desc(), F.col("word")], "id"))
    # Each slice learns the numbers of its own words; no task holds the whole vocabulary.
    entries = slices.select("slice", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
    known = entries.groupBy("slice").agg(F.collect_list(F.struct("at", "id")).alias("k"))
    known = known.select("slice", F.col("k.at").alias("at"), F.col("k.id").alias("ids"))
    coded = slices.select("slice", "codes").join(known, "slice")
    # Slices in a row of numbers without gaps, so that groups of them are of a known size.
    numbered = settle(dense_ordinal(coded, [F.col("slice")], "part").drop("slice").withColumnRenamed("part", "slice"))
    count = numbered.count()
    tiles = settle(numbered.mapInArrow(_paired, _TILE_ROW)).withColumn("part", F.col("slice"))
    found = _counted(tiles, count, least)
    ids = words.select("lang", "word", "f", "id")
    first = found.join(ids.toDF("lang", "w1", "f1", "one"), "one")
    both = first.join(ids.drop("lang").toDF("w2", "f2", "other"), "other")
    pairs = settle(dense_ordinal(both, [F.col("lang"), F.col("a").desc(), F.col("one"), F.col("other")], "pair_id"))
    return totals, words, pairs, _triples(numbered, tiles, pairs, count, least)


def _triples(numbered: DataFrame, tiles: DataFrame, pairs: DataFrame, slices: int, least: int) -> DataFrame:
    cell = (F.col("one") % TILE * TILE + F.col("other") % TILE).cast("int")
    placed = pairs.select(F.floor(F.col("one") / TILE).alias("ti"), F.floor(F.col("other") / TILE).alias("tj"), cell.alias("cell"), "pair_id")
    # A tile has a million cells at most; its frequent ones are told to every group of slices.
    groups = F.sequence(F.lit(0), F.lit(max(0, -(-slices // FAN_IN) - 1)))
    frequent = placed.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(_cells_by_tile, _TILE_ROW)
    frequent = frequent.withColumns({"kind": F.lit(0), "slice": F.lit(0).cast("bigint")}).withColumn("part", F.explode(groups)).withColumn("part", F.col("part").cast("bigint"))
    own = tiles.withColumns({"kind": F.lit(1), "part": F.floor(F.col("slice") / FAN_IN).cast("bigint")})
    order = ["ti", "tj", "part"]
    both = frequent.unionByName(own).repartition(*order).sortWithinPartitions(*order, "kind")
    named = both.select(*order, "kind", "slice", "cells", "counts").mapInArrow(_named, _TILE_ROW)
    empty = {c: F.lit(None).cast(t) for c, t in (("codes", "binary"), ("at", "array<int>"), ("ids", "array<bigint>"))}
    blank = {c: F.lit(None).cast(t) for c, t in (("ti", "bigint"), ("tj", "bigint"), ("cells", "binary"), ("counts", "binary"))}
    rows = named.withColumns({**empty, "kind": F.lit(1)}).unionByName(numbered.withColumns({**blank, "kind": F.lit(0)}))
    rows = rows.repartition("slice").sortWithinPartitions("slice", "kind")
    tripled = settle(rows.mapInArrow(_tripled, _TILE_ROW)).withColumn("part", F.col("slice"))
    return _counted(tripled, slices, least).withColumnsRenamed({"one": "pair_id", "other": "id"})


def _cells_by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ti, tj, cell, pair_id) sorted by tile to rows of a tile's cells and their numbers."""
    for key, stretch in _grouped(batches, ("ti", "tj")):
        yield pa.RecordBatch.from_arrays([
            pa.array([0]), pa.array([key[0]]), pa.array([key[1]]), pa.array([stretch["cell"].to_numpy().tobytes()], pa.binary()),
            pa.array([stretch["pair_id"].to_numpy().tobytes()], pa.binary()),
        ], names=["slice", "ti", "tj", "cells", "counts"])


def score(a: str, l: str, r: str):  # noqa: E741
    """floor(10^6 a^2 / (l r)) of three counts, exact: products have 38 digits."""
    wide = lambda c: f"CAST({c} AS decimal(19,0))"
    # A square of 14 digits at most, a million times it, and a product fit 38 digits each.
    return F.expr(f"CAST({wide(a)} * {wide(a)} AS decimal(31,0)) * CAST(1000000 AS decimal(7,0)) DIV ({wide(l)} * {wide(r)})")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2000
) -> DataFrame:
    """Each language's `top` collocations of 2 and 3 words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends, and split at spaces and tabs; a phrase lies within a
    piece. Counts are per language (null: `und`) and exact: n of all words, a of the phrase, overlaps included. A
    phrase with a >= `least` is cut in two where floor(10^6 a^2 / (l r)), l and r the counts of its parts, is least
    (ties: the first such cut). Pairs lying in a triple with 100 f(triple) >= `covered` x a are dropped. Order: score
    and a falling, then phrase by its bytes. Null and empty texts have no words; repeated rows count
    again; other columns play no part. No words, no rows.
    """
    totals, words, pairs, triples = phrases(docs, text, lang, least)
    named = triples.join(pairs.select("pair_id", "lang", "one", F.col("other").alias("mid"), "w1", "w2", F.col("f1"), F.col("a").alias("a1")), "pair_id")
    second = pairs.select(F.col("one").alias("mid"), F.col("other").alias("id"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("a2"), F.col("pair_id").alias("second"))
    three = settle(named.join(second, ["mid", "id"]))
    # What covers a pair: each of the two pairs of a triple, by number.
    covers = three.select("pair_id", "a").unionByName(three.select(F.col("second").alias("pair_id"), "a"))
    most = covers.groupBy("pair_id").agg(F.max("a").alias("longest"))
    kept = pairs.join(most, "pair_id", "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered))
    two = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    cuts = three.select("*", score("a", "f1", "a2").alias("s1"), score("a", "a1", "f3").alias("s2"))
    early = F.col("s1") <= F.col("s2")
    long = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("a1")).alias("l"),
        F.when(early, F.col("a2")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = two.unionByName(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
