"""Shortest-pack-first histogram packing of documents into sequences of equal length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal
from ..session import settle
from .frames import pack, tidied, unpack
from .tokens import encoder, slices

LENGTH = 4096
END_ID = 2


def tokenise(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens and ids.

    A document's ids are those of its text by the tokenizer file at `path`, then `end_id`; they are cut
    after every `length` ids. `ids` holds a piece's ids as unsigned little-endian 32-bit numbers.
    A null or empty text has the end id alone. The file is read by every worker, so `path` must exist
    on all machines.
    """
    packed = pack(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    kind = packed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                ids, bounds = encoder(path).batch(part.column(1))
                yield _cut(part.column(0), ids, bounds, length, end_id)

    return packed.mapInArrow(pieces, schema)


def _cut(docs: pa.Array, ids: np.ndarray, bounds: np.ndarray, length: int, end_id: int) -> pa.RecordBatch:
    """The pieces of documents whose ids lie one after the other; each gets the end id first."""
    whole = np.insert(ids.astype("<u4"), bounds[1:], end_id)
    tokens = np.diff(bounds) + 1
    pieces = -(-tokens // length)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    held = np.minimum(length, tokens[doc] - start)
    # The pieces lie one after the other as well.
    ends = np.concatenate([[0], np.cumsum(held) * 4]).astype(np.int64)
    data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(whole)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [docs.take(pa.array(doc)), pa.array(start), pa.array(held), pa.array(tokens[doc]), data],
        names=["doc_id", "start", "length", "doc_tokens", "ids"],
    )


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs lengths of known counts: (number of sequences, [(piece length, pieces of it), ...]) each.

    Lengths are placed from the longest to the shortest, always into the pack that is emptiest so
    far. Equal packs are held as one pattern with a count, so the work depends on the histogram and
    not on the number of pieces: each length splits one pattern at most and opens two at most.
    """
    packs: list[tuple[int, int, int, tuple]] = []  # (filled, order, count, content): emptiest first
    done: list[tuple[int, list]] = []
    order = 0

    def put(filled: int, count: int, content: tuple) -> None:
        nonlocal order
        if count:
            order += 1
            heapq.heappush(packs, (filled, order, count, content))

    for piece in sorted(histogram, reverse=True):
        left = histogram[piece]
        while left and packs and packs[0][0] + piece <= length:
            filled, _, count, content = heapq.heappop(packs)
            used = min(count, left)
            last, times = content[-1]
            grown = content[:-1] + ((last, times + 1),) if last == piece else content + ((piece, 1),)
            put(filled + piece, used, grown)
            put(filled, count - used, content)
            left -= used
        if left:
            each = length // piece
            put(each * piece, left // each, ((piece, each),))
            put(left % each * piece, 1 if left % each else 0, ((piece, left % each),))
    done.extend((count, list(content)) for _, _, count, content in sorted(packs, reverse=True))
    return done


def _runs(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of each length lie where: (length, first rank, end rank, first sequence, first offset, per sequence)."""
    out, sequence, ranks = [], 0, dict.fromkeys(histogram, 0)
    for count, content in patterns(histogram, length):
        offset = 0
        for piece, times in content:
            first = ranks[piece]
            ranks[piece] = first + count * times
            out.append((piece, first, ranks[piece], sequence, offset, times))
            offset += piece * times
        sequence += count
    return out


def place(pieces: DataFrame, length: int = LENGTH, by: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """All columns of `pieces` (with `length`, 1 .. `length`) with sequence_id and offset.

    Pieces of a length are ranked in the order of `by`. The histogram of lengths, at most `length`
    numbers, is packed by `patterns`; a pattern takes consecutive ranks of each of its lengths, so a
    rank says in which sequence and where in it a piece lies. Sequences are numbered from 0 without
    gaps and have no gaps inside; only their ends are padding. The table of runs has fewer rows than
    2 x `length` patterns with at most sqrt(2 x `length`) lengths each, and is broadcast.

    Equal pieces may swap places. Null keys come first. Columns called sequence_id or offset are
    replaced. No pieces, no rows.
    """
    spark = pieces.sparkSession
    # Ranges are drawn from a sample first: without this the pieces would be made twice.
    pieces = settle(pieces)
    packed = pack(pieces, _length="length", **{f"_by{k}": c for k, c in enumerate(by)})
    packed = packed.withColumn("_any", F.monotonically_increasing_id())
    order = ["_length", *[f"_by{k}" for k in range(len(by))], "_any"]
    ranked = dense_ordinal(packed, [F.col(c) for c in order], "_ordinal")
    counts = {r["_length"]: r["n"] for r in ranked.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, firsts = 0, {}
    for piece in sorted(counts):
        firsts[piece] = before
        before += counts[piece]
    rows = [(p, firsts[p] + a, firsts[p] + b, s, o, t) for p, a, b, s, o, t in _runs(counts, length)]
    runs = spark.createDataFrame(
        rows, "_piece bigint, _from bigint, _to bigint, _sequence bigint, _offset bigint, _times bigint"
    )
    at = F.col("_ordinal") - F.col("_from")
    inside = (F.col("_length") == F.col("_piece")) & (F.col("_ordinal") >= F.col("_from")) & (F.col("_ordinal") < F.col("_to"))
    placed = ranked.join(F.broadcast(runs), inside)
    return unpack(
        placed, pieces.columns,
        sequence_id=(F.col("_sequence") + F.floor(at / F.col("_times"))),
        offset=F.col("_offset") + at % F.col("_times") * F.col("_length"),
    )
