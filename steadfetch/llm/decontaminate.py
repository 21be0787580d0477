"""Benchmark decontamination: an FM-index per shard of documents, searched for the benchmark's phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal
from ..session import settle
from .fmindex import Index
from .frames import pack, position, tidied, unpack

WINDOW = 10
# A shard is indexed once it has this many words; a document of more words is cut into overlapping parts.
SHARD_WORDS = 1 << 19
# Phrases that are searched together, and blocks of them that are broadcast together: about 40 MB at most.
BLOCK_PHRASES, BLOCKS_AT_ONCE = 8192, 64

# What is between words: all of ASCII but letters and digits. Capital ASCII letters become small ones.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "struct<start: bigint, length: bigint>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if texts.buffers()[2] else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.translate(_WORDS)))
    plain = pc.ascii_trim(plain, " ")
    split = pc.ascii_split_whitespace(plain)
    # An empty text gives one empty word.
    lengths = np.where(pc.binary_length(plain).to_numpy() > 0, pc.list_value_length(split).to_numpy(zero_copy_only=False), 0)
    flat = split.flatten()
    return (flat.filter(pc.not_equal(flat, "")) if (lengths == 0).any() else flat), lengths.astype(np.int64)


def _shard_schema(kind: str) -> str:
    """One row per shard: documents' numbers, ids, marks and words; parts and the index."""
    return (
        f"keys array<bigint>, ids array<{kind}>, marks array<bigint>, sizes array<bigint>, part_keys array<bigint>, "
        "part_begins array<bigint>, part_sizes array<int>, words array<string>, counts binary, levels binary, zeros binary, "
        "sampled binary, samples binary"
    )


def _indexed(window: int, shard_words: int):
    """(id, text, mark) to one row per shard. A task numbers its documents; parts overlap by a window less a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        words = done = 0
        for batch in tidied(batches):
            # A slice holds a bounded number of documents and, but for one very long text, of bytes.
            for begin, end in _slices(batch.column(1)):
                flat, lengths = split_words(batch.column(1)[begin:end])
                held.append((batch.column(0)[begin:end], batch.column(2)[begin:end], flat, lengths, base + done + np.arange(end - begin)))
                words, done = words + len(flat), done + end - begin
                if words >= shard_words:
                    yield from _shards(held, window, shard_words)
                    held, words = [], 0
        if held:
            yield from _shards(held, window, shard_words)

    return run


def _slices(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = min(begin + 65_536, max(begin + 1, int(np.searchsorted(ends, base + size, "right"))))
        yield begin, end
        begin = end


def _shards(held: list[tuple], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """The rows of the documents gathered so far: one, or several for a document longer than a shard."""
    ids = pa.concat_arrays([x[0] for x in held])
    marks = pa.concat_arrays([x[1] for x in held])
    coded = pa.chunked_array([x[2] for x in held]).combine_chunks().dictionary_encode()
    sizes, keys = (np.concatenate([x[k] for x in held]) for k in (3, 4))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    dictionary = coded.dictionary.cast(pa.string())
    step = shard_words - window + 1
    parts = np.maximum(1, -(-(sizes - window + 1) // step)) if len(sizes) else sizes
    doc = np.repeat(np.arange(len(sizes)), parts)
    begins = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    lengths = np.minimum(sizes[doc] - begins, shard_words)
    starts = (np.cumsum(sizes) - sizes)[doc] + begins
    # Parts are dealt to rows in order, each row with about a shard of words.
    row = np.cumsum(lengths) // (2 * shard_words)
    for k in np.unique(row):
        own = np.flatnonzero(row == k)
        at = np.repeat(starts[own] - (np.cumsum(lengths[own]) - lengths[own]), lengths[own]) + np.arange(lengths[own].sum())
        index = Index.build(codes[at], lengths[own], len(dictionary))
        first = own[begins[own] == 0]
        docs = pa.array(doc[first])
        as_list = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [
            as_list(pa.array(keys[doc[first]])), as_list(ids.take(docs)), as_list(marks.take(docs)), as_list(pa.array(sizes[doc[first]])),
            as_list(pa.array(keys[doc[own]])), as_list(pa.array(begins[own])), as_list(pa.array(lengths[own].astype(np.int32))),
            as_list(dictionary), *[pa.array([data], pa.binary()) for data in index.columns()],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[
            "keys", "ids", "marks", "sizes", "part_keys", "part_begins", "part_sizes", "words", "counts", "levels", "zeros", "sampled", "samples",
        ])


def index(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """An FM-index over the words of every text: one row per shard, written and read back.

    Words are runs of characters outside ASCII and of ASCII letters and digits, A-Z lower-cased. A shard holds whole
    documents, `shard_words` to twice as many words; longer documents lie in it in parts that overlap
    by `window` - 1 words, so phrases of up to `window` words are never cut. The index holds the shard's
    different words, the wavelet matrix of the word before each suffix, and sampled positions; the
    texts are not needed again, and other benchmarks can be searched for later.

    Null and empty texts have no words. Ids may be null or repeat: each row is a document.
    """
    packed = pack(docs, id=doc_id, text=text).select("id", "text", F.xxhash64("id", "text").alias("mark"))
    kind = packed.schema["id"].dataType.simpleString()
    if kind == "void":
        packed, kind = packed.withColumn("id", F.col("id").cast("string")), "string"
    return settle(packed.mapInArrow(_indexed(window, shard_words), _shard_schema(kind)))


def phrases(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase, set_id) of all windows of the benchmark, and (set_id, item) of the items that hold them.

    A window is `window` consecutive words of an item, or all words of a shorter item; an item without
    words has none. Phrases that the same items hold share a set.
    """
    items = pack(benchmark, item=item_id, text=text).select(F.col("item").cast("string").alias("item"), "text")
    words = F.regexp_extract_all(F.translate("text", _CAPITALS, _SMALL), F.lit(_PATTERN), F.lit(0))
    split = items.where("text IS NOT NULL").select("item", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    windows = split.select("item", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k + 1, window), " "))).alias("phrase"))
    held = settle(windows.distinct())
    # Two 64-bit sums stand for the set of items, whatever its size.
    known = F.coalesce("item", F.lit(""))
    sums = [F.sum(F.xxhash64(F.lit(k), F.col("item").isNull(), known).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    by_phrase = dense_ordinal(held.groupBy("phrase").agg(*sums), [F.col("phrase")], "number")
    sets = by_phrase.groupBy("s1", "s2").agg(F.min("number").alias("set_id"), F.min_by("phrase", "number").alias("phrase"))
    sets = settle(sets)
    numbered = settle(by_phrase.join(sets.drop("phrase"), ["s1", "s2"]).select("phrase", "number", "set_id"))
    return numbered, settle(held.join(sets.select("phrase", "set_id"), "phrase").select("set_id", "item"))


def _searched(window: int):
    """Rows of an index with a block of phrases to (key, spans, sets) of the documents in which phrases occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in tidied(batches):
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                if last != row["block"].as_py():
                    last, block = row["block"].as_py(), _coded(row["phrases"].values, window)
                vocabulary, places, lengths = block
                codes = pc.fill_null(pc.index_in(vocabulary, row["words"].values), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                found = Index.load([row[n].as_py() for n in ("counts", "levels", "zeros", "sampled", "samples")])
                ids = np.where(places >= 0, codes[places], 0) if len(codes) else places
                yield from _spans(row, found, ids, lengths)

    return run


def _coded(texts: pa.Array, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of phrases, their places among them (right-aligned, -1 to the left), and their lengths."""
    split = pc.split_pattern(texts, " ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    places = np.full((len(lengths), window), -1, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    places[row, window - lengths[row] + at] = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, places, lengths


def _spans(row: dict, found: Index, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document part of a shard in which phrases occur, or several if there are very many occurrences."""
    sizes = row["part_sizes"].values.to_numpy().astype(np.int64)
    keys, begins = row["part_keys"].values.to_numpy(), row["part_begins"].values.to_numpy()
    sets = row["sets"].values.to_numpy()
    starts = np.cumsum(sizes + 1) - sizes - 1
    low, high = found.search(ids, lengths)
    for phrase, at in found.occurrences(low, high):
        part = np.searchsorted(starts, at, "right") - 1
        begin = at - starts[part]
        # Spans of a part that meet become one.
        order = np.lexsort((begin, part))
        p, b, e = part[order], begin[order], begin[order] + lengths[phrase[order]]
        p, b, e = merged(p, b, e)
        pairs = np.unique(np.stack([part, sets[phrase]]), axis=1)
        own = np.unique(p)
        span_ends = np.append(np.searchsorted(p, own), len(p)).astype(np.int32)
        set_ends = np.append(np.searchsorted(pairs[0], own), pairs.shape[1]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(b + begins[p]), pa.array(e - b)], names=["start", "length"])
        yield pa.RecordBatch.from_arrays([
            pa.array(keys[own]), pa.ListArray.from_arrays(pa.array(span_ends), spans),
            pa.ListArray.from_arrays(pa.array(set_ends), pa.array(pairs[1])),
        ], names=["key", "spans", "sets"])


def merged(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by group and begin; those that overlap or touch become one."""
    if not len(group):
        return group, begin, end
    # A running maximum within groups: each group is lifted above the one before it.
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    first = np.ones(len(group), bool)
    first[1:] = begin[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(group)) - 1
    return group[at], begin[at], reach[last] - lift[last]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, spans, sets) with the spans of several parts and blocks: sorted and merged."""
    for batch in batches:
        spans = batch.column(1)
        lengths = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        begin, size = (flat.field(n).to_numpy() for n in ("start", "length"))
        row = np.repeat(np.arange(batch.num_rows), lengths)
        order = np.lexsort((begin, row))
        r, b, e = merged(row[order], begin[order], (begin + size)[order])
        ends = np.append(np.searchsorted(r, np.arange(batch.num_rows)), len(r)).astype(np.int32)
        whole = pa.StructArray.from_arrays([pa.array(b), pa.array(e - b)], names=["start", "length"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), whole), batch.column(2)], names=["key", "spans", "sets"]
        )


def search(indexed: DataFrame, numbered: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, spans, sets): where in each indexed document any of the phrases occurs, in words.

    Every shard is searched for every phrase: the phrases are the stated query set. They come in blocks
    of 8,192; 64 blocks are broadcast at a time, and each such pass reads the index once.
    """
    blocks = settle(
        numbered.withColumn("block", F.floor(F.col("number") / BLOCK_PHRASES).cast("bigint"))
        .groupBy("block").agg(F.collect_list(F.struct("phrase", "set_id")).alias("p"))
        .select("block", F.col("p.phrase").alias("phrases"), F.col("p.set_id").alias("sets"))
    )
    last = blocks.agg(F.max("block")).first()[0]
    found = []
    for begin in range(0, (-1 if last is None else last) + 1, BLOCKS_AT_ONCE):
        some = blocks.where(F.col("block").between(begin, begin + BLOCKS_AT_ONCE - 1))
        numbers = [F.lit(n).cast("bigint") for n in range(begin, min(begin + BLOCKS_AT_ONCE - 1, last) + 1)]
        parts = indexed.drop("keys", "ids", "marks", "sizes").withColumn("block", F.explode(F.array(*numbers)))
        pairs = parts.join(F.broadcast(some), "block")
        found.append(settle(pairs.mapInArrow(_searched(window), f"key bigint, spans array<{_SPAN}>, sets array<bigint>")))
    if not found:
        spark = indexed.sparkSession
        return spark.createDataFrame([], f"key bigint, spans array<{_SPAN}>, sets array<bigint>")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    by_key = every.groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets")
    )
    return settle(by_key.mapInArrow(_united, f"key bigint, spans array<{_SPAN}>, sets array<bigint>"))


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", window: int = WINDOW, shard_words: int = SHARD_WORDS, indexed: DataFrame | None = None,
) -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_hit, spans, items.

    A word is hit if it lies in any occurrence of a window of the benchmark (see `phrases`). `spans` are the
    hit stretches, (start, length) in words, in order and apart; `items` the ids, as strings and
    sorted, of the items with a window in the document. `mark` is a hash of id and text by which `cleaned`
    finds the row. An item whose id is null makes hits but is in no list; repeated ids count once. Rows that
    repeat each get a result. `indexed` is an index made earlier by `index` with the same window.
    """
    indexed = index(docs, text, doc_id, window, shard_words) if indexed is None else indexed
    numbered, members = phrases(benchmark, item_text, item_id, window)
    found = search(indexed, numbered, window)
    lists = (
        found.select("key", F.explode("sets").alias("set_id")).join(members, "set_id").where("item IS NOT NULL")
        .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["length"])
    found = found.select("key", "spans", hits.alias("n_hit")).join(lists, "key", "left")
    documents = indexed.select(F.explode(F.arrays_zip("keys", "ids", "marks", "sizes")).alias("d")).select(
        F.col("d.keys").alias("key"), F.col("d.ids").alias("doc_id"), F.col("d.marks").alias("mark"), F.col("d.sizes").alias("n_words")
    )
    rows = documents.join(found, "key", "left")
    return rows.select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def cleaned(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of `docs`; from texts with hits the hit words and what lies between them are cut out.

    `found` is what `find` says of the same rows. Texts without hits, nulls too, stay as they are.
    """
    word, small = re.compile(_PATTERN), str.maketrans(_CAPITALS, _SMALL)

    @F.udf("string")
    def cut(value: str, spans: list) -> str:
        # Few documents have spans; those that have none do not reach this function.
        places = [m.span() for m in word.finditer(value.translate(small))]
        out, kept = [], 0
        for span in spans:
            out.append(value[kept : places[span["start"]][0]])
            kept = places[span["start"] + span["length"] - 1][1]
        return "".join([*out, value[kept:]])

    names = docs.columns
    at = names[position(docs, text)]
    packed = pack(docs, _id=doc_id, _text=text).withColumn("_mark", F.xxhash64("_id", "_text"))
    hits = found.where("n_hit > 0").select(F.col("mark").alias("_mark"), "spans").dropDuplicates(["_mark"])
    joined = packed.join(hits, "_mark", "left")
    changed = joined.where("spans IS NOT NULL").withColumn("_text", cut("_text", "spans"))
    every = joined.where("spans IS NULL").unionByName(changed)
    return unpack(every, names, replaced={at: F.col("_text")})
