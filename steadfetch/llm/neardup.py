"""Near-duplicate classes: ProbMinHash signatures, banding, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle, settle_last
from . import sketch
from .components import components
from .frames import hashable, pack, tidied, unpack

SIMILARITY = 0.8
# Texts are sketched in slices of at most this many documents and about as many bytes.
SLICE_DOCS, SLICE_BYTES = 512, 1 << 22
# Nodes of a bucket that meet as many others in one group of a task, and pairs that are looked at together.
BLOCK_NODES, PAIRS = 4096, 1 << 17
# Texts that are compared in one group of a task, by number and bytes, and those that go to every such group of a neighbourhood.
GROUP_NODES, GROUP_BYTES, HEADS = 1024, 1 << 24, 32
# Nodes whose hashes, 8 bytes each, go to all tasks, so that other texts need not move.
FEW_NODES = 2_000_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts.cast(pa.binary())])
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = min(begin + SLICE_DOCS, max(begin + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right"))))
        yield begin, end
        begin = end


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, bands, signature); texts without words have no bands.

    The signature is that of the weighted shingles, then that of the plain set.
    """
    for batch in tidied(batches):
        for begin, end in _slices(batch.column(1)):
            nodes, texts = batch.column(0)[begin:end], batch.column(1)[begin:end]
            docs = end - begin
            doc, value, times = sketch.shingles(texts)
            found = sketch.signatures(doc, value, sketch.weights(times), docs)
            # Without a repeated shingle all weights are 1 and the plain signature is the same.
            repeats = np.unique(doc[times > 1])
            again = np.isin(doc, repeats)
            plain = found.copy()
            plain[repeats] = sketch.signatures(
                np.searchsorted(repeats, doc[again]), value[again], np.ones(int(again.sum())), len(repeats)
            )
            empty = np.bincount(doc, minlength=docs) == 0
            keep = np.flatnonzero(~empty)
            bands, more = sketch.band_keys(found)[keep], sketch.band_keys(plain)[keep]
            # Both signatures share the keys: a text with repeats meets the plain ones of texts without.
            own = np.concatenate([np.ones_like(bands, bool), more != bands], axis=1)
            ends = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([bands, more], axis=1)[own]))
            short = np.concatenate([sketch.short_signature(found), sketch.short_signature(plain)], axis=1)[keep]
            yield pa.RecordBatch.from_arrays(
                [nodes.take(pa.array(keep)), lists, pa.array([row.tobytes() for row in short], pa.binary())],
                names=["node", "bands", "signature"],
            )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _likely(least: float):
    """Keeps the pairs whose weighted or plain signatures agree well enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            if batch.num_rows:
                kept = sketch.likely(_signatures(batch.column(2)), _signatures(batch.column(3)), least)
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by `key`, cut where the key changes; the last group of a batch may go on in the next one."""
    held = None
    for batch in tidied(batches):
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        values = [rows[c] for c in key]
        same = np.logical_and.reduce([pc.equal(v, v[-1]).to_numpy() for v in values])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _begins(rows: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.logical_or.reduce([pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy() for c in key])
    return np.flatnonzero(new)


class _Forest:
    """Which keys a task has connected so far."""

    def __init__(self):
        self.above: dict = {}

    def root(self, key):
        above = self.above
        while (up := above.get(key, key)) != key:
            above[key] = above.get(up, up)
            key = up
        return key

    def connects(self, one, other) -> bool:
        """Connects two keys; whether they were not before."""
        one, other = self.root(one), self.root(other)
        if one == other:
            return False
        self.above[max(one, other)] = min(one, other)
        return True


def _met(least: float):
    """Rows of buckets, sorted by their group, to likely pairs of a left and a right row that connect unlike classes.

    Groups are of a bounded size, and pairs are looked at in lots. Of the likely ones only those leave the
    task that connect classes that it has not connected yet: fewer than it has rows.
    """
    key = ("band", "minor", "block")

    def pairs(rows: pa.Table, forest: _Forest) -> Iterator[pa.RecordBatch]:
        left = rows["left"].to_numpy().astype(bool)
        begins = _begins(rows, key)
        ends = np.append(begins[1:], len(left))
        # Left rows come first in a group.
        lefts = np.add.reduceat(left.astype(np.int64), begins)
        rights = ends - begins - lefts
        last = np.cumsum(lefts * rights)
        comp, node = rows["mark"].to_numpy(), rows["node"].chunk(0)
        signature = _signatures(rows["signature"].chunk(0))
        for begin in range(0, int(last[-1]), PAIRS):
            number = np.arange(begin, min(begin + PAIRS, int(last[-1])))
            group = np.searchsorted(last, number, "right")
            within = number - (last[group] - lefts[group] * rights[group])
            one = begins[group] + within // rights[group]
            other = begins[group] + lefts[group] + within % rights[group]
            unlike = comp[one] != comp[other]
            one, other = one[unlike], other[unlike]
            found = sketch.likely(signature[one], signature[other], least)
            one, other = one[found], other[found]
            new = np.array([forest.connects(x, y) for x, y in zip(comp[one].tolist(), comp[other].tolist())], bool)
            one, other = pa.array(one[new]), pa.array(other[new])
            yield pa.RecordBatch.from_arrays([node.take(one), node.take(other)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for rows in _whole_groups(batches, key):
            yield from pairs(rows, forest)

    return run


def _compared(least: float):
    """Rows of groups, sorted by group and left ones first, to links (a, b) that connect all of a group's links connect.

    Left texts meet right ones, or one another in a group without right ones. Two texts are compared if
    their signatures allow it and no links connect them yet, the closest by signature first, so n copies
    take about n comparisons. Near misses are all compared, but only links leave the task: fewer than rows.
    """
    key = ("grp", "minor", "block")

    def links(rows: pa.Table) -> tuple[list[int], list[int]]:
        left = rows["left"].to_numpy().astype(bool)
        mark = np.unique(rows["mark"].to_numpy(), return_inverse=True)[1]
        signature, text = _signatures(rows["signature"].chunk(0)), rows["text"]
        sets: dict[int, tuple] = {}

        def of(k: int) -> tuple:
            if k not in sets:
                _, value, times = sketch.shingles(pa.array([text[k].as_py()]))
                sets[k] = (value, sketch.weights(times))
            return sets[k]

        out: tuple[list[int], list[int]] = ([], [])
        lefts = int(left.sum())
        for one in range(lefts):
            others = np.arange(one + 1 if lefts == len(left) else lefts, len(left))
            others = others[mark[others] != mark[one]]
            differ = sketch.differing(signature[one : one + 1], signature[others])
            near = np.flatnonzero(sketch.likely(signature[one : one + 1], signature[others], least))
            for other in others[near[np.argsort(differ[near], kind="stable")]]:
                if mark[one] != mark[other] and max(sketch.similarity(of(one), of(other))) >= least:
                    out[0].append(one)
                    out[1].append(int(other))
                    mark[mark == mark[other]] = mark[one]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, key):
            begins = _begins(rows, key)
            for begin, end in zip(begins, np.append(begins[1:], rows.num_rows)):
                group = rows.slice(begin, end - begin).combine_chunks()
                one, other = links(group)
                node = group["node"].chunk(0)
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(one, pa.int64())), node.take(pa.array(other, pa.int64()))], names=["a", "b"]
                )

    return run


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link."""
    short = nodes.select("node", "signature")
    with_short = pairs.join(short.toDF("a", "sa"), "a").join(short.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return with_short.mapInArrow(_likely(least), "a binary, b binary")


def _star_pairs(members: DataFrame) -> DataFrame:
    """In every bucket, each node with the smallest one: as many pairs as members."""
    heads = members.groupBy("band").agg(F.min("node").alias("head"))
    return members.join(heads, "band").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()


def _rest_pairs(members: DataFrame, classes: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Likely pairs of buckets that connect what `classes` does not: all that any likely pair of a bucket connects.

    In a bucket one class, the largest, takes no part among itself; each other node, a minor one, meets
    the nodes of all other classes. Near copies are in one class by now, so few nodes are left to meet, and
    they meet by signature inside the task, blocks of minor nodes with blocks of all: no table of pairs
    holds unlike ones, or more pairs than rows.
    """
    owned = members.join(classes, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    owned = settle(owned)
    sizes = owned.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("all"), F.max("n").alias("most"),
    ).where("classes > 1")
    mixed = owned.join(main, "band").join(nodes.select("node", "signature"), "node")
    blocks = F.ceil(F.col("all") / BLOCK_NODES).cast("int")
    minors = F.ceil((F.col("all") - F.col("most")) / BLOCK_NODES).cast("int")
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    common = ["band", "node", F.xxhash64("comp").alias("mark"), "signature"]
    left = mixed.where("comp <> main").select(
        *common, F.lit(True).alias("left"), dealt(minors, 1).alias("minor"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    )
    right = mixed.select(
        *common, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), minors - 1)).alias("minor"), dealt(blocks, 2).alias("block")
    )
    group = ["band", "minor", "block"]
    rows = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, F.col("left").desc())
    found = rows.select(*group, "left", "node", "mark", "signature").mapInArrow(_met(least), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _neighbourhoods(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, grp) of all nodes with a likely pair: two nodes that share a bucket and may be linked have one `grp`."""
    first = settle(components(settle(_likely_pairs(settle(_star_pairs(members)), nodes, least))))
    more = settle(_rest_pairs(members, first, nodes, least))
    # The classes so far are the nodes of what is left to connect.
    owner = first.withColumnRenamed("comp", "own")
    ends = [more.select(F.col(c).alias("node")) for c in ("a", "b")]
    every = ends[0].unionByName(ends[1]).distinct().join(owner, "node", "left").select("node", F.coalesce("own", "node").alias("own"))
    of = lambda c: every.toDF(c, f"{c}_own")
    joined = components(more.join(of("a"), "a").join(of("b"), "b"), "a_own", "b_own").toDF("own", "comp")
    whole = owner.unionByName(every).distinct().join(joined, "own", "left")
    return whole.select("node", F.coalesce("comp", "own").alias("grp"))


def _dealt(parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "node"), parts).cast("int")


def _compare(rows: DataFrame, least: float) -> DataFrame:
    group = ["grp", "minor", "block"]
    rows = rows.select(*group, "left", "node", "mark", "signature", "text")
    rows = rows.repartition(*group).sortWithinPartitions(*group, F.col("left").desc())
    return settle(rows.mapInArrow(_compared(least), "a binary, b binary"))


def _links(held: DataFrame, least: float) -> DataFrame:
    """Links that connect all that any link inside a neighbourhood connects; `held` has node, grp, signature and text.

    A neighbourhood is compared whole in one group of a task. A large one is dealt to several, and some
    of its nodes go to all of them, so near copies are one class by then; what is left are minor nodes, which
    meet all the others in blocks.
    """
    sizes = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / GROUP_NODES, F.col("bytes") / GROUP_BYTES)).cast("int")
    large = settle(sizes.withColumn("parts", parts).where("parts > 1").select("grp", "n", "parts"))
    dealt = held.join(F.broadcast(large), "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    head = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n")) < HEADS
    found = _compare(
        dealt.select(
            "grp", F.lit(0).alias("minor"), F.explode(F.when(head, every).otherwise(F.array(_dealt(F.col("parts"), 1)))).alias("block"),
            F.lit(True).alias("left"), "node", F.xxhash64("node").alias("mark"), "signature", "text",
        ),
        least,
    )
    if large.isEmpty():
        return found
    owner = components(found)
    owned = held.join(F.broadcast(large), "grp").join(owner, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    owned = settle(owned)
    of_class = owned.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = of_class.groupBy("grp").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("classes"), F.max("m").alias("most")
    ).where("classes > 1").select("grp", "main", "most")
    mixed = owned.join(F.broadcast(main), "grp")
    minors = F.ceil(F.col("parts") * (F.col("n") - F.col("most")) / F.col("n")).cast("int")
    common = ["grp", "node", F.xxhash64("comp").alias("mark"), "signature", "text"]
    left = mixed.where("comp <> main").select(
        *common, F.lit(True).alias("left"), _dealt(minors, 1).alias("minor"), F.explode(every).alias("block")
    )
    right = mixed.select(
        *common, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), minors - 1)).alias("minor"), _dealt(F.col("parts"), 2).alias("block")
    )
    return found.unionByName(_compare(left.unionByName(right), least))


def _texts_of(near: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes of `near`, and at most a few others whose hashes are the same."""
    if near.count() > FEW_NODES:
        return texts.join(near, "node", "left_semi")
    keys = near.select(F.xxhash64("node").alias("key"))
    return texts.withColumn("key", F.xxhash64("node")).join(F.broadcast(keys), "key", "left_semi").drop("key")


def _classes(packed: DataFrame, least: float) -> DataFrame:
    """(node, comp) of all texts that are similar to another text; `packed` has node and text."""
    texts = packed.where("node IS NOT NULL").select("node", "text")
    sketched = texts.mapInArrow(_sketched, "node binary, bands array<bigint>, signature binary")
    nodes = settle(sketched.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    members = nodes.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = settle(members.join(shared, "band", "left_semi"))
    near = settle(_neighbourhoods(members, nodes, least))
    # Copies combine before the texts move.
    needed = _texts_of(near, texts).groupBy("node").agg(F.any_value("text").alias("text"))
    held = settle(needed.join(near, "node").join(nodes.select("node", "signature"), "node"))
    return components(_links(held, least))


def _packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return pack(docs, text=text, _id=doc_id).withColumn("node", F.unhex(F.md5("text")))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """All columns of `docs` with `class_id`, the smallest id among its near copies (itself included).

    Two texts are linked if their shingles of 5 words, weighted by 1 + ln(times), have a probability
    Jaccard similarity of at least `similarity`, or their shingle sets a Jaccard similarity as high;
    classes are what links connect. Equal texts are one node from the start, so a group of copies of
    any size is one row. Candidates share a band of signature registers, of the weighted
    signature or of one with all weights 1, whose registers agree with the plain Jaccard similarity (64
    bands of 7 out of 160: a pair at 0.8 by either measure is missed 4 times in 100,000, a closer one less often); candidates whose signatures allow a link are one neighbourhood, and inside it all such
    pairs are compared on their texts unless they are connected already, without a limit on bucket sizes.

    A null text is in a class of its own, with its own id; texts without words only equal each other
    if they are the same. An id that is null gives way to the class's other ids. A column called
    class_id is replaced. An empty table gives an empty result.
    """
    packed = _packed(docs, text, doc_id)

    def of_nodes() -> DataFrame:
        found = settle(_classes(packed, similarity))
        ids = packed.where("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("id"))
        owned = ids.join(found, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
        owned = settle(owned)
        least = owned.groupBy("comp").agg(F.min("id").alias("class_id"))
        return owned.join(least, "comp").select("node", "class_id")

    by_node = settle_last(docs.sparkSession, of_nodes)
    rows = packed.join(by_node, "node", "left")
    return unpack(rows, docs.columns, class_id=F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id")))


def representatives(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY
) -> DataFrame:
    """One row of each class: the one with the smallest id (null ids last; equal rows stand for each other).

    Rows with a null text have no copies and all stay.
    """
    packed = _packed(docs, text, doc_id)
    packed = packed.withColumn("_key", F.struct(F.col("_id").isNull().alias("no"), "_id", hashable(packed).alias("row")))

    def of_classes() -> DataFrame:
        found = settle(_classes(packed, similarity))
        keys = packed.where("node IS NOT NULL").groupBy("node").agg(F.min("_key").alias("key"))
        owned = keys.join(found, "node", "left").select("node", "key", F.coalesce("comp", "node").alias("comp"))
        return owned.groupBy("comp").agg(F.min_by("node", "key").alias("node")).select("node")

    heads = settle_last(docs.sparkSession, of_classes)
    # Copies combine before the rows move; each text moves once.
    one = packed.where("node IS NOT NULL").join(heads, "node", "left_semi").groupBy("node").agg(F.min_by("row", "_key").alias("row"))
    alone = packed.where("node IS NULL").select("node", "row")
    return unpack(one.unionByName(alone), docs.columns)
