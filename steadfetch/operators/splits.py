"""Splits by query, item sampling and padding for a critic's batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..session import settle
from .groups import PAD_ID
from .ordinal import dense_ordinal

# Groups of at most this many documents are sampled inside their row.
SMALL_GROUP = 64


def query_of(key: Column) -> Column:
    return F.split_part(key, F.lit("_"), F.lit(1)).cast("bigint")


def query_ids(groups: DataFrame) -> DataFrame:
    return groups.select(query_of(F.col("key")).alias("query_idx")).distinct()


def shuffled_ids(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Adds `ordinal`: the place of a query in seeded order."""
    return dense_ordinal(ids, [stable_hash(seed, F.col("query_idx")), F.col("query_idx")])


def folds(ids: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return shuffled_ids(ids, seed).select("query_idx", F.pmod(F.col("ordinal"), F.lit(k)).alias("fold"))


def hold_out(ids: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """The queries of the validation side: a share of all, at least one."""
    numbered = shuffled_ids(ids, seed)
    wanted = max(1, int(share * numbered.count()))
    return numbered.where(F.col("ordinal") < wanted).select("query_idx")


def split_groups(groups: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, validation): all groups of a query land on one side."""
    keyed = groups.withColumn("query_idx", query_of(F.col("key")))
    return (
        keyed.join(held_out, "query_idx", "left_anti"),
        keyed.join(held_out, "query_idx", "left_semi"),
    )


def positive_items(groups: DataFrame) -> DataFrame:
    """One row per positive document: (group columns, item_no, pos_at).

    Groups with a part_no may go on in several records: both numbers then run on over the parts of a
    key, and part_start (the place of the part's first document) and n_items (of the whole key) come
    with them.
    """
    marked = F.transform("pos_mask", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    places = F.transform(F.filter(marked, lambda m: m["p"]), lambda m: m["i"])
    if "part_no" not in groups.columns:
        return groups.select("*", F.posexplode(places).alias("item_no", "pos_at"))
    found = _with_starts(groups).select("*", F.posexplode(places).alias("_item", "_pos"))
    return found.withColumns({
        "item_no": F.col("_first_item") + F.col("_item"), "pos_at": F.col("part_start") + F.col("_pos"),
    }).drop("_item", "_pos", "_first_item")


def _with_starts(groups: DataFrame) -> DataFrame:
    """Adds part_start, _first_item and n_items; the windows see one narrow row per part."""
    counts = groups.select(
        "key", "part_no", F.size("pos_mask").cast("bigint").alias("_n"),
        F.size(F.filter("pos_mask", lambda p: p)).cast("bigint").alias("_p"),
    )
    whole = Window.partitionBy("key")
    before = whole.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = counts.select(
        "key", "part_no", F.coalesce(F.sum("_n").over(before), zero).alias("part_start"),
        F.coalesce(F.sum("_p").over(before), zero).alias("_first_item"), F.sum("_p").over(whole).alias("n_items"),
    )
    return groups.join(starts, ["key", "part_no"])


def draw_numbers(free: Column, n: int, *parts) -> Column:
    """min(n, free) different numbers below `free`, each set of them as likely; draw j follows a hash of (parts, j).

    Draw j is a number below free - j that steps over the ones drawn before it, so nothing is sorted or rejected.
    """
    def add(drawn: Column, j: Column) -> Column:
        raw = F.pmod(stable_hash(*parts, j), F.greatest(free - j, F.lit(1))).cast("bigint")
        stepped = F.aggregate(F.array_sort(drawn), raw, lambda at, p: at + F.when(at >= p, 1).otherwise(0).cast("bigint"))
        return F.when(free > j, F.array_append(drawn, stepped)).otherwise(drawn)

    if n <= 0:
        return F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<bigint>"), add)


def sample_items(
    items: DataFrame, n_neg: int = 10, seed: int = 42, epoch: int = 0, redraw_positive: bool = False
) -> DataFrame:
    """Adds `picked`: places of one positive, then up to `n_neg` negatives of the group.

    Everything happens inside the row, by numbers drawn from a hash of (seed, epoch, key, item); for groups in
    parts see `sample_over_parts`, which makes the same draws. With `redraw_positive` any positive of the group may come first and negatives are
    documents with score zero; else the item's own positive stays and negatives are all
    documents that are not positive.
    """
    if "part_no" in items.columns:
        raise ValueError("items of groups in parts are drawn by sample_over_parts")
    places = F.sequence(F.lit(0), F.size("pos_mask") - 1)
    if redraw_positive:
        is_neg = lambda i: F.get("scores", i) == 0
        all_pos = F.filter(places, lambda i: F.get("pos_mask", i))
        draw = F.pmod(stable_hash(seed, epoch, F.col("key"), F.col("item_no")), F.size(all_pos))
        first = F.get(all_pos, draw.cast("int"))
    else:
        is_neg = lambda i: ~F.get("pos_mask", i)
        first = F.col("pos_at")
    drawn = items.withColumn("_neg", F.filter(places, is_neg))
    drawn = drawn.withColumn("_draws", draw_numbers(F.size("_neg"), n_neg, seed, epoch, F.col("key"), F.col("item_no")))
    negatives = F.transform("_draws", lambda d: F.get("_neg", d.cast("int")))
    return drawn.withColumn("picked", F.concat(F.array(first), negatives)).withColumn(
        "labels", F.transform("picked", lambda i: F.get("scores", i))
    ).drop("_neg", "_draws")


def _numbered(groups: DataFrame, chosen, total: str) -> DataFrame:
    """(key, number, place, score) of the chosen documents, numbered from 0 in each key over its parts.

    `chosen` tells of (pos_mask, score). Further columns whose name begins with `_of_` are counts of the key and
    come along; `total` adds one of the chosen ones. The windows see one narrow row per part.
    """
    entries = F.transform(F.arrays_zip("pos_mask", "scores"), lambda e, i: F.struct(i.alias("i"), e["pos_mask"].alias("m"), e["scores"].alias("s")))
    kept = F.filter(entries, lambda e: chosen(e["m"], e["s"]))
    sizes = groups.select("key", "part_no", F.size("pos_mask").cast("bigint").alias("_n"), F.size(kept).cast("bigint").alias("_k"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = sizes.select(
        "key", "part_no", F.coalesce(F.sum("_n").over(before), zero).alias("_from"),
        F.coalesce(F.sum("_k").over(before), zero).alias("_first"), F.sum("_k").over(whole).alias(total),
    )
    more = [c for c in groups.columns if c.startswith("_of_")]
    rows = groups.select("key", "part_no", *more, kept.alias("_kept")).join(starts, ["key", "part_no"])
    rows = rows.select("key", "_from", "_first", total, *more, F.posexplode("_kept").alias("_at", "_e"))
    return rows.select(
        "key", (F.col("_first") + F.col("_at")).alias("number"), (F.col("_from") + F.col("_e.i")).alias("place"), F.col("_e.s").alias("score"), total, *more
    )


def _sample_by_number(
    groups: DataFrame, n_neg: int = 10, seed: int = 42, epoch: int = 0, redraw_positive: bool = False
) -> DataFrame:
    """`sample_over_parts` for groups of any size.

    A group's negatives are numbered once, an item draws numbers, and number meets negative in an equi-join on
    (key, number), no hot key. The work grows with documents and with items x `n_neg`, never with items x documents.
    """
    is_neg = (lambda mask, score: score == 0) if redraw_positive else (lambda mask, score: ~mask)
    negatives = settle(_numbered(groups, is_neg, "_total"))
    free = negatives.groupBy("key").agg(F.max("_total").alias("_of_negatives"))
    # Counts come to the parts, of which a key has few, not to the items.
    known = groups.join(free, "key", "left").withColumn("_of_negatives", F.coalesce("_of_negatives", F.lit(0).cast("bigint")))
    items = settle(_numbered(known, lambda mask, score: mask, "_positives").withColumnRenamed("number", "item_no"))
    numbers = draw_numbers(F.col("_of_negatives"), n_neg, seed, epoch, F.col("key"), F.col("item_no"))
    asked = items.select("key", "item_no", F.posexplode(numbers).alias("j", "number"))
    met = asked.join(negatives.select("key", "number", "place", "score"), ["key", "number"])
    drawn = met.groupBy("key", "item_no").agg(F.sort_array(F.collect_list(F.struct("j", "place", "score"))).alias("_neg"))  # n_neg entries
    first = items.select("key", "item_no", F.col("place").alias("pos_at"), F.col("place").alias("_first"), F.col("score").alias("_label"))
    if redraw_positive:
        pick = F.pmod(stable_hash(seed, epoch, F.col("key"), F.col("item_no")), F.col("_positives"))
        all_pos = items.select("key", F.col("item_no").alias("_pick"), F.col("place").alias("_first"), F.col("score").alias("_label"))
        first = items.select("key", "item_no", F.col("place").alias("pos_at"), pick.alias("_pick")).join(all_pos, ["key", "_pick"])
    joined = first.join(drawn, ["key", "item_no"], "left")
    rest = lambda name: F.coalesce(F.transform("_neg", lambda x: x[name]), F.array())
    return joined.select(
        "key", "item_no", "pos_at", F.concat(F.array("_first"), rest("place")).alias("picked"), F.concat(F.array("_label"), rest("score")).alias("labels"),
    )


def sample_over_parts(
    groups: DataFrame, n_neg: int = 10, seed: int = 42, epoch: int = 0, redraw_positive: bool = False
) -> DataFrame:
    """(key, item_no, pos_at, picked, labels) of all positives of groups with a part_no.

    The draws of `sample_items` from the whole group. Groups of one part and at most SMALL_GROUP documents
    draw inside their row and do not move; all others meet their negatives by number.
    """
    groups = settle(groups)
    few = F.coalesce((F.col("part_no") == 0) & (F.size("pos_mask") <= SMALL_GROUP), F.lit(False))
    longer = groups.where("part_no <> 0").select("key").distinct()
    small, large = groups.where(few), groups.where(~few)
    if not longer.isEmpty():
        # A key's parts stay together, however short its first one is.
        small, large = small.join(longer, "key", "left_anti"), large.unionByName(small.join(longer, "key", "left_semi"))
    drawn = sample_items(positive_items(small.drop("part_no")), n_neg, seed, epoch, redraw_positive)
    inside = drawn.select(
        "key", F.col("item_no").cast("bigint").alias("item_no"), F.col("pos_at").cast("bigint").alias("pos_at"),
        F.col("picked").cast("array<bigint>").alias("picked"), "labels",
    )
    if large.isEmpty():
        return inside
    return inside.unionByName(_sample_by_number(large, n_neg, seed, epoch, redraw_positive))


def padded_batches(rows: DataFrame, order: list[Column], batch_size: int = 32) -> DataFrame:
    """Adds batch, input_ids padded to the longest of the batch, and attention_mask."""
    numbered = dense_ordinal(rows, order).withColumn("batch", F.floor(F.col("ordinal") / batch_size))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))  # batch_size rows
    sized = numbered.withColumn("_n", F.size("input_ids")).withColumn("_max", longest)
    gap = F.col("_max") - F.col("_n")
    return sized.withColumns({
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), gap)),
        "input_ids": F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), gap)),
    }).drop("_n", "_max")
