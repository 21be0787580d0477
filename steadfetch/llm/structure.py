"""Repair of a conversation's turn structure: least edits, and of these the least audit string.

Rows lie on a line per conversation; a state says what the kept rows so far look like. Edits are arcs
between (row, state) nodes. Conversations are cut into blocks of rows; a block's costs are a 4 x 4
(min, +) matrix, and what lies before or after a block is known by doubling over blocks, so that a
conversation may have any number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import ordinal_in_group
from ..session import settle
from .frames import pack, position, unpack

BLOCK = 1024
# Blocks are worked on in lots of about this many rows, the longest block's length times their number.
LOT_ROWS = 1 << 18

# States: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
# Where a row of the expected role leads.
NEXT = np.array([USER, USER, ASSISTANT, USER])
# What the rows after the last one may still need: inserts up to an assistant row.
END_COST, END_AUDIT, END_ROLES = np.array([0, 10, 5, 0]), ["", "II", "I", ""], ["", "ua", "a", ""]
COSTS = {"D": 2, "I": 5, "R": 1}
TRUNCATED_COST = 5
LETTERS = "DIKR"
FAR = 1 << 40
# Codes of rows: class of the role (s, u, a, other) times 4 plus the fault.
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"


def _padded(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of codes as a matrix, and their lengths."""
    lengths = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), 1)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes.flatten().to_numpy(zero_copy_only=False)
    return out, lengths


def _lots(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose padded codes stay small."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        widest = np.maximum.accumulate(np.maximum(lengths[begin:], 1)) * np.arange(1, batch.num_rows - begin + 1)
        end = begin + max(1, int(np.searchsorted(widest, LOT_ROWS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _moves(code: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
    """Cost to the end by each edit that uses up the row, per (block, state, ...); `after` is the cost from the next row on."""
    extra = [slice(None)] + [None] * (after.ndim - 1)
    role, fault = (code >> 2)[tuple(extra)], (code & 3)[tuple(extra)]
    must_go = (fault == BLANK) | (fault == DUPLICATE)
    stay = np.where(must_go, FAR, np.where(fault == TRUNCATED, TRUNCATED_COST, 0))
    keep = np.full_like(after, FAR)
    keep[:, EMPTY] = np.where(role[:, 0] == 0, after[:, SYSTEM], np.where(role[:, 0] == 1, after[:, USER], FAR))
    keep[:, SYSTEM] = keep[:, ASSISTANT] = np.where(role[:, 0] == 1, after[:, USER], FAR)
    keep[:, USER] = np.where(role[:, 0] == 2, after[:, ASSISTANT], FAR)
    return {
        "D": np.minimum(COSTS["D"] + after, FAR), "K": np.minimum(keep + stay, FAR),
        "R": np.minimum(COSTS["R"] + after[:, NEXT] + stay, FAR),
    }


def _with_inserts(plain: np.ndarray) -> np.ndarray:
    """Costs where any rows may be inserted before the next edit."""
    out = plain.copy()
    out[:, USER] = np.minimum(plain[:, USER], COSTS["I"] + plain[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(plain[:, ASSISTANT], COSTS["I"] + plain[:, USER])
    for state in (EMPTY, SYSTEM):
        out[:, state] = np.minimum(plain[:, state], COSTS["I"] + out[:, USER])
    return out


def _costs(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost to the end from (block, row, state): `end` holds the costs behind the last row."""
    out = np.broadcast_to(end[:, None], (len(codes), codes.shape[1] + 1, *end.shape[1:])).copy()
    for k in reversed(range(codes.shape[1])):
        live = np.flatnonzero(lengths > k)
        out[live, k] = _with_inserts(np.minimum.reduce(list(_moves(codes[live, k], out[live, k + 1]).values())))
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, before, codes) with `costs`, from every state before the block to every state behind it, and `illegal`."""
    for whole in batches:
        for batch in _lots(whole, "codes"):
            codes, lengths = _padded(batch.column("codes"))
            unit = np.where(np.eye(4, dtype=bool), 0, FAR)
            costs = _costs(codes, lengths, np.broadcast_to(unit, (len(codes), 4, 4)))[:, 0].reshape(len(codes), 16)
            role = codes >> 2
            before = batch.column("before").to_numpy(zero_copy_only=False)
            pairs = np.concatenate([np.where(np.isnan(before), -1, before)[:, None].astype(np.int64), role[:, :-1]], axis=1) * 4 + role
            legal = np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
            inside = np.arange(codes.shape[1]) < lengths[:, None]
            inside[:, 0] &= ~np.isnan(before)
            illegal = (inside & ~legal).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(codes) + 1, 16, dtype=np.int32)), pa.array(costs.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("key", "block", "codes")], lists, pa.array(illegal)], names=["key", "block", "codes", "costs", "illegal"]
            )


def _arcs(codes: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from node, letter, to node) of the optimal arcs; node (block, row, state) has number (block * rows + row) * 4 + state."""
    rows = codes.shape[1] + 1
    found = []
    inside = np.arange(codes.shape[1]) < lengths[:, None]
    block, row = np.nonzero(inside)
    here, after = cost[block, row], cost[block, row + 1]
    node = ((block * rows + row) * 4)[:, None] + np.arange(4)
    moves = _moves(codes[block, row], after)
    moves["I"] = COSTS["I"] + here[:, NEXT]
    kept = np.stack([np.where(codes[block, row] >> 2 == 0, SYSTEM, USER), *[np.full(len(block), s) for s in (USER, ASSISTANT, USER)]], axis=1)
    to = {
        "D": node + 4, "I": ((block * rows + row) * 4)[:, None] + NEXT, "K": ((block * rows + row + 1) * 4)[:, None] + kept,
        "R": ((block * rows + row + 1) * 4)[:, None] + NEXT,
    }
    for number, letter in enumerate(LETTERS):
        best = (moves[letter] == here) & (here < FAR)
        found.append((node[best], np.full(int(best.sum()), number + 1), to[letter][best]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _least_paths(source: np.ndarray, letter: np.ndarray, target: np.ndarray, nodes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each node's arc with the least audit (-1: none), and where 1, 2, 4, ... such arcs lead.

    Arcs are ranked by their audits' first letter, then by twice as many letters each round: an arc's
    rank for 2^(k+1) letters follows from its own for 2^k and that of the best arc where its
    pointer ends. A node's best arc has the least rank; an audit that has ended is the least.
    """
    rank = letter.astype(np.int64)
    best, pointers = np.full(nodes, -1), []
    by_node = lambda: np.lexsort((rank, source))
    ends = target.copy()
    while True:
        order = by_node()
        first = np.ones(len(order), bool)
        first[1:] = source[order][1:] != source[order][:-1]
        best[source[order][first]] = order[first]
        pointer = np.arange(nodes)
        has = best >= 0
        pointer[has] = ends[best[has]]
        pointers.append(pointer)
        onward = best[ends]
        if not (onward >= 0).any():
            return best, pointers
        # The same letters again, from where an arc's pointer ends; 0 where nothing follows.
        following = np.where(onward >= 0, rank[onward], 0)
        _, rank = np.unique(rank * (int(rank.max()) + 1) + following, return_inverse=True)
        rank = rank + 1
        ends = pointer[ends]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, codes, end) to the least audit from every state: audits, roles and the states behind the block."""
    for whole in batches:
        for batch in _lots(whole, "codes"):
            codes, lengths = _padded(batch.column("codes"))
            blocks, rows = len(codes), codes.shape[1] + 1
            end = batch.column("end").flatten().to_numpy(zero_copy_only=False).reshape(blocks, 4).astype(np.int64)
            source, letter, target = _arcs(codes, lengths, _costs(codes, lengths, end))
            best, pointers = _least_paths(source, letter, target, blocks * rows * 4)
            at = ((np.arange(blocks) * rows * 4)[:, None] + np.arange(4)).ravel()
            steps = _walk(at, pointers)
            live = best[steps] >= 0
            letters = np.where(live, letter[best[steps]], 0)
            to = np.where(live, target[best[steps]] % 4, 0)
            # What an edit leaves behind: a deleted row nothing, others the role of the state they lead to.
            role = np.where(letters == 1, ord("-"), np.array([ord(c) for c in "-sua"])[to])
            counts = live.sum(axis=1)
            exits = steps[:, -1] % 4
            text = np.array([0, *map(ord, LETTERS)])[letters].astype(np.uint8)[live].tobytes().decode()
            roles = role.astype(np.uint8)[live].tobytes().decode()
            cuts = np.concatenate([[0], np.cumsum(counts)])
            pick = lambda data: pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])])
            fours = pa.array(np.arange(0, 4 * blocks + 1, 4, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("block"), pa.ListArray.from_arrays(fours, pick(text)),
                pa.ListArray.from_arrays(fours, pick(roles)), pa.ListArray.from_arrays(fours, pa.array(exits.astype(np.int32))),
            ], names=["key", "block", "audits", "roles", "exits"])


def _walk(at: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """The nodes of the paths that begin at `at`, one row each: doubled by one pointer after the other."""
    steps = at[:, None]
    for pointer in pointers:
        steps = np.concatenate([steps, pointer[steps]], axis=1)
    return steps


def _row_codes(text, role):
    """The code of a row by itself: class of its role and fault; duplicates are found later."""
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = F.rtrim(text, F.lit(SPACES))
    fault = F.when(F.length(F.ltrim(bare, F.lit(SPACES))) == 0, BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    return (kind * 4 + F.coalesce(fault, F.lit(NO_FAULT))).cast("int")


def _numbered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, pos, _conv, _turn, _role, _text, row, code, digest), one row per turn; `key` names the conversation, null too."""
    packed = pack(conversations, _conv=conv_id, _turn=turn, _role=role, _text=text)
    packed = packed.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("_role", "_text")})
    packed = packed.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit("")))
    placed = ordinal_in_group(packed, ["key"], [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")], "pos")
    digest = F.md5(F.concat(F.hex("_role"), F.lit(":"), "_text"))
    return settle(placed.withColumns({"code": _row_codes(F.col("_text"), F.col("_role")), "digest": digest}))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, block, before, codes): the rows' codes in order, and the role class of the row before the block."""
    # The first place of each text of a conversation is a key of its own, so a text of any number of copies is no hot key.
    firsts = rows.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    lean = rows.select("key", "pos", "code").join(firsts, ["key", "pos"], "left")
    repeated = F.col("first").isNull() & (F.col("code").bitwiseAND(3) != BLANK)
    code = F.when(repeated, F.col("code").bitwiseAND(~3) + DUPLICATE).otherwise(F.col("code"))
    at = F.floor(F.col("pos") / block).cast("bigint")
    # The last row of a block is also told to the next one.
    both = F.when(F.col("pos") % block == block - 1, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = lean.select("key", "pos", code.cast("int").alias("code"), F.explode(both).alias("block"))
    lists = dealt.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("r"))
    own = F.filter("r", lambda x: x["pos"] >= F.col("block") * block)
    before = F.filter("r", lambda x: x["pos"] < F.col("block") * block)
    out = lists.select(
        "key", "block", F.shiftright(F.get(F.transform(before, lambda x: x["code"]), F.lit(0)), 2).alias("before"),
        F.transform(own, lambda x: x["code"]).alias("codes"),
    )
    return out.where(F.size("codes") > 0)


def _doubled(blocks: DataFrame, value: str, combine, last: int, forward: bool) -> DataFrame:
    """Joins each block's value with those of 1, 2, 4, ... blocks further on, until the end; (key, block) is no hot key."""
    step, now = 1, blocks.select("key", "block", value)
    while step <= last:
        shift = F.col("block") - step if forward else F.col("block") + step
        far = now.select("key", shift.alias("block"), F.col(value).alias("_far"))
        now = settle(
            now.join(far, ["key", "block"], "left")
            .select("key", "block", F.when(F.col("_far").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_far"))).alias(value))
        )
        step *= 2
    return now


def _product(one, other):
    """The (min, +) product of two 4 x 4 matrices as lists."""
    cell = lambda k: F.least(F.lit(FAR), F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda j: F.get(one, F.shiftleft(F.shiftright(k, 2), 2) + j) + F.get(other, j * 4 + k % 4),
    )))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(edits, summary): the cheapest edits that give every conversation the roles (system? (user assistant)+)?.

    Rows of a conversation are taken by turn (nulls first), then role and text; null roles and texts are one
    space. A row's first fault counts: blank (white space only), duplicate (role and text as in an earlier
    row), truncated (does not end in `.`, `!` or `?`). Keep costs 0 and needs a role whose first letter fits,
    Rerole to user or assistant 1, Delete 2, Insert of an empty row 5; blank and duplicate rows must be deleted,
    truncated ones cost 5 more unless they are. Of the cheapest edits those whose initials are the least in
    ASCII are taken: no two arcs of a node share an initial, so they are one path.

    `edits` has the columns of the input with the repaired role and text, `step` (bigint, from 0 in each
    conversation) and `edit` (D, I, K or R); inserted rows are null but for conversation, role and text, deleted
    rows are as they came. `summary` has per conversation conv_id, gaps, blank, duplicate, truncated, illegal
    (neighbours whose role initials are not su, ua or au), cost, audit and repaired_sha256 (of `role:text` lines).
    A null conv_id is a conversation too. Repeated rows are duplicates. Clashing columns give way. No rows, no rows.
    """
    rows = _numbered(conversations, conv_id, turn, role, text)
    lean = _blocks(rows, block)
    kinds = "key string, block bigint"
    costed = settle(lean.mapInArrow(_matrices, f"{kinds}, codes array<int>, costs array<bigint>, illegal bigint"))
    last = costed.agg(F.max("block")).first()[0] or 0
    edges = costed.groupBy("key").agg(F.max("block").alias("_last"))
    end = F.array(*[F.lit(int(c)).cast("bigint") for c in END_COST])
    if last:
        # Costs behind block b: the product of all later blocks, then the end.
        several = costed.join(edges.where("_last > 0"), "key").select("key", "block", "costs")
        behind = _doubled(several, "costs", _product, last, forward=True).where("block > 0").select("key", (F.col("block") - 1).alias("block"), F.col("costs").alias("_m"))
        costed = costed.join(behind, ["key", "block"], "left")
        cell = lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("_m", s * 4 + j) + F.get(end, j)))
        after = F.when(F.col("_m").isNull(), end).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), cell))
    else:
        after = end
    costed = costed.withColumn("end", after)
    through = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("costs", F.lit(EMPTY * 4) + j) + F.get("end", j))
    costed = costed.withColumn("total", F.array_min(through))
    paths = settle(costed.select("key", "block", "codes", "end").mapInArrow(
        _paths, f"{kinds}, audits array<string>, roles array<string>, exits array<int>"
    ))
    if last:
        onward = lambda later, earlier: F.transform(earlier, lambda s: F.get(later, s))
        reached = _doubled(paths.join(edges.where("_last > 0"), "key"), "exits", onward, last, forward=False)
        entry = reached.select("key", (F.col("block") + 1).alias("block"), F.get("exits", F.lit(EMPTY)).alias("_entry"))
        paths = paths.join(entry, ["key", "block"], "left")
    else:
        paths = paths.withColumn("_entry", F.lit(EMPTY))
    entry = F.coalesce("_entry", F.lit(EMPTY))
    leaves = F.get("exits", entry)
    tail = lambda values: F.when(F.col("block") == F.col("_last"), F.get(F.array(*[F.lit(v) for v in values]), leaves)).otherwise("")
    pieces = settle(paths.join(edges, "key").select(
        "key", "block", F.concat(F.get("audits", entry), tail(END_AUDIT)).alias("audit"),
        F.concat(F.get("roles", entry), tail(END_ROLES)).alias("roles"),
    ))
    steps = _steps(pieces, rows, block)
    kind = conversations.schema[position(conversations, conv_id)].dataType
    return _edits(steps, conversations, conv_id, role, text), _summary(rows, costed, pieces, steps, kind)


def _steps(pieces: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """One row per edit with the row it uses up: (key, step, edit, _to, and the row's columns)."""
    size = F.length("audit").cast("bigint")
    starts = _starts(pieces.select("key", "block", size.alias("n")))
    letters = F.arrays_zip(F.split("audit", "").alias("edit"), F.split("roles", "").alias("to"))
    # Rows used up before an edit, by doubling back from the string: inserts use none.
    flat = pieces.where(size > 0).select("key", "block", F.posexplode(letters).alias("k", "e"), "audit")
    used = F.length(F.translate(F.substring(F.col("audit"), F.lit(1), F.col("k")), "I", "")).cast("bigint")
    flat = flat.select("key", "block", "k", F.col("e.edit").alias("edit"), F.col("e.to").alias("_to"), (F.col("block") * block + used).alias("pos"))
    flat = flat.join(starts, ["key", "block"]).withColumn("step", F.col("start") + F.col("k")).drop("start", "k", "block")
    flat = flat.withColumn("pos", F.when(F.col("edit") == "I", -1 - F.col("step")).otherwise(F.col("pos")))
    return settle(flat.join(rows.drop("code", "digest"), ["key", "pos"], "left"))


def _starts(sizes: DataFrame) -> DataFrame:
    """How many edits lie before each block; the blocks of a conversation are doubled over, not gathered."""
    last = sizes.agg(F.max("block")).first()[0] or 0
    total = _doubled(sizes, "n", lambda one, other: one + other, last, forward=False)
    return total.withColumnRenamed("n", "_all").join(sizes, ["key", "block"]).select("key", "block", (F.col("_all") - F.col("n")).alias("start"))


def _names(role):
    """The role a letter stands for."""
    return F.when(role == "u", "user").otherwise("assistant")


def _edits(steps: DataFrame, conversations: DataFrame, conv_id: str, role: str, text: str) -> DataFrame:
    """The edits with the input's columns."""
    conv, said, words = (position(conversations, n) for n in (conv_id, role, text))
    kind = conversations.schema[conv].dataType
    written = F.col("edit").isin("R", "I")
    names = conversations.columns
    return unpack(
        steps, names, step=F.col("step"), edit=F.col("edit"), replaced={
            names[conv]: F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)),
            names[said]: F.when(written, _names(F.col("_to"))).otherwise(F.col(f"row.c{said}")),
            names[words]: F.when(F.col("edit") == "I", "").otherwise(F.col(f"row.c{words}")),
        },
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line) in order to (key, sha256) of each key's lines; a key's lines pass by and are not held."""
    key, digest = None, None
    for batch in batches:
        keys, lines = (batch.column(k).to_pylist() for k in (0, 1))
        done = []
        for own, line in zip(keys, lines):
            if own != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["key", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "sha"])


def _summary(rows: DataFrame, costed: DataFrame, pieces: DataFrame, steps: DataFrame, kind) -> DataFrame:
    turns = rows.where("_turn IS NOT NULL").select("key", "_turn").distinct()
    gaps = turns.groupBy("key").agg((F.max("_turn") - F.min("_turn") + 1 - F.count(F.lit(1))).cast("bigint").alias("gaps"))
    faults = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}

    def times(fault: int):
        return F.sum(F.size(F.filter("codes", lambda c: c.bitwiseAND(3) == fault)))

    counted = costed.groupBy("key").agg(
        *[times(fault).alias(name) for name, fault in faults.items()],
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("total"))).alias("cost"),
    )
    audits = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("p"))
    audits = audits.select("key", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    role = F.when(F.col("edit").isin("R", "I"), _names(F.col("_to"))).otherwise(F.col("_role"))
    lines = steps.where("edit <> 'D'").select("key", "step", F.concat(role, F.lit(":"), F.coalesce("_text", F.lit(""))).alias("line"))
    # SHA-256 reads a conversation from its first line to its last, so one task streams it whatever its length.
    ordered = lines.repartition("key").sortWithinPartitions("key", "step").select("key", "line")
    hashes = ordered.mapInArrow(_hashed, "key string, sha string")
    out = counted.join(gaps, "key", "left").join(audits, "key", "left").join(hashes, "key", "left")
    return out.select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias("conv_id"),
        F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
