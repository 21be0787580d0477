"""Group completion over a stream: a query is emitted once all its slots are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOT_FIELDS = [
    "question", "correct_answer", "all_answers", "perturbation_type", "perturbation_text",
    "perturbed_query", "wrong_belief", "t2_variant", "topic", "is_empty",
]
OUTPUT = (
    "query_idx bigint, slot_idx int, question string, correct_answer string, all_answers array<string>, "
    "perturbation_type int, perturbation_text string, perturbed_query string, wrong_belief string, "
    "t2_variant string, topic string, is_empty boolean, is_complete boolean"
)


# Queries share a state by a hash of their id, so a batch has this many calls and states at most, not one per query.
BUCKETS = 1_024
# The slot of a query that has left: no slot, only a mark.
_LEFT = -1
_HELD = ["query_idx", "slot_idx", "payload", "until"]


def completed(
    rows: DataFrame, slots: int = 5, timeout_ms: int | None = None, event_time: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """All slots of a query in one go, when the last of them has arrived.

    State holds one JSON text per slot seen, so at most `slots` of a query. A slot delivered again before the
    emission is ignored. With `timeout_ms` a query that gets no more rows for that long leaves as it is, with
    is_complete false, and a query that has left keeps a mark for that long, so that late duplicates emit
    nothing and open no state; marks expire. Time is the clock's, or that of column `event_time`, which must have
    a watermark: then the outcome does not depend on when batches run, and rows older than the watermark are
    dropped. Rows without a slot, under a query_idx of their own, only move the watermark. Without `timeout_ms` state goes away
    with the emission, and a late duplicate opens a group that never fills, so sinks go by (query_idx, slot_idx).

    The open queries of a bucket are handled together, in columns; a bucket is written again when a row of it comes.
    """
    payload = F.to_json(F.struct(*SLOT_FIELDS))
    at = F.col(event_time) if event_time else F.lit(None).cast("timestamp")
    # Queries without an id are one query, in a bucket of its own.
    bucket = F.when(F.col("query_idx").isNull(), _LEFT).otherwise(F.pmod(F.xxhash64("query_idx"), F.lit(buckets)).cast("int"))
    narrow = rows.select(
        bucket.alias("bucket"), F.coalesce("query_idx", F.lit(0)).cast("bigint").alias("query_idx"),
        F.col("slot_idx").cast("int").alias("slot_idx"), payload.alias("payload"), at.alias("at"),
        F.unix_millis(at).alias("at_ms"),
    )
    if event_time and not timeout_ms:
        raise ValueError("event time only serves timeouts; give timeout_ms")
    policy = (
        GroupStateTimeout.EventTimeTimeout if event_time
        else GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(_HELD, state.get)) if state.exists else {c: [] for c in _HELD})
        held = held.astype({"query_idx": "int64", "slot_idx": "int64", "payload": "object", "until": "int64"})
        now = 0
        if timeout_ms:
            now = state.getCurrentWatermarkMs() if event_time else state.getCurrentProcessingTimeMs()
        until = held.groupby("query_idx")["until"].max()
        touched = pd.Index([], dtype="int64")
        come = [] if state.hasTimedOut else [pdf for pdf in batches if len(pdf)]
        if come:
            new = pd.concat(come, ignore_index=True)
            latest = new.groupby("query_idx")["at_ms"].max()
            touched, ends = latest.index, 0
            if timeout_ms:
                ends = (latest.astype("int64") + timeout_ms).clip(lower=now + 1) if event_time else now + timeout_ms
            until = pd.concat([until.drop(touched, errors="ignore"), pd.Series(ends, index=touched, dtype="int64")])
            # Not left to a filter, which Spark would move below the watermark.
            new = new[new["slot_idx"].notna()].astype({"slot_idx": "int64"})
            held = pd.concat([held[_HELD[:3]], new[_HELD[:3]]], ignore_index=True).drop_duplicates(["query_idx", "slot_idx"])
        gone = pd.Index(held.loc[held["slot_idx"] == _LEFT, "query_idx"])
        marks = held["query_idx"].isin(gone)
        waiting, marks = held[~marks], held[marks & (held["slot_idx"] == _LEFT)]
        size = waiting.groupby("query_idx").size()
        full = size.index[size >= slots]
        late = until.index[(until < now) & ~until.index.isin(touched)] if timeout_ms else touched[:0]
        is_full, is_late = waiting["query_idx"].isin(full), waiting["query_idx"].isin(late)
        done = waiting[is_full | is_late]
        left = [waiting[~(is_full | is_late)], marks[~marks["query_idx"].isin(late)]]
        if timeout_ms:
            left.append(pd.DataFrame({"query_idx": full, "slot_idx": _LEFT, "payload": ""}))
        kept = pd.concat([part[_HELD[:3]] for part in left if len(part)]) if any(map(len, left)) else waiting[:0]
        if len(kept):
            ends = until.loc[kept["query_idx"]].to_numpy()
            state.update((*(kept[c].tolist() for c in _HELD[:3]), ends.tolist()))
            if event_time:
                state.setTimeoutTimestamp(max(int(ends.min()), now + 1))
            elif timeout_ms:
                # A state whose time is up leaves in the batch after it.
                state.setTimeoutDuration(max(int(ends.min()) - now, 1))
        elif state.exists:
            state.remove()
        if len(done):
            done = done.sort_values(["query_idx", "slot_idx"])
            yield pd.DataFrame({
                "query_idx": [None] * len(done) if key[0] == _LEFT else done["query_idx"].to_numpy(),
                "slot_idx": done["slot_idx"].to_numpy(), "payload": done["payload"].to_numpy(),
                "is_complete": done["query_idx"].isin(full).to_numpy(),
            })

    groups = narrow.groupBy("bucket").applyInPandasWithState(
        step, "query_idx bigint, slot_idx int, payload string, is_complete boolean",
        "queries array<bigint>, slots array<int>, payloads array<string>, untils array<bigint>", "append", policy,
    )
    parsed = F.from_json(
        "payload",
        "question string, correct_answer string, all_answers array<string>, perturbation_type int, "
        "perturbation_text string, perturbed_query string, wrong_belief string, t2_variant string, "
        "topic string, is_empty boolean",
    )
    return groups.withColumn("_p", parsed).select("query_idx", "slot_idx", "_p.*", "is_complete")
