"""Multi-party chat: every conversation from the perspective of each of its participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import running_start
from ..session import settle
from .frames import hashable, pack

# The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _segment(role: Column, name: Column, text: Column) -> Column:
    head = F.when(name.isNull(), role).otherwise(F.concat(role, F.lit(" name="), name))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), text, F.lit(CLOSE))


def perspectives(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """One row per (conversation, participant, turn): the turn as that participant's training example has it.

    For every speaker of a conversation but the `narrators` the dialogue is rendered with that speaker as
    assistant, other speakers as users under their names, and narrators as they are. Columns: conv_id,
    participant, turn, role, name (null but for users), segment (the
    rendered turn), char_start (where it begins in the dialogue; segments in this order make the
    dialogue), mask_start and mask_length (the characters to learn from: the participant's text and
    its end mark; length 0 on other turns).

    Turns are in the order of `turn`, equal ones by speaker and text; null turns come first. A null
    speaker is called "unknown", a null text is empty; turns with a null conversation form one of
    their own. A dialogue of narrators alone has no participant and no rows. Rows are numbered over
    ranges of all dialogues, so one dialogue may hold any share of the turns.
    """
    rows = pack(turns, conv_id=conversation, turn=turn, speaker=speaker, text=text)
    rows = rows.withColumn("_hash", hashable(rows)).select(
        "conv_id", "turn", F.coalesce(F.col("speaker").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"), "_hash",
    )
    # One row per speaker and conversation; spoken turns meet them by conversation.
    speakers = rows.select("conv_id", "speaker").distinct().where(~F.col("speaker").isin(list(narrators)))
    mine = speakers.groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("participants"))
    mine = settle(mine.withColumnRenamed("conv_id", "_c"))
    views = (
        rows.join(mine, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
        .withColumn("participant", F.explode("participants")).drop("participants")
    )
    own = F.col("speaker") == F.col("participant")
    narrated = F.col("speaker").isin(list(narrators))
    views = views.withColumn("_role", F.when(own, F.lit("assistant")).when(narrated, F.col("speaker")).otherwise(F.lit("user")))
    views = views.withColumn("name", F.when(F.col("_role") == "user", F.when(~own & ~narrated, F.col("speaker"))))
    views = views.withColumn("segment", _segment(F.col("_role"), F.col("name"), F.col("text")))
    views = views.withColumn("_any", F.monotonically_increasing_id())
    order = ["conv_id", "participant", "turn", "speaker", "text", "_hash", "_any"]
    numbered = running_start(views, [F.col(c) for c in order], F.length("segment").cast("bigint"), "_chars")
    return _in_dialogue(numbered, own)


def _in_dialogue(numbered: DataFrame, own: Column) -> DataFrame:
    """Offsets inside a dialogue are global ones less the dialogue's first."""
    firsts = numbered.groupBy("conv_id", "participant").agg(F.min("_chars").alias("_first"))
    firsts = firsts.withColumnsRenamed({"conv_id": "_c", "participant": "_p"})
    joined = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("participant") == F.col("_p")))
    start = F.col("_chars") - F.col("_first")
    head = F.length("segment") - F.length("text") - F.lit(len(CLOSE))
    return joined.select(
        "conv_id", "participant", "turn", F.col("_role").alias("role"), "name", "segment", start.alias("char_start"),
        (start + head).alias("mask_start"),
        F.when(own, F.length("text") + F.lit(len(CLOSE))).otherwise(F.lit(0)).cast("bigint").alias("mask_length"),
    )


def dialogues(views: DataFrame) -> DataFrame:
    """(conv_id, participant, dialogue, spans): whole dialogues, for conversations that fit in a row.

    `spans` lists (start, length) of what to learn from. Very long conversations should stay in the
    form of `perspectives`, which the same order puts together while reading.
    """
    part = F.struct("char_start", "segment", "mask_start", "mask_length")
    whole = views.groupBy("conv_id", "participant").agg(F.sort_array(F.collect_list(part)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask_length"] > 0), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_length"].alias("length")))
    return whole.select("conv_id", "participant", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("dialogue"), spans.alias("spans"))
