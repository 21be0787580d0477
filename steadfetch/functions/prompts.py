"""Default prompt texts. Every builder takes another text in their place.

Placeholders: {q} question, {avoid} correct answer, {wa} wrong belief,
{topic} distraction topic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REWRITE_SYSTEM = (
    "You restate questions in the voice of a person who holds a false belief. The "
    "restated question must still have the same answer. Reply with the question only."
)
FALSE_PREMISE = (
    "Restate the question so that it takes the wrong belief for granted and still asks "
    "for the same thing. Never write the correct answer, and no word that marks the "
    "belief as untrue.\nOriginal: {q}\nCorrect answer: {avoid}\nWrong belief: {wa}\nRewritten:"
)
FALSE_HISTORY = (
    "Restate the question so that it takes an untrue claim about time, history or "
    "existence for granted and still asks for the same thing. Never write the correct "
    "answer, and no word that marks the claim as untrue.\n"
    "Original: {q}\nCorrect answer: {avoid}\nRewritten:"
)
FALSE_QUANTITY = (
    "Restate the question so that it takes an untrue claim about an amount, a relation "
    "or a cause for granted and still asks for the same thing. Never write the correct "
    "answer, and no word that marks the claim as untrue.\n"
    "Original: {q}\nCorrect answer: {avoid}\nRewritten:"
)
DISTRACTION = (
    "Write one sentence on the given topic that has nothing to do with the question and "
    "does not hold its answer.\nQ: {q}\nCorrect answer: {avoid}\nTopic: {topic}\nSentence:"
)
REWRITE_TEMPLATES = {"1": FALSE_PREMISE, "2A": FALSE_HISTORY, "2B": FALSE_QUANTITY, "3": DISTRACTION}

TEACHER_SYSTEM = (
    "Use the context alone to answer. Reply with the shortest span that answers the "
    "question, or with unknown when the context does not hold the answer."
)
JUDGE_SYSTEM = (
    "Say whether the prediction means the same as one of the ground truths. Reply with "
    "yes or no."
)
ANSWER_SYSTEM = (
    "Answer from the evidence. Put the answer itself first; a remark on a false premise "
    "may follow."
)


def fill(template: str, **values: Column) -> Column:
    """`template` with each {name} put in by its column, in one pass over the text.

    The template is cut at its placeholders, so a value that itself looks like a
    placeholder stays as it is.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


def messages(system: str, user: Column) -> Column:
    """A chat of a system and a user message: array<struct<role, content>>."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", F.lit(system)), turn("user", user))
