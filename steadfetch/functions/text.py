"""Text rules as Column functions.

Whitespace and word characters follow Unicode; Java's own \\s and \\w are ASCII
only, so the classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HEDGE_WORDS, OUTPUT_LABELS

# Unicode whitespace, line ends, and what is neither word nor space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# One table lookup decides for Latin text; the rest is looked at only past U+167F.
SPACE = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
NOT_SPACE = (
    r"[!-\x84[\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e"
    r"\u2060-\u2fff\u3001-\x{10ffff}\x00-\x08\x0e-\x1b]]"
)
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_" + SPACE + "]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def bind(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The text cut at whitespace, without empty parts."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def word_runs(text: Column, size: int) -> Column:
    """The text cut into pieces of `size` words, the last one shorter; one pass over it."""
    run = f"(?:{NOT_SPACE}++{SPACE}++){{0,{size - 1}}}+{NOT_SPACE}++"
    return F.regexp_extract_all(strip(text), F.lit(run), F.lit(0))


def has_words(text: Column, n: int) -> Column:
    """The text has at least `n` words; looks no further than the n-th."""
    if n <= 0:
        return F.lit(True)
    return text.rlike(f"^{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{n - 1}}}{NOT_SPACE}")


def squeeze(text: Column) -> Column:
    """Every run of whitespace turned to one space."""
    return F.regexp_replace(text, SPACE + "+", " ")


def _first_line(text: Column, skip_prefix: str | None = None) -> Column:
    lines = F.transform(F.split(text, LINE_END), strip)
    if skip_prefix is None:
        kept = F.filter(lines, lambda x: x != "")
    else:
        kept = F.filter(lines, lambda x: (x != "") & ~x.startswith(skip_prefix))
    return F.get(kept, 0)


def clean_output(text: Column) -> Column:
    """Model output without its label: the first line that is not blank."""
    label = "(?i)^(" + "|".join(OUTPUT_LABELS) + ")" + SPACE + "*:" + SPACE + "*"
    bare = F.regexp_replace(strip(text), label, "")
    return F.coalesce(_first_line(bare), bare)


def strip_reasoning_block(text: Column) -> Column:
    """First line after the reasoning block; empty when the block never ends."""
    without = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    at = F.instr(text, "</think>")
    body = (
        F.when(without != text, without)
        .when(at > 0, F.substr(text, at + F.lit(len("</think>"))))
        .when(F.contains(text, F.lit("<think>")), F.lit(""))
        .otherwise(text)
    )
    return F.coalesce(_first_line(body, "<think>"), strip(body))


def salvage_answer(text: Column) -> Column:
    """The answer after the reasoning; of a cut-off reasoning its last two sentences."""
    close_at = F.instr(text, "</think>")
    open_at = F.instr(text, "<think>")
    before = strip(F.substr(text, F.lit(1), F.greatest(open_at - 1, F.lit(0))))
    inside = strip(F.substr(text, open_at + F.lit(len("<think>"))))
    sentences = F.filter(
        F.transform(F.split(inside, "(?<=[.!?])" + SPACE + "+"), strip), lambda s: s != ""
    )
    tail = F.array_join(F.slice(sentences, F.greatest(F.size(sentences) - 1, F.lit(1)), 2), " ")
    return (
        F.when(close_at > 0, strip(F.substr(text, close_at + F.lit(len("</think>")))))
        .when((open_at > 0) & (before != ""), before)
        .when(open_at > 0, tail)
        .otherwise(strip(text))
    )


def leaks(text: Column, avoid_terms: Column) -> Column:
    """An answer of three or more characters occurs in the text, in any case."""
    terms = F.filter(F.transform(avoid_terms, lambda a: F.lower(strip(a))), lambda a: F.length(a) >= 3)
    hit = bind(F.lower(text), lambda low: F.exists(terms, lambda a: F.contains(low, a)))
    return F.coalesce(hit, F.lit(False))


def is_hedged(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?iU)\b(" + "|".join(HEDGE_WORDS) + r")\b")


def simple_norm(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 turned to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _simple_tokens(text: Column) -> Column:
    return F.split(simple_norm(text), " ")


def holds_belief(text: Column, belief: Column) -> Column:
    """Every belief token of two or more characters is a word of the text."""
    needed = F.filter(_simple_tokens(belief), lambda t: F.length(t) >= 2)
    missing = F.array_except(needed, _simple_tokens(text))
    return (F.size(needed) > 0) & (F.size(missing) == 0)


def new_token_count(text: Column, question: Column) -> Column:
    """Tokens of three or more characters that the question lacks; repeats count."""
    tokens = F.filter(_simple_tokens(text), lambda t: F.length(t) >= 3)
    fresh = bind(
        _simple_tokens(question), lambda known: F.filter(tokens, lambda t: ~F.array_contains(known, t))
    )
    return F.size(fresh)


def too_similar(text: Column, question: Column) -> Column:
    return new_token_count(text, question) < 4


def is_valid_rewrite(
    text: Column, ptype: Column, question: Column, belief: Column, avoid_terms: Column
) -> Column:
    """The composite check on a rewrite."""
    plain = ~is_hedged(text) & ~too_similar(text, question)
    by_type = (
        F.when(ptype == 3, F.lit(True))
        .when(ptype == 1, plain & holds_belief(text, belief))
        .otherwise(plain)
    )
    return (F.coalesce(text, F.lit("")) != "") & ~leaks(text, avoid_terms) & by_type


def entity_like(text: Column) -> Column:
    """Short capitalised name: 3 to 40 letters, quotes, dashes, dots; at most 5 words."""
    bare = strip(text)
    return (
        F.length(bare).between(3, 40)
        & bare.rlike(r"^[A-Z]")
        & bare.rlike(r"^[A-Za-z'\-. ]+$")
        & (F.size(words(bare)) <= 5)
    )


def answer_norm(text: Column) -> Column:
    """Lower case, punctuation to spaces, articles dropped, spaces squeezed."""
    spaced = F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, " ")
    return F.array_join(F.filter(words(spaced), lambda w: ~w.isin("a", "an", "the")), " ")


def exact_match_any(prediction: Column, golds: Column) -> Column:
    """The normalised prediction equals a normalised gold; `unknown` never does."""
    normal = F.transform(golds, answer_norm)
    hit = bind(
        answer_norm(prediction),
        lambda pred: (pred != "") & (pred != "unknown") & F.coalesce(F.array_contains(normal, pred), F.lit(False)),
    )
    return F.coalesce(hit, F.lit(False))


def answer_matches(prediction: Column, golds: Column) -> Column:
    """A gold longer than two characters is in the prediction, or the other way round."""
    bare = F.filter(F.transform(golds, lambda g: strip(F.lower(g))), lambda g: F.length(g) > 2)
    hit = bind(
        F.rtrim(strip(F.lower(prediction)), F.lit(".")),
        lambda pred: F.exists(
            bare, lambda g: F.contains(pred, g) | ((F.length(pred) > 3) & F.contains(g, pred))
        ),
    )
    return F.coalesce(hit, F.lit(False))


def mentions_word(text: Column, term: Column) -> Column:
    """`term` occurs in the text between word bounds, in any case.

    The per-row pattern is only compiled for rows that hold the term at all.
    """
    low, want = F.lower(F.coalesce(text, F.lit(""))), F.lower(term)
    pattern = F.concat(F.lit(r"(?U)\b\Q"), want, F.lit(r"\E\b"))
    return F.when(F.contains(low, want), F.regexp_like(low, pattern)).otherwise(F.lit(False))


def golds_of(all_answers: Column, correct_answer: Column) -> Column:
    """All answers, else the one correct answer, without empty ones."""
    chosen = F.when(F.size(F.coalesce(all_answers, F.array().cast("array<string>"))) > 0, all_answers)
    return F.filter(F.coalesce(chosen, F.array(correct_answer)), lambda g: g.isNotNull() & (g != ""))
