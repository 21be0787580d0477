"""Personal data: fixed shapes, and unseen identifiers that stand in the same contexts.

Emails, addresses, cards and phone numbers are found by their shape. They seed a bootstrap: the words
around them are lexical patterns, patterns and the strings in their slots form a graph, and Spark
scores both sides in turns. Where nearly all that a pattern ever surrounds is known or likely personal
data, an identifier of another shape in its slot is reported as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .frames import pack, unpack

# The kinds and their shapes.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGES = ".,;:!?()[]{}<>\"'`*#$%&|=/\\_-"

_DIGIT = re.compile("[0-9]")
_SPACES = " \t\n\x0b\x0c\r"
# Characters on either side in which the words around a span are looked for.
NEAR = 80
# Patterns that are counted in one pass over the corpus (8 bytes each in every task).
AT_ONCE = 1 << 20

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if place % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: an address begins where the run of allowed characters before an @ begins."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points; matches that fail their test are dropped."""
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def _identifiers(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with two digits or more and four letters or digits or more, apart from spans already taken."""
    busy = sorted((a, b) for _, a, b in taken)
    at, k, furthest = 0, 0, -1
    while found := _DIGIT.search(text, at):
        start = end = found.start()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        at = end
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while k < len(busy) and busy[k][0] < end:
            furthest = max(furthest, busy[k][1])
            k += 1
        word = text[start:end]
        if furthest <= start and sum(c.isalnum() for c in word) >= 4 and sum(c.isdigit() for c in word) >= 2:
            yield start, end


def _normal(word: str) -> str:
    return word.lower().strip(EDGES)


def _pattern(kind: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The 64-bit number of a pattern from the hashes of its two words."""
    with np.errstate(over="ignore"):
        mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind + 1)
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _words(text: str) -> list[str]:
    return [w for w in map(_normal, re.split(r"[\x20\x09-\x0D]+", text)) if w]


def _contexts(text: str, start: int, end: int) -> list[int]:
    """The patterns of a slot: two words before it (0), or one before and one after it (1)."""
    hashed = lambda w: np.array([xxhash.xxh3_64_intdigest(w)], np.uint64)
    before, after = _words(text[max(0, start - NEAR) : start])[-2:], _words(text[end : end + NEAR])[:1]
    pairs = ([(0, *before)] if len(before) == 2 else []) + ([(1, before[-1], after[0])] if before and after else [])
    return [int(_pattern(kind, hashed(a), hashed(b))[0]) for kind, a, b in pairs]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text key, text) to the slots of spans and identifiers with their patterns."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            spans = base_spans(text)
            found = [(True, a, b) for _, a, b in spans] + [(False, a, b) for a, b in _identifiers(text, spans)]
            for seed, a, b in found:
                instance = xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63)
                rows += [(key, a, b, seed, instance, c) for c in _contexts(text, a, b)]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "start", "end", "seed", "instance", "pattern"]
        )


def _occurrences(patterns: np.ndarray):
    """Counts how often each of the given patterns (sorted) surrounds any word at all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(patterns), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for found in _all_patterns(batch.column(0).slice(begin, 256)):
                    at = np.minimum(np.searchsorted(patterns, found), len(patterns) - 1)
                    counts += np.bincount(at[patterns[at] == found], minlength=len(patterns))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(patterns[seen]), pa.array(counts[seen])], names=["pattern", "total"])

    return run


def _all_patterns(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of all patterns around any word of the texts."""
    split = pc.ascii_split_whitespace(pc.utf8_trim(texts, characters=_SPACES))
    doc = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    plain = [_normal(w) for w in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in plain], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        return []
    # Words of punctuation alone are no context, as at the slots.
    full = np.array([bool(w) for w in plain])[codes]
    doc, words = doc[full], hashes[codes[full]]
    out = []
    for kind, step in ((0, 1), (1, 2)):
        same = doc[:-step] == doc[step:]
        out.append(_pattern(kind, words[:-step][same], words[step:][same]))
    return out


def _bootstrap(texts: DataFrame, min_support: int, least: float, rounds: int) -> DataFrame:
    """(node, start, end) of identifiers that high-confidence patterns surround."""
    slots = settle(texts.mapInArrow(_slots, "node binary, start bigint, end bigint, seed boolean, instance bigint, pattern bigint"))
    support = slots.where("seed").groupBy("pattern").agg(F.countDistinct("instance").alias("support"))
    patterns = settle(support.where(F.col("support") >= min_support).select("pattern"))
    # Patterns that only surround seeds discover nothing.
    open_ones = slots.where("NOT seed").select("pattern").distinct()
    patterns = settle(patterns.join(open_ones, "pattern", "left_semi"))
    edges = (
        slots.join(patterns, "pattern", "left_semi").groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    )
    edges = settle(edges.join(_totals(texts, patterns), "pattern"))
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        confidence = _confidence(edges, scores)
        likely = edges.join(confidence, "pattern").groupBy("instance").agg(
            F.max("seed").alias("seed"), F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))).alias("log_not")
        )
        scores = settle(likely.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("log_not")).alias("score")))
    sure = _confidence(edges, scores).where(F.col("confidence") >= least).select("pattern")
    good = scores.where(F.col("score") >= least).select("instance")
    found = slots.where("NOT seed").join(sure, "pattern", "left_semi").join(good, "instance", "left_semi")
    return found.select("node", "start", "end").distinct()


def _confidence(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Per pattern the expected share of personal data among all words that it surrounds."""
    scored = edges.join(scores, "instance")
    return scored.groupBy("pattern").agg(
        (F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence")
    )


def _totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern surrounds any word: passes over the corpus with a bounded number of patterns each."""
    spark = texts.sparkSession
    blocks = -(-patterns.count() // AT_ONCE)
    out = spark.createDataFrame([], "pattern bigint, total bigint")
    for k in range(blocks):
        some = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).toArrow()["pattern"].to_numpy()
        out = out.unionByName(texts.select("text").mapInArrow(_occurrences(np.sort(some)), "pattern bigint, total bigint"))
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def _base_udf() -> Column:
    @F.pandas_udf(SPAN)
    def base(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in base_spans(t)])

    return base


def find(
    docs: DataFrame, text: str = "text", min_support: int = 5, least: float = 0.8, rounds: int = 3
) -> DataFrame:
    """All columns of `docs` with `base_spans` and `spans`, arrays of (kind, start, end).

    `base_spans` are the spans of the four fixed shapes by kind (email, ip, card, phone), then start,
    in code points with the end exclusive. `spans` adds identifiers (kind id): words with digits in the
    slot of a pattern that at least `min_support` different seeds induce and whose confidence reaches
    `least` after `rounds` rounds. A pattern's confidence is the expected share of personal data among
    all words in its slot anywhere in the corpus; an identifier's score is the chance that any of its
    patterns is right. So chance contexts of common words, which mostly surround other words, never
    become confident.

    Equal texts count once. A null or empty text has no spans (an empty array). Added columns replace
    ones of the same name. An empty table gives an empty result.
    """
    packed = pack(docs, text=text).withColumn("node", F.unhex(F.md5("text")))
    texts = packed.where("text <> ''").select("node", "text")
    found = settle(_bootstrap(texts, min_support, least, rounds))
    one = F.struct(F.lit(KINDS[-1]).alias("kind"), "start", "end")
    added = settle(found.groupBy("node").agg(F.sort_array(F.collect_list(one)).alias("added")))
    rows = packed.join(added, "node", "left").withColumn("_base", _base_udf()(F.coalesce("text", F.lit(""))))
    whole = F.concat("_base", F.coalesce("added", F.array().cast(SPAN)))
    return unpack(rows, docs.columns, base_spans=F.col("_base"), spans=whole)


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    @F.pandas_udf("string")
    def replace(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, spans) -> str | None:
            if t is None or spans is None or not len(spans):
                return t
            out, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [t[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found)], dtype=object)

    return replace(text, spans)
