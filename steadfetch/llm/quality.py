"""Quality rules: counts per text, and line frequency across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .frames import pack, unpack

# What separates words, what a word is made of, and which characters count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
# A host's lines are gathered in so many parts, so that no task holds those of a large host.
PARTS = 512


def words(text: Column) -> Column:
    """The text's words in order: runs of characters other than space and \\t to \\r."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    # Only a separator at either end leaves an empty part.
    return F.array_remove(parts, "")


def lines(text: Column) -> Column:
    """The lines with a word, in order."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(IN_WORD))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words inside 3-word windows whose hash (`_triples`) occurs twice or more.

    Sort (hash, place), keep places with an equal neighbour, and add up how far each window reaches
    beyond the one before it: n log n for a text of n words. Each array is a column of its own, so
    that the functions over it do not build it anew for every element.
    """
    repeats = F.size(F.array_distinct("_triples")) < F.size("_triples")
    pairs = F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_pairs", i)["h"], F.lit(False))
    twice = F.filter("_pairs", lambda x, i: same(x, i - 1) | same(x, i + 1))
    reach = F.transform("_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(3)), F.lit(3)))
    added = F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, n: total + n)
    return (
        # Few texts repeat a window; only those are sorted.
        df.withColumn("_pairs", F.when(repeats, pairs))
        .withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
        .withColumn("n_repeat_words", F.coalesce(added, F.lit(0)).cast("bigint"))
        .drop("_pairs", "_places")
    )


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of column `text`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_words", words(F.col(text)))
    n = F.size("_words")
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # The last two windows are not whole.
    triples = F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    out = out.withColumn("_triples", F.slice(triples, 1, F.greatest(n - 2, F.lit(0))))
    out = out.withColumn("_lines", lines(whole))
    out = out.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    })
    return _with_repeats(out).drop("_words", "_hashes", "_triples", "_lines")


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single blanks and digits made alike."""
    zeros = F.regexp_replace(F.lower(F.trim(line)), "[1-9]", "0")
    # Single blanks, most of all, are what they are to become.
    return F.xxhash64(F.regexp_replace(zeros, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def _line_keys(text: Column) -> Column:
    """The keys of the lines with a word, in order."""
    return F.transform(lines(text), line_key)


def frequent_lines(df: DataFrame, host: str, text: str, least_docs: int, most_share: float) -> DataFrame:
    """Per host the keys of lines that are in more distinct documents than allowed.

    A line may be in `least_docs` documents, or in the share `most_share` of the host's distinct
    documents if that is more. Documents are the same if the sets of their line keys are, so exact
    copies count once, however many there are, and lines that recur together do not hide one another.
    Near copies that differ in a line's key are distinct and each count. A host can have few lines
    above its limit (lines per document / `most_share`, or its lines / `least_docs`), so one array
    per host holds them.
    """
    docs = df.select(F.col(host).alias("host"), F.sort_array(F.array_distinct(_line_keys(F.col(text)))).alias("lines"))
    # Spark would test for empty arrays below, and build every array once more for that.
    found = docs.distinct().select("host", F.posexplode_outer("lines").alias("place", "line")).where("line IS NOT NULL")
    # A distinct document is counted at its smallest key.
    per_line = found.groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") == 0).alias("own")
    )
    many = F.when(F.col("n") > least_docs, F.struct("line", "n"))
    parts = settle(
        per_line.groupBy("host", F.pmod("line", F.lit(PARTS)).alias("part"))
        .agg(F.sum("own").alias("docs"), F.collect_list(many).alias("many"))
    )
    per_host = parts.groupBy("host").agg(F.sum("docs").alias("docs"))
    limit = F.greatest(F.lit(float(least_docs)), F.lit(most_share) * F.col("docs"))
    often = parts.select("host", F.explode("many").alias("m")).select("host", "m.line", "m.n")
    above = often.join(per_host, "host").where(F.col("n") > limit)
    return above.groupBy("host").agg(F.collect_set("line").alias("frequent"))


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 50, most_repeated: float = 0.5,
    least_docs: int = 20, most_share: float = 0.02, min_left: int = 20, min_left_share: float = 0.3,
) -> DataFrame:
    """All columns of `docs` with counts, verdicts and `clean_text`, the text without frequent lines.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; `base_failed` (fewer than
    `min_words` words, or a share above `most_repeated` of them in 3-word windows that the text
    repeats); `n_left` (words outside frequent lines); `kept` (not failed, and at least `min_left`
    words and the share `min_left_share` of its words left); `clean_text`.

    A null text has no words and fails; its clean_text is null. Documents with a null host form a
    host of their own. Equal rows get equal verdicts. Columns of `docs` named like an added one
    are replaced. An empty table gives an empty result.
    """
    packed = pack(docs, _text=text, _host=host).withColumn("_at", F.xxhash64(F.coalesce(F.col("_host").cast("string"), F.lit("\x00"))))
    frequent = settle(frequent_lines(packed, "_at", "_text", least_docs, most_share))
    # One small row per host; Spark broadcasts the table only where its files are small enough.
    rows = packed.join(frequent.withColumnRenamed("host", "_at"), "_at", "left")
    rows = text_counts(rows, "_text")
    gone = lambda line: F.coalesce(F.array_contains("frequent", line_key(line)), F.lit(False))
    clean = F.when(F.col("frequent").isNull(), F.col("_text")).otherwise(
        F.array_join(F.filter(F.split("_text", "\n"), lambda line: ~gone(line)), "\n")
    )
    # Only the lines that go are cut into words again.
    lost = F.aggregate(
        F.filter(lines(F.coalesce("_text", F.lit(""))), gone), F.lit(0), lambda total, line: total + F.size(words(line))
    )
    left = F.col("n_words") - F.when(F.col("frequent").isNull(), 0).otherwise(lost)
    rows = rows.withColumn("clean_text", clean)
    rows = rows.withColumns({
        "n_left": left.cast("bigint"),
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words")),
    })
    enough = (F.col("n_left") >= min_left) & (F.col("n_left") >= min_left_share * F.col("n_words"))
    return unpack(
        rows, docs.columns,
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")},
        n_left=F.col("n_left"), kept=~F.col("base_failed") & enough, clean_text=F.col("clean_text"),
    )
