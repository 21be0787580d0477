"""Decontamination, collocations and conversation repair against brute force on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfetch.llm import collocations, decontaminate, fmindex, structure

SCHEMA = "doc_id bigint, text string, lang string, `key` string, `Row` int, spans string, slice int, n_words string"


def extra(doc_id, text, lang="en"):
    return (doc_id, text, lang, "k", 1, "s", 2, "n")


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        docs = int(rng.integers(1, 6))
        lengths = rng.integers(0, 40, docs)
        most = int(rng.integers(1, 5))
        words = rng.integers(1, most + 1, lengths.sum())
        index = fmindex.Index.load(fmindex.Index.build(words, lengths, most).columns())
        text = np.zeros(len(words) + docs, int)
        inside = np.ones(len(text), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        text[inside] = words
        sizes = rng.integers(1, 5, 20)
        phrases = np.array([[0] * (4 - n) + rng.integers(1, most + 1, n).tolist() for n in sizes])
        got = {pair for phrase, at in index.occurrences(*index.search(phrases, sizes)) for pair in zip(phrase.tolist(), at.tolist())}
        assert got == {
            (k, i) for k, n in enumerate(sizes) for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k][4 - n :]).all()
        }


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(texts, items, window):
    phrases = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases[tuple(w[i : i + window])].add(item)
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out.append((len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return out


PASSAGE = "Alpha beta gamma, delta; epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    ("7", PASSAGE), ("10", PASSAGE + " nu"), ("2", "één tiny item"), ("3", None), ("4", ""), ("5", " .,; "), ("7", PASSAGE),
    (None, "nameless item here"), ("8", "word word word"),
]
TEXTS = [
    "Before " + PASSAGE.upper() + " after", PASSAGE, "beta gamma", None, "", "--", "word " * 40, "x1 ÉÉN één Tiny item! één tiny item",
    "a nameless item here", PASSAGE, "tail " * 25 + PASSAGE + " nu " + "rest " * 30, "y" * 70_000, "É" * 3 + " word word\x00word",
]


@pytest.mark.parametrize("shard_words", [12, 64, 1 << 19])
def test_decontamination(spark, shard_words):
    docs = spark.createDataFrame([extra(k if k != 9 else 1, t) for k, t in enumerate(TEXTS)] + [extra(None, TEXTS[0])], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id string, text string, phrase string")
    found = decontaminate.find(docs, bench, shard_words=shard_words)
    got = sorted(
        (str(r["doc_id"]), r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["start"] + s["length"])], r["items"]) for r in found.collect()
    )
    brute = brute_hits([*TEXTS, TEXTS[0]], ITEMS, 10)
    ids = [*["1" if k == 9 else str(k) for k in range(len(TEXTS))], "None"]
    assert got == sorted((i, *b) for i, b in zip(ids, brute))
    assert all(r["n_hit"] == sum(s["length"] for s in r["spans"]) for r in found.collect())
    clean = {(r["doc_id"], r["text"]) for r in decontaminate.cleaned(docs, found).collect()}
    assert decontaminate.cleaned(docs, found).columns == docs.columns
    assert {(0, "Before  after"), (2, "beta gamma"), (3, None), (1, ""), (8, "a "), (None, "Before  after")} <= clean


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([extra(1, PASSAGE)], SCHEMA)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    none = decontaminate.find(docs, bench.where("false")).collect()
    assert [(r["n_words"], r["n_hit"], r["spans"], r["items"]) for r in none] == [(12, 0, [], [])]
    assert decontaminate.find(docs.where("false"), bench).collect() == []


def test_an_index_serves_other_benchmarks(spark):
    docs = spark.createDataFrame([extra(1, PASSAGE), extra(2, "one two three four")], SCHEMA)
    index = decontaminate.index(docs)
    for text, hits in ((PASSAGE, {1: 12, 2: 0}), ("two three", {1: 0, 2: 2})):
        bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.find(docs, bench, indexed=index).collect()} == hits


def brute_collocations(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= 50 * a for q, b in f.items() if len(q) == 3 > len(p) and b >= least and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rng = random.Random(2)
    names = ["of", "the", "new", "york", "city", "São", "paulo", "a\x00b", "Ab", "x"] + [f"w{k}" for k in range(30)]
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), " ".join(
        rng.choice(["new york city", "of the", "São paulo", rng.choice(names), rng.choice(names) + rng.choice([".", ",", "\n", "\t"])]) for _ in range(rng.randint(0, 80))
    )) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("fr", " \t\n"), ("de", "tie tie " * 20), ("de", "tie tie " * 20), ("xx", "rare words"), ("en", "long " * 30_000)]
    docs = spark.createDataFrame([extra(k, text, lang) for k, (lang, text) in enumerate(rows)], SCHEMA).repartition(7)
    for fan_in in (2, 128):
        # Many slices and groups of two: several rounds of partial tiles.
        monkeypatch.setattr(collocations, "FAN_IN", fan_in)
        got = sorted(tuple(r) for r in collocations.mine(docs, least=5, top=40).collect())
        assert got == brute_collocations(rows, 5, 40)
    assert collocations.mine(docs.where("false")).collect() == []
    assert collocations.mine(docs.where("text is null")).collect() == []


def test_large_counts_are_exact(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a bigint, l bigint, r bigint")
    assert df.select(collocations.score("a", "l", "r").alias("s")).first()[0] == 10**6 * big * big // ((big + 1) * (big + 2))


def brute_repair(rows):
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def least(i, state, inserts):
        """(cost, audit, lines) of the best way on; at most two inserts in a row."""
        ways = [(0, "", ())] if i == len(rows) and state in "ea" else []
        role = "a" if state == "u" else "u"
        name = "user" if role == "u" else "assistant"
        if inserts < 2:
            cost, audit, lines = least(i, role, inserts + 1)
            ways.append((cost + 5, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            _, _, own, text = rows[i]
            cost, audit, lines = least(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                cost, audit, lines = least(i + 1, role, 0)
                ways.append((cost + 1 + more, "R" + audit, (f"{name}:{text}", *lines)))
                if own[:1] == role or own[:1] == "s" and state == "e":
                    cost, audit, lines = least(i + 1, own[0], 0)
                    ways.append((cost + more, "K" + audit, (f"{own}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = least(0, "e", 0)
    turns = [t for known, t, _, _ in rows if known]
    initials = [r[:1] for _, _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    ), lines


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["a.", "b!", "c", "d?", " ", "", None, f"x{t}.", f"y{t}", f"z{t}. \n", "w" * 50_000 if conv == 3 else "v."])
            rows.append((conv, rng.choice([t, t, t, None, t + 3]), role, text))
    return rows


@pytest.mark.parametrize("block", [3, 8, 1024])
def test_repair(spark, talks, block):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in talks], "conv_id bigint, turn bigint, role string, text string, `key` string, step int, `Block` string")
    edits, summary = structure.repair(df.repartition(4), block=block)
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[f] for f in fields) for r in summary.collect()}
    by = defaultdict(list)
    for conv, *row in talks:
        by[conv].append(row)
    want = {conv: brute_repair(rows) for conv, rows in by.items()}
    assert got == {conv: w[0] for conv, w in want.items()}
    lines = defaultdict(list)
    for r in edits.orderBy("step").collect():
        if r["edit"] != "D":
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {k: tuple(v) for k, v in lines.items()} == {conv: w[1] for conv, w in want.items() if w[1]}
    assert "Block" in edits.columns and "step" in edits.columns


def test_repair_of_nothing_and_of_one_long_conversation(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    edits, summary = structure.repair(none)
    assert edits.collect() == [] and summary.collect() == []
    rows = [("c", t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(400)]
    _, summary = structure.repair(spark.createDataFrame(rows, none.schema), block=16)
    assert [(r["conv_id"], r["cost"], r["audit"]) for r in summary.collect()] == [("c", 4, "D" + "K" * 398 + "D")]
