"""The whole pipeline on a small table against a plain chain of the same rules."""

import re
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from steadfetch.llm import pii, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    draw = Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n))


def documents():
    rows = []
    for k in range(24):
        text = prose(k, 60 + 7 * k)
        if k % 4 == 0:
            text += f" write to person{k}@mail.example.org today"
        rows.append((k, text, "en", ["s1", "s2", None][k % 3]))
    rows += [(100 + k, rows[5][1], "en", "s1") for k in range(6)]  # exact copies
    words = rows[7][1].split(" ")
    rows.append((200, " ".join([*words[:50], "changed", *words[51:]]), "en", "s2"))  # a near copy
    rows += [(300, "too short", "en", "s1"), (301, "a b c " * 60, "en", "s1"), (302, "", "en", "s2"), (303, None, "en", None)]
    rows.append((None, prose(999, 80), None, "s2"))
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def alike(one, other):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one.split(), other.split()))
    return len(a & b) >= 0.8 * len(a | b)


def redacted(text):
    out, at = "", 0
    for a, b, kind in sorted((a, b, pii.KINDS[k]) for k, a, b in pii.base_spans(text)):
        out, at = out + text[at:a] + f"[{kind}]", b
    return out + text[at:]


def targets(sizes):
    """Source to words: shares by weight 5, 2, 1, none above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out, free = dict(zip(order, [5, 2, 1])), {}, set(order)
    while free:
        level = (sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        out.update({s: 3 * sizes[s] if s in over else level * weight[s] for s in over or free})
        free = free - over if over else set()
    return out


def test_pipeline(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    kept = [r for r in rows if good(r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    alone = []
    for r in kept:
        if not any(alike(r[1], other[1]) for other in alone):
            alone.append(r)
    assert {r[0] for r in alone} == {*range(24), None}
    clean = {r[0]: (redacted(r[1]), r[3]) for r in alone}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), left in zip(corpus_pipeline.STAGES[:3], (kept, alone, alone)):
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        want = {(r[0], clean[r[0]][0] if name == "personal_data" else r[1]) for r in left}
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want), name

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(queries.tokenizer_path())
    copies, sequences = Counter(), defaultdict(list)
    for r in pieces:
        ids = plain.encode(clean[r["doc_id"]][0], add_special_tokens=False).ids + [2]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
        copies[r["doc_id"]] += r["start"] == 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        ends = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096

    # Copies of a source's documents come to its target, but for the one that the target cuts.
    size = {d: len(t.split()) for d, (t, _) in clean.items()}
    by_source = defaultdict(list)
    for d, (_, source) in clean.items():
        by_source[source].append(d)
    aims = targets({s: sum(size[d] for d in ids) for s, ids in by_source.items()})
    for source, ids in by_source.items():
        taken = sum(copies[d] * size[d] for d in ids)
        assert abs(taken - aims[source]) <= max(size[d] for d in ids)
        times = [copies[d] for d in ids]
        assert max(times) - min(times) <= 1 and max(times) <= 3


def test_packed_sequences_hold_their_ids(spark):
    rows = [(r[0], r[1]) for r in documents()[:3]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = Tokenizer.from_file(queries.tokenizer_path())
    for r in corpus_pipeline.pack_sequences(spark, df, "").collect():
        ids = plain.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert bytes(r["ids"]) == np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()


def test_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
