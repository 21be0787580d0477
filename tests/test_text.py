import pytest
from pyspark.sql import functions as F

from steadfetch.functions import hashing, prompts, text


def one(spark, build, **values):
    """The value of a Column built over a single row of the given values."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(build(*[F.col(k) for k in values]).alias("v")).first()["v"]


def test_words_follow_unicode_whitespace(spark):
    raw = "  a b c\x1cd​e \n f　 "
    assert one(spark, text.words, t=raw) == raw.split()


@pytest.mark.parametrize("raw", ["", "   ", "w " * 450, " ".join(str(i) for i in range(400)), "x\n\ty" * 7])
def test_word_runs_equal_a_plain_loop(spark, raw):
    words = raw.split()
    expected = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
    got = one(spark, lambda t: F.transform(text.word_runs(t, 200), text.squeeze), t=raw)
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31])
def test_has_words(spark, n):
    assert one(spark, lambda t: text.has_words(t, 30), t=" ".join(["w"] * n)) == (n >= 30)


@pytest.mark.parametrize("raw, expected", [
    ("Rewritten:  who was it?\nmore", "who was it?"),
    ("\n\n answer : yes\n", "yes"),
    ("OUTPUT:", ""),
    ("   ", ""),
    ("Sentence:\n\n  a b ", "a b"),
    ("plain", "plain"),
])
def test_clean_output(spark, raw, expected):
    assert one(spark, text.clean_output, t=raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("<think>a\nb</think>\n the answer \nmore", "the answer"),
    ("a thought</think>\nthe answer", "the answer"),
    ("<think>cut off", ""),
    ("the answer", "the answer"),
    ("<think>a</think>\n<think>b\nc", "c"),
    ("<think>x</think>", ""),
])
def test_strip_reasoning_block(spark, raw, expected):
    assert one(spark, text.strip_reasoning_block, t=raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("<think>a</think> Paris. ", "Paris."),
    ("no tag at all ", "no tag at all"),
    ("a</think>b</think>c", "b</think>c"),
    (" Rome <think> and so", "Rome"),
    ("<think>", ""),
    ("<think> One.", "One."),
    ("<think>One. Two! Three? ", "Two! Three?"),
])
def test_salvage_answer(spark, raw, expected):
    assert one(spark, text.salvage_answer, t=raw) == expected


@pytest.mark.parametrize("body, terms, expected", [
    ("It was PARIS then", ["paris"], True),
    ("It was so", ["it"], False),
    ("it was so", ["  was "], True),
    ("nothing", [], False),
    ("nothing", ["", None, "thing"], True),
])
def test_leaks(spark, body, terms, expected):
    assert one(spark, text.leaks, t=body, a=terms) is expected


def test_hedges_are_whole_words(spark):
    assert one(spark, text.is_hedged, t="In Reality, no") is True
    assert one(spark, text.is_hedged, t="a falsehood, reallyy") is False


@pytest.mark.parametrize("body, belief, expected", [
    ("Since Elon Musk took over", "musk elon", True),
    ("Since Musket took over", "musk", False),
    ("anything", "a b", False),
    ("anything", "", False),
    ("the x ray", "x ray", True),
])
def test_holds_belief(spark, body, belief, expected):
    assert one(spark, text.holds_belief, t=body, w=belief) is expected


def test_new_tokens_count_repeats(spark):
    assert one(spark, text.new_token_count, t="new new new new what", q="what") == 4
    assert one(spark, text.too_similar, t="new new new what is", q="what") is True


@pytest.mark.parametrize("name, expected", [
    ("Elon Musk", True), (" Al ", False), ("Al B", True), ("X" * 41, False), ("A1b", False), ("elon", False),
    ("O'Neil-Smith Jr.", True), ("A b c d e f", False), ("Zoë", False),
])
def test_entity_like(spark, name, expected):
    assert one(spark, text.entity_like, t=name) is expected


@pytest.mark.parametrize("pred, golds, expected", [
    ("The U.S.A.", ["u s a"], True),
    ("u. s. a.", ["the u s"], True),
    ("Unknown", ["unknown"], False),
    ("Café, the", ["café"], True),
    ("", ["x"], False),
    ("an apple", ["", None, "Apple!"], True),
])
def test_exact_match(spark, pred, golds, expected):
    import re

    def norm(s):
        s = re.sub(r"[^\w\s]", " ", s.lower())
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())

    plain = norm(pred) not in ("", "unknown") and any(g and norm(g) == norm(pred) for g in golds)
    assert one(spark, text.exact_match_any, p=pred, g=golds) is plain is expected


@pytest.mark.parametrize("pred, golds, expected", [
    ("It is Paris...", ["paris"], True),
    ("no", ["no"], False),
    ("pari", ["paris"], True),
    ("par", ["paris"], False),
    ("\tParis\n", [" PARIS "], True),
    ("x", [], False),
    ("comparison", ["paris"], True),
])
def test_answer_matches(spark, pred, golds, expected):
    assert one(spark, text.answer_matches, p=pred, g=golds) is expected


def test_golds_fall_back(spark):
    assert one(spark, text.golds_of, a=["x", "", None], c="y") == ["x"]
    assert one(spark, text.golds_of, a=[], c="y") == ["y"]
    assert one(spark, text.golds_of, a=[], c="") == []


def test_fill_leaves_values_alone(spark):
    made = one(spark, lambda q, a: prompts.fill("{q} / {avoid} / {q}", q=q, avoid=a), q="see {avoid}", a="x")
    assert made == "see {avoid} / x / see {avoid}"


def test_document_key(spark):
    df = spark.createDataFrame(
        [(0, None, "t"), (None, 7, "t"), (None, None, "t"), (None, None, None)], "p bigint, i bigint, t string"
    )
    keys = [r[0] for r in df.select(hashing.doc_key(F.col("p"), F.col("i"), F.col("t"))).collect()]
    assert keys[:2] == ["pid:0", "pid:7"]
    assert keys[2] == "sha1:8efd86fb78a56a5145ed7739dcb00c78581c5375"
    assert keys[3] == "sha1:da39a3ee5e6b4b0d3255bfef95601890afd80709"
