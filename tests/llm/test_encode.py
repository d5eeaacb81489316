import random

import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import encode

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_tree_equals_direct_encoding():
    enc, sizes = encode.tokenizer(PATH)
    random.seed(3)
    letters = " \n\t a'bs1é世— \x1c　😀tll"
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert encode.encode_tree(text, enc, sizes, 3) == enc.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_tree_of_any_text(text):
    enc, sizes = encode.tokenizer(PATH)
    text = text.encode("utf-8", "ignore").decode()
    ids = encode.encode_tree(text, enc, sizes, 2)
    assert ids == enc.encode_ordinary(text)
    assert encode.decode(ids, PATH) == text


@pytest.fixture()
def rows(spark):
    long = "Words and spaces, " * 400 + "unbroken" * 900
    data = [(1, "A plain text."), (2, None), (3, ""), (4, long), (5, " \n\n "), (1, "A plain text."), (6, "<|endoftext|>")]
    return spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS ids", "text AS __key", "1 AS part")


def test_encode_texts(rows):
    enc, _ = encode.tokenizer(PATH)
    want = sorted((r["doc_id"], enc.encode_ordinary(r["text"] or "")) for r in rows.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in encode.encode_texts(rows, "doc_id").collect()) == want
    parted = encode.encode_texts(rows.where("doc_id > 1"), "doc_id", segment=1000)
    assert sorted((r["doc_id"], r["ids"]) for r in parted.collect()) == [w for w in want if w[0] > 1]
    counted = encode.encode_texts(rows, "doc_id", counts_only=True)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == [(k, len(v)) for k, v in want]


def test_repeated_rows_of_long_texts(spark):
    enc, _ = encode.tokenizer(PATH)
    texts = ["One text, " * 30, "Another text " * 25]
    rows = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0])], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode_texts(rows, "doc_id", segment=100).collect())
    assert got == sorted((k, enc.encode_ordinary(t)) for k, t in [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0])])


def test_empty_table(spark):
    assert encode.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id").collect() == []


def test_text_without_spaces_joins_in_small_windows():
    enc, tokens = encode.tokenizer(PATH)
    random.seed(8)
    asked = []

    class Seen:
        def encode_ordinary(self, text):
            asked.append(len(text))
            return enc.encode_ordinary(text)

    for text in ("".join(random.choice("庭の本を読む人が町で歩いている") for _ in range(4000)), "".join(random.choice("abcdeé'") for _ in range(4000)), "สวัสดีชาวโลก" * 300):
        half = len(text) // 2
        parts = [enc.encode_ordinary(text[:half]), enc.encode_ordinary(text[half:])]
        asked.clear()
        assert encode.join(*parts, Seen(), tokens) == enc.encode_ordinary(text)
        assert sum(asked) < len(text) / 2
        assert encode.encode_tree(text, enc, tokens, 16) == enc.encode_ordinary(text)


def test_a_run_that_never_settles():
    """In a run of one character the tokens behind a seam all shift: the window grows to the end, and the result is right."""
    enc, tokens = encode.tokenizer(PATH)
    for n in (100, 1003, 3000):
        assert all(encode.encode_tree(c * n, enc, tokens, 16) == enc.encode_ordinary(c * n) for c in ("x", "7", "=-", " "))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeést'庭町1２=- \n", max_size=200), st.integers(1, 9))
def test_runs_of_every_kind(text, leaf):
    enc, tokens = encode.tokenizer(PATH)
    assert encode.encode_tree(text, enc, tokens, leaf) == enc.encode_ordinary(text)
