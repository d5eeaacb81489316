import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import split


def brute(text, limit, overlap, least):
    s, spans, start = split.strengths(text), [], 0
    while len(text) - start > limit:
        window = range(start + least, start + limit + 1)
        cut = max(window, key=lambda p: (s[p], p))
        spans.append((start, cut))
        start = cut - overlap
    return [*spans, (start, len(text))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n<p>-", max_size=400), st.integers(12, 60), st.integers(0, 5))
def test_against_brute_force(text, limit, overlap):
    least = max(overlap + 1, limit // 2)
    spans = split.cuts(text, limit, overlap)
    assert spans == (brute(text, limit, overlap, least) if len(text) > limit else [(0, len(text))])
    assert all(b - a <= limit for a, b in spans)
    assert text[spans[0][0] : spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text


def test_range_maximum():
    values = np.random.default_rng(1).integers(0, 4, 500).astype(np.int8)
    table = split.RangeMax(values, 100)
    for low in range(0, 400, 7):
        for size in (1, 2, 3, 64, 100):
            assert table.strongest(low, low + size - 1) == max(range(low, low + size), key=lambda p: (values[p], p))


def test_long_text_crosses_stretches():
    text = ("Some words in a sentence. " * 30 + "\n\n") * 200
    spans = split.cuts(text)
    assert spans == brute(text, split.LIMIT, split.OVERLAP, split.LIMIT // 2)
    assert all(text[b - 2 : b] == "\n\n" for _, b in spans)


def test_natural_boundaries():
    page = "".join(f"<p>[{i}:00] {'word ' * 150}end.</p>\n" for i in range(40))
    for a, b in split.cuts(page)[:-1]:
        assert page[b:].startswith("<p>[") and b - a <= 4800
    assert split.cuts("x" * 10_000) == [(0, 4800), (4600, 9400), (9200, 10_000)]


def test_split_texts(spark):
    data = [(1, "short"), (2, None), (3, ""), (4, "a b " * 3000), (4, "a b " * 3000), (5, "é" * 4800), (6, "é" * 4801)]
    df = spark.createDataFrame(data, "id bigint, text string").selectExpr("id", "text", "0 AS piece", "'n' AS n_pieces")
    rows = split.split_texts(df, "id", "text").collect()
    assert {r["id"] for r in rows} == {1, 3, 4, 5, 6}
    assert all(len(r["text"]) <= 4800 for r in rows)
    assert sorted(r["id"] for r in split.oversized(split.split_texts(df, "id", "text"), "id").collect()) == [4, 6]
    assert split.split_texts(df.where("false"), "id", "text").collect() == []
    with pytest.raises(ValueError):
        split.split_texts(df, "id", "text", limit=10, overlap=10)
