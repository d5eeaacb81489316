import numpy as np
import pytest

from corpusloom.llm import neardup

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def made(rng, n=120):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, share):
    words = text.split()
    for i in rng.choice(len(words), int(share * len(words)), replace=False):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


def truth(rows, least):
    import re

    norm = {k: re.sub(r"[\W_]+", "", t).lower() for k, t in rows if t}
    sets = {k: {t[i : i + 10] for i in range(len(t) - 9)} for k, t in norm.items() if len(t) >= least}
    keys = sorted(sets)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if share(a, b) >= 0.5}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (8, 60, 1500):
        s = neardup.signatures(np.concatenate([x[:n], x[n // 2 : n + n // 2]]), np.array([n, n]), 640)
        assert np.isfinite(s).all()
        assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08
    assert not np.isfinite(neardup.signatures(x[:0], np.array([0]), 16)).any()


def test_weighted_signatures():
    x = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.full(200, 1.5), np.full(200, 3.0)
    s = neardup.signatures(np.concatenate([x, x]), np.array([200, 200]), 640, np.concatenate([a, b]))
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08
    one = neardup.signatures(np.concatenate([x, x]), np.array([200, 200]), 64, np.concatenate([np.ones(200), np.ones(200)]))
    assert (one[0] == one[1]).all()


@pytest.mark.parametrize("block", [2000, 4])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # 4: the hot group is joined block by block
    rng = np.random.default_rng(4)
    base = [made(rng) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    hot = made(rng)
    rows += [(100 + i, edited(rng, hot, 0.03)) for i in range(14)]
    rows += [(200 + i, base[0]) for i in range(3)] + [(300, edited(rng, base[1], 0.1)), (301, "<p>" + base[2].upper() + "</p>"), (302, None), (303, ""), (304, "short")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, body string").selectExpr("doc_id", "body", "1 AS key", "'a' AS class", "2 AS text")
    members, pairs = neardup.similar(df, "doc_id", "body", least=100)
    got = {(r["key_a"], r["key_b"]) for r in neardup.expand(members, pairs).collect()}
    plain = [(k, t.replace("<p>", "").replace("</p>", "") if t else t) for k, t in dict(rows).items()]
    assert got == truth(plain, 100)
    info = {r["key"]: r for r in neardup.linked(members, pairs).collect()}
    assert info[200]["class"] == 0 and info[0]["copies"] == 4 and 302 not in info
    left = neardup.similar(df, "doc_id", "body", least=100, without=spark.createDataFrame([(100,)], "x bigint"))
    assert 100 not in {r["key"] for r in left[0].collect()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, body string")
    members, pairs = neardup.similar(df, "doc_id", "body", least=100)
    assert neardup.expand(members, pairs).collect() == []
