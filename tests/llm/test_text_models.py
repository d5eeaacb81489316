import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm import language, reading, residue
from corpusloom.llm.arrowtext import byte_view, prefix_hash, slices, span_hash

EN = "The people of the town walk along the river and talk about what they have seen during the long day. "
DE = "Die Leute aus der Stadt gehen am Fluss entlang und sprechen über das, was sie während des langen Tages gesehen haben. "
RU = "Жители города гуляют вдоль реки и говорят о том, что они видели за этот длинный день, пока не стемнело. "


def test_spans_hash_alike():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = span_hash(prefix_hash(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["t"])
    parts = list(slices(batch, "t", 12))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    data, offsets = byte_view(batch.column(0).slice(1))
    assert len(data) == 51 and offsets.tolist() == [0, 0, 0, 50, 51]


def pages(n=240):
    rng = np.random.default_rng(0)
    words = "garden river market letter window evening station paper answer summer teacher village".split()
    for i in range(n):
        text = "\n\n".join(" ".join(rng.choice(words, 14)) + "." for _ in range(6))
        yield (i, f"https://h{i % 23}.test/{i}", "A title", f"<p>{text}</p>", None)
    for i in range(n, n + n // 4):
        yield (i, f"https://h{i % 23}.test/{i}", None, f"<p>Error {rng.choice([404, 500, 503])}. Page not found.</p><p>Please enable JavaScript to view {rng.choice(words)}.</p>", None)


def test_residue(spark):
    real = "\n\n".join("A long walk through the garden and the market of the village." for _ in range(8))
    more = [
        (900, None, None, None, None), (901, None, None, "", None), (902, None, None, None, "thin extraction (12 words)"), (903, None, None, None, "Error 404. Page not found."),
        (904, None, None, f"{real}\n\nError 404. Page not found.", None), (905, None, None, "Home | About | Contact\n\nError 503. Page not found.", None), (906, None, "x", real * 400, None),
    ]
    kind = "doc_id bigint, url string, title string, body string, error string"
    df = spark.createDataFrame([*pages(), *more], kind).selectExpr("*", "1 AS __key", "2 AS __text")
    found = {r["doc_id"] for r in residue.cases(df).collect()}
    assert found == {*range(240, 300), 903, 905}
    assert residue.cases(df.where("false")).collect() == []


def test_residue_learns_from_all_documents(spark):
    real = "A long walk through the garden and the market of the village.\n\n" * 400
    df = spark.createDataFrame([*pages(), (900, "https://h1.test/long", "x", real, None)], "doc_id bigint, url string, title string, body string, error string")
    model = residue.fit(df, most=80)
    assert model.report["documents"] == 301 and model.report["weak cases"] == 60
    assert {r["doc_id"] for r in residue.find(df, model).collect()} == {*range(240, 300)}
    again = residue.fit(df, most=80)
    assert (again.weights == model.weights).all() and (again.dense == model.dense).all()


def test_quick_search_loses_no_phrase():
    texts = ["{{ name }}", "${x} $[a", "Error 404", "HTTP 503 x", "Please enable JavaScript", "lorem", "%(a.b)s", "@@x@@", "__A_B__", "[YOUR NAME]", "<field> {a.b}", "Bad Gateway", "Traceback (most", "XXXX", "undefined", "TBD", "plain words", "Text goes here", "４０４ 404 x"]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    b = residue.blocks_of(data, np.array([0, len(data)]), np.zeros(1 << 16))
    want = [bool(residue.PHRASES.search(t)) or len(residue.FIELD.findall(t)) * 4 > len(t.split()) for t in texts]
    assert residue.phrased(data, b) == want and sum(want) >= 14


def test_quick_search_passes_plain_blocks():
    texts = ["In 1450 and 2400 people came", "a < b, 5 % of {x: 1} [a]", "The script of the play is internal", "A gateway to the park was not far, found by request", "dummy and sample", "x__y 450"]
    assert not any(pc.match_substring_regex(pa.array(texts), residue.HINT).to_pylist())


def told(texts):
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return residue.blocks_of(np.frombuffer("".join(texts).encode(), np.uint8), ends, np.zeros(1 << 16))


def test_blocks_hold_the_features_of_their_words():
    b = told(["Big title\none two two\n\n", "", "\n!!\nüben 中文字 x|y", "Big\none two two"])
    ends = np.cumsum(b.count)
    held = [sorted(b.feature[e - c : e].tolist()) for e, c in zip(ends, b.count)]
    assert b.doc.tolist() == [0, 0, 0, 2, 2, 2, 3, 3] and b.title.tolist() == [True, False, False, True, False, False, True, False]
    assert b.count.tolist() == [3, 6, 0, 0, 1, 12, 1, 6] and b.words.tolist() == [2, 3, 0, 0, 1, 5, 1, 3] and b.repeats.tolist() == [0, 1, 0, 0, 0, 0, 0, 1]
    assert held[1] == held[7] and held[6][0] in held[0] and told(["x\nBig"]).feature[-1] not in held[6] and b.pipes.tolist() == [0, 0, 0, 0, 0, 1, 0, 0]
    empty = told(["", ""])
    assert len(empty.start) == len(empty.feature) == len(empty.pairs) == 0 and empty.docs == 2


def test_sums_of_many_slices_reach_the_driver_as_few(spark, monkeypatch):
    rows = spark.createDataFrame([(i * i, i // 3) for i in range(900)], "v bigint, __slice bigint").repartition(7, "__slice").sortWithinPartitions("__slice", "v")
    made = lambda t: np.array([t.num_rows, t.column("v").to_numpy().sum() / 2], np.float32)
    collect, got = type(rows).collect, []
    monkeypatch.setattr(type(rows), "collect", lambda df: got.append(collect(df)) or got[-1])
    for parts in (2, 9, 300):
        df = rows.where(f"__slice < {parts}")
        assert residue._summed(df, made, parts).tolist() == [3 * parts, sum(i * i for i in range(3 * parts)) / 2]
    assert len(got) == 3 and max(len(r) for r in got) <= 8


def test_training_sums_rows_and_features_in_full():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    b = told([f"{' '.join(rng.choice(words, 3))}\n{' '.join(rng.choice(words, 30))}\n--\n{' '.join(rng.choice(words, 9))}\n" for _ in range(30)])
    label, penalties = np.where(b.doc % 5 == 4, -1, b.doc % 2), (0.01, 0.03)
    columns, scale, rows = residue._dense(b, 30), 1 / np.sqrt(np.maximum(b.count, 1)), np.repeat(np.arange(len(b.start)), b.count)
    used = np.flatnonzero((label >= 0) & ~b.title)
    title = np.flatnonzero(b.title)[b.doc[used]]
    cost = np.where(label[used] > 0, ((1 - label[used].mean()) / label[used].mean()) ** 0.5, 1.0) / len(used)
    for penalty, (weights, dense) in zip(penalties, residue.train(b, 30, label, penalties)):
        w = np.zeros((1 << residue.BITS) + residue.DENSE)
        m, v = np.zeros_like(w), np.zeros_like(w)
        pull = np.where(np.arange(len(w)) < 1 << residue.BITS, penalty, penalty / 10)
        for step in range(1, 33):
            own = np.bincount(rows, w[b.feature], len(b.start)) * scale
            d = np.append(w[1 << residue.BITS :], 0)
            g = cost * (1 / (1 + np.exp(-(own[used] + own[title] + d[columns[used]].sum(1)))) - label[used])
            per = (np.bincount(used, g, len(b.start)) + np.bincount(title, g, len(b.start))) * scale
            grad = np.append(np.bincount(b.feature, per[rows], 1 << residue.BITS), np.bincount(columns[used].ravel() % (residue.DENSE + 1), np.repeat(g, 4), residue.DENSE + 1)[:-1])
            m, v = m + 0.1 * (grad - m), v + 0.01 * (grad * grad - v)
            w = w * (1 - pull) - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        assert np.abs(w - np.append(weights, dense)).max() < 1e-3 and np.abs(w).max() > 0.1


def test_labels(spark):
    named = [("en", "en"), ("en_GB", "en"), ("German", "de"), ("pt-br", "pt"), ("rus", "ru"), ("Español", "es"), ("zxx", None), ("", None), (None, None), ("af", None), ("ENG", "en")]
    df = spark.createDataFrame([(a,) for a, _ in named], "l string")
    assert [r[0] for r in df.select(language.label(df["l"])).collect()] == [b for _, b in named]


def test_languages(spark):
    rng = np.random.default_rng(1)
    vary = lambda t: " ".join(rng.permutation(t.split()))
    train = [(i, vary((EN, DE, RU)[i % 3]) + ".", ("en", "de", "ru")[i % 3]) for i in range(600)]
    net = language.fit([(spark.createDataFrame(train, "k bigint, text string, lang string"), "k", "text", "lang")])
    assert net.report["agreement with labels"] > 0.95
    rows = [(1, EN * 3, "en-US"), (2, DE * 3, None), (3, EN * 3 + "\n\n" + RU * 3, "en"), (4, None, "en"), (5, "", "en"), (6, "@handle https://a.test/b #tag", None), (7, RU * 3, "und"), (7, RU * 3, "und"), (8, EN * 4000, "de")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").selectExpr("*", "1 AS letters", "2 AS langs")
    seen = language.identify(df, "text", net, ["id", "lang"])
    got = [(r["id"], r["lang"]) for r in language.wrong(seen.withColumnRenamed("lang", "label"), "label").select("id", "lang").collect()]
    assert sorted(got) == [(2, "de"), (3, "en"), (3, "ru"), (7, "ru"), (7, "ru"), (8, "en")]
    parts = next(r["segments"] for r in seen.collect() if r["id"] == 3)
    assert [s["lang"] for s in parts] == ["en", "ru"]
    assert language.identify(df.where("false"), "text", net, ["id"]).collect() == []


def test_reading(spark):
    rng = np.random.default_rng(2)
    easy, hard = "cat dog sun run big red hat map bed cup".split(), "institutional characterization methodology notwithstanding epistemological representation configuration interdisciplinary".split()
    say = lambda words, n: ". ".join(" ".join(rng.choice(words, n)).capitalize() for _ in range(12)) + "."
    mixed = [(i, say(easy, 6) if i % 2 else say(hard, 24), ("a", "b", "c")[i % 3]) for i in range(300)]
    trees = reading.fit(spark.createDataFrame(mixed, "k bigint, text string, source string"), "k", "text", "source")
    assert max(trees.report["error on held-out sources"].values()) < 3
    rows = [(1, say(easy, 6)), (2, say(hard, 24)), (3, None), (4, ""), (5, say(hard, 24).replace(".", "").lower()), (6, "123 456 !"), (7, say(easy, 6) * 300)]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 AS grade", "2 AS band")
    got = {r["id"]: r["band"] for r in reading.grade(df, "text", trees, ["id"]).collect()}
    assert got == {1: "easy", 2: "hard", 3: None, 4: None, 5: "hard", 6: None, 7: "easy"}
    assert reading.grade(df.where("false"), "text", trees, ["id"]).collect() == []
