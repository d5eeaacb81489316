"""The index build, the hooks of the enrichers, settings, the walk over pages and the facade."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tests_pages import cursor, entry, page, post

from corpusloom import settings as st
from corpusloom.engine import Engine
from corpusloom.functions import text as tx
from corpusloom.operators import articles, indexing, postings, queues, retrieval
from corpusloom.streaming import ingest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WANT = "tweet_id string, source string, ref string, position int, text string, lang string, kind int"
HAVE = "id bigint, tweet_id string, source string, ref string, position int, text string, source_text string, lang string, hash string"


def made(spark, rows):
    return spark.createDataFrame([(t, "post", None, i, x, "en", 0) for t, i, x in rows], WANT).withColumn("hash", tx.content_hash(F.col("text")))


def test_index_build(spark):
    have = spark.createDataFrame([(4, "same", "post", None, 0, "s", None, "en", ""), (4, "same", "post", None, 0, "s", None, "en", ""), (7, "other", "post", None, 0, "old", None, "en", ""), (9, "gone", "post", None, 0, "g", None, "en", "")], HAVE)
    have = have.withColumn("hash", tx.content_hash(F.col("text")))
    vectors = spark.createDataFrame([(4, [1.0]), (7, [2.0]), (9, None)], "chunk_id bigint, embedding array<float>")
    want = made(spark, [("same", 0, "s"), ("other", 0, "new"), ("other", 1, "new too"), ("other", 2, "new"), ("fresh", 0, "f")])
    seen = indexing.build(want, have, vectors, lambda texts: [[float(len(t))] for t in texts])
    assert seen.counts.first().asDict() == {"chunks": 4, "embedded": 4, "added": 3, "removed": 2}
    assert sorted((r["id"], r["tweet_id"], r["text"]) for r in seen.chunks.collect()) == [(4, "same", "s"), (10, "fresh", "f"), (11, "other", "new"), (12, "other", "new too")]
    assert {r["chunk_id"]: r["embedding"] for r in seen.vectors.collect()}[4] == [1.0]
    again = indexing.build(want, seen.chunks, seen.vectors)
    assert again.counts.first().asDict() == {"chunks": 4, "embedded": 4, "added": 0, "removed": 0}
    anew = indexing.build(want, seen.chunks, seen.vectors, rebuild=True)
    assert anew.counts.first().asDict() == {"chunks": 4, "embedded": 0, "added": 4, "removed": 0}
    nothing = indexing.build(want.where("false"), have.where("false"), vectors.where("false"))
    assert nothing.counts.first().asDict() == {"chunks": 0, "embedded": 0, "added": 0, "removed": 0}


def test_postings(spark, tmp_path, capsys):
    kind = "id bigint, text string"
    old = spark.createDataFrame([(1, "Red boats, red sails"), (1, "Red boats, red sails"), (2, "blue boats"), (3, ""), (4, None)], kind)
    index = postings.build(old, str(tmp_path / "a"))
    assert (index.chunks, index.words) == (4, 6)
    assert {(r["term"], r["chunk_id"], r["tf"], r["dl"]) for r in index.of_terms(["red", "boats", "none"]).collect()} == {("red", 1, 2, 4), ("boats", 1, 1, 4), ("boats", 2, 1, 2)}
    new = spark.createDataFrame([(1, "Red boats, red sails"), (3, ""), (4, None), (5, "green boats")], kind)
    later = postings.update(index, new, spark.createDataFrame([(2,)], "chunk_id bigint"), new.where("id = 5"), str(tmp_path / "b"))
    ask = lambda i: [tuple(r) for r in retrieval.lexical_ranks(i, "boats red").collect()]
    assert ask(later) == ask(new) and [r[0] for r in ask(later)] == [1, 5]
    retrieval.lexical_scores(later, "boats").explain()
    plan = capsys.readouterr().out
    assert "bucket" in plan and "regexp_extract_all" not in plan  # a search reads postings, no texts


def test_captioner_and_transcriber(spark):
    photos = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "k bigint, url string").coalesce(1)

    def captions(urls):
        if "u4" in urls:
            raise RuntimeError("no memory\nat all")
        return [{"text": f"{u} of {len(urls)}"} if u != "u1" else {"error": "blank"} for u in urls]

    got = {r["k"]: (r["text"], r["error"]) for r in queues.captioned(photos, "k", "url", captions, batch=2).collect()}
    assert got == {0: ("u0 of 2", None), 1: (None, "blank"), 2: ("u2 of 2", None), 3: ("u3 of 2", None), 4: (None, "no memory")}
    jobs = spark.createDataFrame([("a", "sa", 5), ("b", "sb", 4), ("c", "sc", 3)], "url string, small_url string, duration_ms bigint").coalesce(1)
    speak = lambda asked: iter([{"url": j["url"], "segments": [{"start": 0.0, "end": 1.0, "text": j["small_url"]}], "lang": "en"} for j in reversed(asked) if j["url"] != "b"])
    got = {r["url"]: ([s["text"] for s in r["segments"]], r["error"]) for r in queues.transcribed(jobs, speak).collect()}
    assert got == {"a": (["sa"], None), "b": ([], "no answer"), "c": (["sc"], None)}
    assert queues.tallied(spark.createDataFrame([("ok",), ("ok",), ("failed",)], "outcome string")).where("outcome = 'ok'").first()["n"] == 2


def test_translator(spark):
    long = "\n\n".join(f"{c * 900}" for c in "abc")
    texts = spark.createDataFrame([("1", long), ("2", "plain"), ("3", "bad"), ("4", "xx")], "hash string, text string")

    def ask(t):
        if t == "bad":
            raise ValueError("refused")
        return "ENGLISH" if t[0] in "bp" else t[0].upper()

    got = {r["hash"]: (r["text"], r["error"]) for r in queues.translated_whole(texts, ask).collect()}
    assert got == {"1": ("A\n\n" + "b" * 900 + "\n\nC", None), "2": (None, None), "3": (None, "refused"), "4": ("X", None)}
    cache = spark.createDataFrame([("1", "s", None, "2031")], "hash string, source_text string, text string, updated_at string")
    new = spark.createDataFrame([("1", "t", "late", "2032"), ("5", "u", None, "2032")], cache.schema)
    assert {tuple(r) for r in indexing.saved_translations(cache, new).collect()} == {("1", "s", "late", "2032"), ("5", "u", None, "2032")}


def test_articles(spark):
    payloads = ['{"a": [{"content_state": 3}, {"b": {"content_state": {"blocks": [{"text": " One"}, {}, {"text": "two\\n"}]}}}], "content_state": {"blocks": [{"text": "late"}]}}', '{"content_state": {"blocks": null}}', "{broken", None, "[" * 300 + "]" * 300]
    rows = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r[0] for r in rows.select(articles.article_text(F.col("p"))).collect()] == ["late", "", "", "", ""]
    nested = spark.createDataFrame([('{"a": [{"content_state": {"blocks": [{"text": " One"}, {}, {"text": "two\\n"}]}}]}',)], "p string")
    assert nested.select(articles.article_text(F.col("p"))).first()[0] == "One\n\ntwo"
    kind = "body string, word_count int, error string, truth string"
    given = [("b", 6, None, "w " * 10), ("b", 7, None, "w " * 10), ("b", 59, None, None), ("b", 60, "kept", ""), (None, None, "timeout", None)]
    got = [tuple(r) for r in articles.checked(spark.createDataFrame(given, kind)).collect()]
    assert got == [("w " * 10, 10, "rendered extraction was short; used authoritative text (10 words)"), ("b", 7, None), ("b", 59, "thin extraction (59 words)"), ("b", 60, "kept"), (None, 0, "thin extraction (0 words)")]


def test_settings_and_stages(tmp_path):
    file = tmp_path / "s.toml"
    assert st.settings(file) == st.Settings()
    file.write_text('exclude = ["image"]\ntranslate = false\n')
    assert st.resolved(st.settings(file), exclude=["video"], translate=True) == st.Settings(frozenset({"image", "video"}), True)
    file.write_text('exclude = ["pictures"]\n')
    with pytest.raises(ValueError, match="pictures"):
        st.settings(file)
    seen = []
    got = st.run_stages([("a", lambda: seen.append(1)), ("b", lambda: 1 // 0), ("c", lambda: seen.append(2))])
    assert seen == [1, 2] and [(s["stage"], s["outcome"]) for s in got] == [("a", "ok"), ("b", "failed"), ("c", "ok")]
    assert st.now_iso().endswith("+00:00") and st.run_id().endswith("Z")


def test_walk(spark):
    from corpusloom.sources.tables import PAGE

    def pages(*each):
        rows = [(f"p{i:02d}", json.dumps(p)) for i, p in enumerate(each)]
        return spark.createDataFrame(rows, "seq string, raw string").select("seq", F.from_json("raw", PAGE).alias("page"))

    full = pages(*(page(entry(post(i, "t"), 100 - i), cursor(f"c{i}")) for i in range(6)))
    of = lambda rows, mark, most=None: (sorted(r["seq"] for r in ingest.walk(rows, mark, most)[0].collect()), ingest.walk(rows, mark, most)[1])
    at = str(8_800_000_000_000_000_000 + 98)
    assert of(full, at) == (["p00", "p01", "p02", "p03"], "watermark")  # one page more than the one that reaches the mark
    assert of(full, None, 2) == (["p00", "p01"], "max_pages") and of(full, None)[1] == "end_of_list"
    assert of(pages(page(entry(post(1, "t"), 9)), page(), page(entry(post(2, "t"), 8))), None) == (["p00", "p01"], "end_of_list")
    assert of(full.where("false"), None) == ([], "no_first_page")


def test_gate(spark):
    assert queues.gated(spark.range(19)).count() == 0 and queues.gated(spark.range(20)).count() == 20


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_facade(spark, tmp_path):
    e = Engine(spark, FOLDER, lambda texts: [[float(len(t) % 7)] * 768 for t in texts])
    hits = e.search("hybrid market", limit=3).collect()
    assert 0 < len(hits) <= 3 and hits[0]["url"] and isinstance(hits[0]["media"], list)
    assert e.bookmark(hits[0]["tweet_id"]).count() == 1
    url = e.documents(e.tables["documents"].where("word_count > 100 AND tweet_id IS NOT NULL").join(e.tables["posts"].select("tweet_id"), "tweet_id", "left_semi").first()["tweet_id"]).first()["url"]
    first = e.read(url).first()
    assert first["mode"] == "page" and first["text"].startswith("# ") and len(first["text"]) <= 12_000
    for wrong in (lambda: e.bookmark("no"), lambda: e.read("https://no.test/"), lambda: e.search("x", limit=51), lambda: e.search("x", source="blog")):
        with pytest.raises(ValueError):
            wrong()
    assert "Posts:" in e.report() and e.last_sync() > "2010"
    out = str(tmp_path / "index")
    counts = e.build_index(out).counts.first()
    assert counts["chunks"] == spark.read.parquet(f"{out}/chunks.parquet").count() and counts["embedded"] == counts["chunks"]
    assert spark.read.parquet(f"{out}/postings").select("chunk_id").distinct().count() <= counts["chunks"]
