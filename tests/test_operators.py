import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, documents, indexing, queues, report, retrieval
from corpusloom.streaming import ingest


REPORT = "https://reports.invented.test/2031"


@pytest.fixture(scope="module")
def small(spark):
    """Three posts (one quoting, one without an author that announces an article), a long report that two of them have, and a file each."""
    make = spark.createDataFrame
    posts = make(
        [("51", "u1", "tide tables", "en", "2031-04-01T09:00:00+00:00", None, None, None, None), ("52", "u2", "harbour notes", "nl", "2033-08-15T21:30:00+00:00", "@pilot: low water", None, None, None), ("53", None, "buoys", "en", None, None, "a-1", "On buoys", "They float")],
        "tweet_id string, author_id string, text string, lang string, created_at string, quoted_text string, article_id string, article_title string, article_preview string",
    ).withColumn("url", F.concat(F.lit("https://posts.invented.test/"), "tweet_id"))
    authors = make([("u1", "KeelLine"), ("u2", "otto_v")], "author_id string, screen_name string")
    links = make([("51", REPORT, "reports.invented.test", "Report", None, None, 1), ("52", REPORT, "reports.invented.test", None, None, None, 0), ("52", "https://maps.invented.test/", "maps.invented.test", "", "All maps", None, 1)], "tweet_id string, url string, domain string, title string, description string, thumb_url string, from_card int")
    body = "".join(f"<p>Gauge {i} read {i % 7} fathoms.</p>" for i in range(600))
    docs = make([(7, REPORT, "link", "51", "Gauges", "Reports", body, 3000, "en", None, 1, "2031"), (8, "https://gone.invented.test/", "link", None, None, None, None, 0, None, "refused", 2, "2031")], "doc_id bigint, url string, kind string, tweet_id string, title string, site string, body string, word_count int, lang string, error string, attempts int, fetched_at string")
    media = make([("f1", "51", "photo", "https://files.invented.test/1", None, None, 0), ("f2", "52", "video", "https://files.invented.test/2", "https://files.invented.test/2s", 4400, 2)], "media_key string, tweet_id string, kind string, url string, small_url string, duration_ms bigint, position bigint")
    captions = make([("f1", "A lighthouse", None)], "media_key string, text string, error string")
    return {"posts": posts, "authors": authors, "links": links, "documents": docs, "media": media, "captions": captions}


def test_pieces():
    assert chunking.pieces("") == [""] and chunking.pieces("brief") == ["brief"]
    assert chunking.spans("q" * 9_400) == [(0, 4800), (4600, 9400)] and chunking.spans("q" * 9_401)[-1] == (9200, 9401)
    # three paragraphs of 6, 5 and 4: the second fills the piece up, and its rest starts the next one
    assert chunking.pieces("aaaaaa\n\nbbbbb\n\ncccc", 10, 1) == ["aaaaaa\n\nbb", "bbbb\n\ncccc"]
    assert chunking.pieces("aaaaaaaa\n\nbbbbb", 10, 1) == ["aaaaaaaa", "bbbbb"] and chunking.pieces("\n\n\n\nabcdefghij\n\n", 10, 1) == ["abcdefghij"]
    random.seed(4)
    for _ in range(300):
        text = "".join(random.choice(("e", "ff", "\n", "\n\n", "g" * 9)) for _ in range(random.randint(0, 60)))
        found = chunking.spans(text, 16, 3)
        assert all(b - a <= 16 for a, b in found) and all(not text[b:c].strip("\n") for (_, b), (c, _) in zip(found, found[1:]))
        assert {i for i, c in enumerate(text) if c not in "\n"} <= {i for a, b in found for i in range(a, b)}


def test_split_column(spark):
    texts = ["a", "", None, "p\n\n" * 3000, "x" * 10_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.split(F.col("t"))).collect()]
    assert got == [[] if t is None else chunking.pieces(t) for t in texts]


def test_collect(small):
    rows = chunking.collect(small["posts"], small["authors"], small["links"], small["documents"], small["captions"], small["media"]).collect()
    by = lambda tid, source: sorted((r["position"], r["text"]) for r in rows if (r["tweet_id"], r["source"]) == (tid, source))
    assert by("51", "post") == [(0, "@KeelLine: tide tables")] and by("52", "quote") == [(1, "@otto_v: @pilot: low water")]
    assert by("53", "article") == [(1, "@unknown: On buoys\n\nThey float")] and by("51", "image") == [(0, "@KeelLine: A lighthouse")]
    page = by("51", "link")  # its card is left out for the page, which both posts have
    assert page[0][1].startswith("Reports: Gauges\n\nGauge 0 read 0 fathoms.\n\nGauge 1") and len(page) > 3
    assert by("52", "link") == sorted([*page, (0, "maps.invented.test: All maps")])


def test_post_chunks_by_brute_force(spark):
    random.seed(2)
    texts = ["", "  ", "a" * 5000, "\n\n".join("w" * random.randint(10, 4000) for _ in range(5)), " padded "]
    posts = spark.createDataFrame([(str(i), "1", t, "q" if i % 2 else None, None, None, "en") for i, t in enumerate(texts)], "tweet_id string, author_id string, text string, quoted_text string, article_title string, article_preview string, lang string")
    authors = spark.createDataFrame([("1", "n")], "author_id string, screen_name string")
    got = sorted((r["tweet_id"], r["position"], r["text"]) for r in chunking.post_chunks(posts, authors, spark.createDataFrame([], "tweet_id string")).collect())
    want = []
    for i, t in enumerate(texts):
        parts = [p for x in (t, "q" if i % 2 else "") if x.strip() for p in chunking.pieces(x.strip())]
        want += [(str(i), k, f"@n: {p}") for k, p in enumerate(parts)]
    assert got == sorted(want)


def test_transcript(spark):
    rows = [("a", 0.0, "one & two"), ("a", 30.0, "three"), ("a", 61.0, "four"), ("a", 62.0, "  "), ("b", 5.0, "solo"), ("c", 1.0, "")]
    got = {r["key"]: (r["body"], r["words"]) for r in chunking.transcript(spark.createDataFrame(rows, "key string, start double, text string")).collect()}
    assert got == {"a": ("<p>[0:00] one &amp; two three</p>\n<p>[1:01] four</p>", 5), "b": ("<p>[0:05] solo</p>", 1)}


def test_paragraphs_gather_no_group(spark, capsys):
    random.seed(3)
    rows = [(random.choice([None, "a", "a", "b"]), float(random.randint(0, 900)), f" w{i} ") for i in range(400)] + [("c", 0.0, "x"), ("c", 60.0, "y"), ("c", 119.0, "z"), ("c", 500.0, " ")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = chunking.paragraphs(spark.createDataFrame(rows, "key string, start double, text string"))
        got = sorted((str(r["key"]), r["start"], r["text"], r["words"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in (None, "a", "b", "c"):
        held = []
        for start, text in [*sorted((s, t.strip()) for k, s, t in rows if k == key and t.strip()), (1e9, "")]:
            if held and start - held[0][0] >= 60:
                want.append((str(key), held[0][0], " ".join(t for _, t in held), len(held)))
                held = []
            held.append((start, text))
    made.explain()
    plan = capsys.readouterr().out
    assert got == sorted(want) and "collect_list" not in plan and "Window" not in plan


def test_search_filters(spark, small):
    said = [("51", "tide tables"), ("52", "harbour notes on tables"), ("52", "tables"), ("99", "tide of a removed post")]
    chunks = spark.createDataFrame([(i, t, "post", x, None, None, 0) for i, (t, x) in enumerate(said)], "id bigint, tweet_id string, source string, text string, source_text string, ref string, position int")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "chunk_id bigint, embedding array<float>")
    tables = {**small, "chunks": chunks, "vectors": vectors}
    found = lambda q, **f: [r["tweet_id"] for r in retrieval.search(tables, q, [0.0, 1.0], **f).collect()]
    assert found("tide tables") == ["51", "52"]
    assert found("unheard", author="@@OTTO_V") == ["52"] and found("?!", after="2032") == ["52"]
    assert found("tide", before="2031-04-02") == ["51"] and found("tide", author="nobody") == []
    for odd in ("'", "NEAR(a b)", "t*", ")", "text:tide", '"tide'):
        found(odd)
    assert retrieval.lexical_ranks(chunks, "x ; y").collect() == []
    alone = retrieval.vector_ranks(vectors, [0.0, 1.0], among=chunks.where("id = 3").selectExpr("id AS chunk_id"))
    assert [tuple(r) for r in alone.collect()] == [(3, None, 0)]  # a lone candidate is ranked even without a vector


def test_rrf_scores(spark):
    dense = spark.createDataFrame([(1, 0), (2, 1)], "chunk_id bigint, rank int")
    lexical = spark.createDataFrame([(2, 0), (3, 1)], "chunk_id bigint, rank int")
    got = {r["chunk_id"]: r["score"] for r in retrieval.fuse(dense, lexical).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}, abs=1e-9)


def test_index_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, "tweet_id string, hash string")
    want = make([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", "3")])
    have = make([("a", "2"), ("a", "1"), ("b", "1"), ("b", "2"), ("d", "9")])
    assert {(r["tweet_id"], r["change"]) for r in indexing.changes(want, have).collect()} == {("b", "rewrite"), ("c", "add"), ("d", "remove")}
    assert indexing.changes(want, want).collect() == []


def test_translation_and_embedding(spark):
    from corpusloom.functions import text as tx

    chunks = spark.createDataFrame([(1, "t", "hola"), (2, "t", "hello")], "id bigint, tweet_id string, text string").withColumn("hash", tx.content_hash(F.col("text")))
    cache = chunks.where("id = 1").select("hash", F.lit("hello").alias("text"))
    made = indexing.translated(chunks, cache)
    assert {(r["id"], r["text"], r["source_text"]) for r in made.collect()} == {(1, "hello", "hola"), (2, "hello", None)}
    one = indexing.distinct_within(made.withColumnRenamed("id", "slot")).collect()
    assert [(r["slot"], r["source_text"]) for r in one] == [(1, None)]
    framed = lambda texts: [[float(len(t.removeprefix("title: none | text: "))), float(len(texts))] for t in texts]
    got = indexing.embed(chunks, framed, batch=1).collect()
    assert {r["chunk_id"]: r["embedding"] for r in got} == {1: [4.0, 1.0], 2: [5.0, 1.0]}


def test_queues(small):
    jobs = [(r["url"], r["kind"]) for r in queues.pending_pages(small["posts"], small["authors"], small["links"], small["documents"]).collect()]
    assert jobs == [("https://maps.invented.test/", "link")]
    videos = queues.pending_videos(small["posts"], small["authors"], small["media"], small["documents"]).collect()
    assert [(r["url"], r["duration_ms"]) for r in videos] == [("https://x.com/otto_v/status/52/video/3", 4400)]
    assert queues.pending_captions(small["posts"], small["media"], small["captions"]).collect() == []


def test_links_to_files_and_animated_pictures_count(spark, small):
    links = spark.createDataFrame([("51", "https://files.invented.test/map.zip")], "tweet_id string, url string")
    jobs = queues.pending_pages(small["posts"], small["authors"], links, small["documents"]).collect()
    assert [r["url"] for r in jobs if r["kind"] == "link"] == ["https://files.invented.test/map.zip"]
    media = spark.createDataFrame([("51", "video", 6000, 16, None), ("52", "animated_gif", 2000, 8, 4), ("52", "photo", 9000, 8, None)], "tweet_id string, kind string, duration_ms bigint, bitrate bigint, small_bitrate bigint")
    got = report.videos(small["posts"].withColumn("removed_at", F.lit(None).cast("string")), media).first()
    assert (got["videos"], got["seconds"], got["best_bytes"], got["small_bytes"]) == (2, 8.0, 14.0, 13.0)


def test_every_page_has_a_state(spark):
    rows = [(1, "link", "a b", "<p>a b</p>", 80, None), (2, "link", None, None, 0, "timeout"), (3, "link", None, None, 0, None), (4, "video", "", "", 0, "gone"), (5, "video", "hi", "hi", 1, "thin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, kind string, text string, body string, word_count int, error string")
    got = [tuple(r) for r in queues.page_states(docs).orderBy("doc_id").collect()]
    assert got == [(1, True, 2, "ok"), (2, False, 0, "failed"), (3, False, 0, "empty"), (4, False, 0, "failed"), (5, True, 1, "ok")]


def test_enrichers(spark):
    got = queues.enriched(spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"), "k", "v", lambda v: v.upper() if v != "b" else 1 // 0)
    rows = {r["k"]: (r["text"], r["error"]) for r in got.collect()}
    assert rows[1] == ("A", None) and rows[2][0] is None and "division" in rows[2][1]


def test_documents(small):
    found = documents.find(small["documents"], small["links"], small["posts"], "http://reports.invented.test/2031?utm_medium=m".replace("http:", "https:"))
    first = documents.page(found).first()
    assert first["has_more"] and first["next_offset"] == 12_000 and first["text"].startswith(f"# Gauges\n\nSource: {REPORT}\n\nGauge 0 read")
    rest = documents.page(found, 12_000).first()
    assert not rest["has_more"] and rest["next_offset"] is None and rest["text"].endswith("Gauge 599 read 4 fathoms.")
    assert documents.find(small["documents"], small["links"], small["posts"], "52").count() == 1
    assert documents.page(found.where("false")).first()["text"] == ""
    with pytest.raises(ValueError):
        documents.page(found, -5)


def test_every_page_of_a_text(spark):
    texts = ["", "x" * 10, "é" * 9 + "y" * 12, None, "z" * 11, "💡ab" * 10]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in documents.pages(rows, 10).collect())
    want = [(i, o, t[o : o + 10], o + 10 if len(t) > o + 10 else None, len(t) > o + 10) for i, t in enumerate(texts) if t is not None for o in range(0, max(len(t), 1), 10)]
    assert got == want and [len(t) for t in texts if t] == [sum(len(r[2]) for r in got if r[0] == i) for i, t in enumerate(texts) if t]


def test_walk_rules():
    assert ingest.stop_reason(False, 0, False, 0, False, 0, None) == "no_first_page"
    assert ingest.stop_reason(True, 5, False, 0, True, 1, None) == "watermark"
    assert ingest.stop_reason(True, 0, False, 0, False, 1, None) == "end_of_list"
    assert ingest.stop_reason(True, 5, False, 0, False, 3, 3) == "max_pages"
    assert ingest.stop_reason(True, 5, False, 0, False, 2, 3) is None
    assert [ingest.is_clean(r) for r in ("end_of_list", "watermark", "max_pages", "no_first_page")] == [True, True, False, False]


def test_stream_is_idempotent(spark, tmp_path):
    import json

    from corpusloom.sources.tables import latest_posts
    from tests_pages import entry, page, photo, post, short

    root, out = tmp_path / "raw", str(tmp_path / "tables")
    drop = lambda run, *entries: ((root / run).mkdir(parents=True), (root / run / "page-01.json").write_text(json.dumps(page(*entries))))
    run = lambda at: ingest.ingest(ingest.page_stream(spark, str(root)), out, str(tmp_path / "state"), at).awaitTermination()
    drop("1", entry(post(1, "first", media=[photo(1)], links=[short("a", "https://a.test/1")]), 6))
    run("2031-01-01T00:00:00+00:00")
    drop("2", entry(post(1, "again"), 6), entry(post(2, "second", links=[short("b", "https://b.test/2")]), 7))
    run("2031-02-01T00:00:00+00:00")
    posts = {r["tweet_id"]: (r["text"], r["captured_at"][:7], r["last_seen_at"][:7]) for r in latest_posts(spark.read.parquet(f"{out}/bookmarks")).collect()}
    assert posts == {"701": ("again", "2031-01", "2031-02"), "702": ("second", "2031-02", "2031-02")}
    made = ingest.tables(spark, out)
    assert {r["author_id"] for r in made["authors"].collect()} == {"901", "902"}
    assert made["media"].count() == 0 and [r["url"] for r in made["links"].collect()] == ["https://b.test/2"]  # the second run took them from post 1
    assert sorted(r["entry_count"] for r in made["raw_pages"].collect()) == [1, 2]
    assert ingest.stored_mark(spark, out) == "8800000000000000007"
