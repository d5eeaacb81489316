import json
from datetime import datetime

import pytest
from tests_pages import HOST, cursor, entry, film, page, person, photo, post, short

from corpusloom.operators import normalize
from corpusloom.sources.tables import bottom_cursor, latest_posts, raw_pages

#: One post for each part of the normaliser.
PLAIN = post(1, " Reading sho.rt/r again \n", at="Mon Feb 29 06:07:08 -0330 2016", links=[short("r", "https://WWW.Paper.test/a/B?s=2&k=v#z")], favorite_count=7)
FILMS = post(2, "sho.rt/pic2 three files  sho.rt/pic2", by=person(2, old=True), lang="ja", at="yesterday", media=[photo(2, ext_alt_text="a plate"), film(5, 900, 400, 900), film(6), photo(3, media_key="")])
NOTED = post(3, "cut off", note=("The whole note sho.rt/n and sho.rt/me", short("n", "https://card.test/x"), short("me", "https://x.com/me")), wrapped=True,
             card=("sho.rt/n", ("title", "Old"), ("title", "A card"), ("description", ""), ("thumbnail_image", f"{HOST}/t.png")), quotes=post(4, "quoted sho.rt/q", links=[short("q", "https://quoted.test/")], media=[photo(9)]))
STUB = post(5, "an article", by=person(5, core={"screen_name": ""}, legacy={"screen_name": ""}), article={"id": "ar-5", "title": "T", "preview_text": "P"}, quotes=post(6, "", by=person(6, core={})))


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    runs = {
        "run1/page-01": page(cursor("UP", "Top"), entry(PLAIN, 4), entry(FILMS, 3), entry(NOTED, 2), entry(STUB), entry(PLAIN, 9, "TimelineAd"), cursor("DOWN"), cursor("LATER")),
        "run2/page-01": page(entry(post(1, "now without files"), 5)),
        "run2/page-03": page(),
    }
    for name, data in runs.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / f"{name}.json").write_text(json.dumps(data))
    (root / "run2" / "page-02.json").write_text('{"data": [')
    return raw_pages(spark, str(root))


@pytest.fixture(scope="module")
def first(pages):
    return normalize.posts(pages[0].where("seq LIKE '%/run1/%'"))


def test_pages_and_rejects(pages):
    good, bad = pages
    assert good.count() == 3 and [r["path"][-12:] for r in bad.collect()] == ["page-02.json"]
    assert [r["cursor"] for r in bottom_cursor(good).collect()] == ["DOWN"]


def test_posts(first):
    made = {r["tweet_id"]: r for r in normalize.bookmarks(first, "2026-05-05T00:00:00+00:00").collect()}
    assert set(made) == {"701", "702", "703", "705"}
    plain, films, noted, stub = (made[k] for k in sorted(made))
    assert plain["text"] == "Reading https://WWW.Paper.test/a/B?s=2&k=v#z again" and plain["created_at"] == "2016-02-29T06:07:08-03:30" and plain["favorite_count"] == 7 and plain["reply_count"] == 0
    assert films["text"] == "three files" and films["created_at"] is None and films["url"] == "https://x.com/writer_2/status/702" and films["is_long"] == 0
    assert noted["text"] == "The whole note https://card.test/x and https://x.com/me" and noted["is_long"] == 1 and noted["sort_index"] == "8800000000000000002"
    assert (noted["quoted_tweet_id"], noted["quoted_text"]) == ("704", "@writer_4: quoted https://quoted.test/")
    assert (stub["article_id"], stub["article_title"], stub["article_preview"]) == ("ar-5", "T", "P")
    assert (stub["sort_index"], stub["quoted_text"], stub["url"]) == ("0", "@unknown:", "https://x.com/i/status/705")


def test_people(first):
    made = {r["author_id"]: (r["screen_name"], r["verified"]) for r in normalize.authors(first).collect()}
    assert made == {"901": ("writer_1", 0), "902": ("writer_2", 1), "903": ("writer_3", 0), "905": ("", 0)}


def test_files(first):
    made = {r["media_key"]: r for r in normalize.media(first).collect()}
    assert {k: (r["tweet_id"], r["position"]) for k, r in made.items()} == {"pic-2": ("702", 0), "film-5": ("702", 1), "702-3": ("702", 3), "pic-9": ("703", 0)}
    five = made["film-5"]  # of equal rates the later is the best
    assert (five["url"], five["small_url"], five["bitrate"], five["small_bitrate"], five["duration_ms"]) == (f"{HOST}/5-2.mp4", f"{HOST}/5-1.mp4", 900, 400, 31_000)
    assert (made["pic-2"]["alt_text"], made["pic-2"]["width"]) == ("a plate", 128)


def test_targets(first):
    made = {(r["tweet_id"], r["url"]): r for r in normalize.links(first).collect()}
    assert set(made) == {("701", "https://paper.test/a/B?k=v"), ("703", "https://card.test/x"), ("703", "https://quoted.test/")}
    card = made["703", "https://card.test/x"]
    assert (card["title"], card["description"], card["thumb_url"], card["from_card"], card["domain"]) == ("A card", None, f"{HOST}/t.png", 1, "card.test")


def test_tallies(pages, first):
    assert normalize.tallies(pages[0]).first().asDict() == {"pages": 3, "posts": 5, "media": 4, "links": 3, "distinct_posts": 4}
    assert {r["seq"][-17:]: r["entry_count"] for r in normalize.page_records(pages[0]).collect()} == {"run1/page-01.json": 4, "run2/page-01.json": 1, "run2/page-03.json": 0}


def test_a_later_run_replaces_what_belongs_to_a_post(pages):
    rows = normalize.posts(pages[0])
    assert {r["tweet_id"]: r["text"] for r in normalize.bookmarks(rows, "t").collect()}["701"] == "now without files"
    assert {r["media_key"] for r in normalize.media(rows).collect()} == {"pic-2", "film-5", "702-3", "pic-9"}
    assert {r["tweet_id"] for r in normalize.links(rows).collect()} == {"703"}


def test_latest_rows_and_removal(spark):
    kind = "tweet_id string, text string, captured_at string, last_seen_at string, removed_at string, ingested_at timestamp"
    rows = [("k", "was", "c1", "s2", "r", datetime(2022, 3, 1)), ("k", "is", "c2", "s1", None, datetime(2022, 4, 1)), ("l", "alone", "c9", "s9", None, datetime(2022, 1, 1))]
    posts = latest_posts(spark.createDataFrame(rows, kind))
    assert {r["tweet_id"]: (r["text"], r["captured_at"], r["last_seen_at"], r["removed_at"]) for r in posts.collect()} == {"k": ("is", "c1", "s2", None), "l": ("alone", "c9", "s9", None)}
    gone = normalize.removed(posts, spark.createDataFrame([("k",), ("k",)], "tweet_id string"), "noon")
    assert [(r["tweet_id"], r["removed_at"]) for r in gone.collect()] == [("l", "noon")]


def test_merged_attempts(spark):
    kind = "url string, kind string, body string, error string, attempts int"
    old = spark.createDataFrame([("a", "link", None, "slow", 1), ("b", "video", "kept", None, 3)], kind)
    new = spark.createDataFrame([("a", "x_article", "got it", None, 1), ("c", "link", "fresh", None, 1)], kind)
    got = {r["url"]: tuple(r)[1:] for r in normalize.merged_attempts(old, new, "url", ["body", "error"]).collect()}
    assert got == {"a": ("link", "got it", None, 2), "b": ("video", "kept", None, 3), "c": ("link", "fresh", None, 1)}
