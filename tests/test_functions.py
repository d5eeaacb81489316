import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx, vector


def values(spark, column, rows, kind="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], kind)
    return [r[0] for r in df.select(column).collect()]


#: The parts of a URL by RFC 3986: scheme, authority (case, port, user), path (case, parameters, dots), query, fragment.
URLS = [
    ("HTTP://User@WWW.Site.TEST:8080/A/%7Eb/../C", "http://user@www.site.test:8080/A/%7Eb/../C"), ("https://www.www.site.test", "https://www.site.test"), ("//site.test?k", "https://site.test?k"),
    ("https://site.test/x;a=1/y;b=2?z=1;w=2", "https://site.test/x;a=1/y?z=1;w=2"), ("ftp://site.test/?b=2&&a=1&b=2#?c=3", "ftp://site.test/?b=2&a=1&b=2"),
    ("https://site.test/p?UTM_id=1&Ref=2&ref_=3&refs=4&ref_source=5&feature_x=6&sid=7&time=8&page=9&__twitter_x=0", "https://site.test/p?refs=4&ref_source=5&page=9"),
    ("https://arxiv.org/pdf/9901.00042v3.pdf?download=1", "https://arxiv.org/abs/9901.00042v3?download=1"), ("https://export.arxiv.org/pdf/9901.00042", "https://export.arxiv.org/pdf/9901.00042"),
]


def test_canonical_urls(spark):
    assert values(spark, tx.canonical_url(F.col("x")), [u for u, _ in URLS]) == [w for _, w in URLS]


def test_binary(spark):
    named = {"https://h.test/data.tar.GZ": True, "https://h.test/sheet.xls#top": True, "https://h.test/song.mp3?play": True, "https://h.test/pdf": False, "https://h.test/?f=a.zip": False, "https://h.test/a.csv/view": False, "https://zip.h.test": False}
    assert values(spark, tx.is_binary(F.col("x")), list(named)) == list(named.values())


def test_strip_and_words(spark):
    assert values(spark, tx.strip(F.col("x")), ["\n\t a b  \n", "", None]) == ["a b", "", None]
    assert values(spark, tx.word_count(F.col("x")), [" a  b\nc ", "", None]) == [3, 0, 0]


def test_number_rows(spark):
    rows = ["| 1 | 2.5 |", "|---|---|", "| 10% | -3 |", "|  |  |", "| a | 1 |", "1 2 3", "| x |"]
    assert values(spark, tx.is_number_row(F.col("x")), rows) == [True, True, True, True, False, False, False]


def test_foreign(spark):
    rows = {("Goedemorgen", "NL"): True, ("Good morning", "en-AU"): False, ("Good morning", None): False, ("доброе утро", ""): True, ("доброе утро", "art"): True, ("доброе утро", "en"): True, ("おはよう", "en-US"): False,
            ("おはようございます、皆さん", "en"): True, ("да", "en"): False, ("abcdefg яяя", "en"): False, ("abcdef яяя", "en"): True, (None, "fr"): True, (None, None): False}
    assert values(spark, tx.is_foreign(F.col("x"), F.col("l")), list(rows), "x string, l string") == list(rows.values())


def test_captions(spark):
    assert values(spark, tx.clean_caption(F.col("x")), ["<think>hm\nhm</think> A cat\nA cat\nsits ", "\n".join(["a"] * 80), ""]) == ["A cat\nsits", "a", ""]


def test_clocks(spark):
    assert values(spark, tx.clock(F.col("x")), [0.0, 75.9, 3725.0], "x double") == ["0:00", "1:15", "1:02:05"]
    assert values(spark, tx.duration(F.col("x")), [12.0, 184.0, 3725.0], "x double") == ["12s", "3m 4s", "1h 2m"]
    assert values(spark, tx.byte_size(F.col("x")), [0, 1023, 1536, 5 << 30], "x bigint") == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 GB"]


def test_cards_and_handles(spark):
    rows = [("d.e", "T", "D"), ("d.e", None, "D"), ("d.e", "", None), (None, "T", "")]
    assert values(spark, tx.card_text(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string") == ["d.e: T — D", "d.e: D", None, ": T"]
    assert values(spark, tx.handle(F.col("x")), ["ann", "", None]) == ["@ann", "@unknown", "@unknown"]


def test_created_at(spark):
    rows = ["Wed Oct 10 20:19:24 +0000 2018", "Wed Oct 10 20:19:24 -0530 2018", "nonsense", None, "Wed Xxx 10 20:19:24 +0000 2018", "Wed Feb 31 20:19:24 +0000 2018"]
    assert values(spark, tx.created_at(F.col("x")), rows) == ["2018-10-10T20:19:24+00:00", "2018-10-10T20:19:24-05:30", None, None, None, None]


def test_prose(spark):
    html = "<h2>Head</h2><p>One <a href='x'>link</a> &amp; <b>two</b></p><ul><li>item</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>a</td><td>2</td></tr></table><script>no()</script>"
    text = values(spark, tx.prose(F.col("x")), [html, "plain | text", None])
    assert text[0].startswith("## Head\n\nOne link & **two**") and "* item" in text[0] and "| a | 2 |" in text[0]
    assert "| 1 | 2 |" not in text[0] and "no()" not in text[0] and text[1:] == ["plain | text", None]


def test_prose_of_quotes_and_code(spark):
    html = ["<p>a <em>b</em> <I>c</I> <strong class='x'>d</strong></p><blockquote><p>said</p></blockquote><pre><code class='p'>x = 1\ny</code></pre><p>run <code>ls</code></p>", "<blockquote>one</blockquote>", "2 < 3 and <b>4</b>"]
    assert values(spark, tx.prose(F.col("x")), html) == ["a *b* *c* **d**\n\n> said\n\n```\nx = 1\ny\n```\n\nrun `ls`", "> one", "2 < 3 and **4**"]


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vector.l2(F.col("a"), F.col("b"))).first()[0] == 5.0
    import hashlib

    digest = hashlib.sha256(b"word").digest()
    got = spark.createDataFrame([("word",)], "x string").select(vector.stand_in(F.col("x"))).first()[0]
    assert got == pytest.approx([((digest[i % 32] + i) % 255) / 255 for i in range(768)], abs=1e-6)


def test_hash(spark):
    import hashlib

    assert values(spark, tx.content_hash(F.col("x")), ["é"]) == [hashlib.sha256("é".encode()).hexdigest()[:16]]
