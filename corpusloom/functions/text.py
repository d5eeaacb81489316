"""Scalar expressions over text, all of them built-in Spark functions.

White space means Unicode white space; lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names of query parameters that only track: whole names and prefixes. Fixed values.
TRACKING = r"(?i)^(?:utm_|ref_?$|ref_src|ref_url|s|t|si|feature|__twitter)"
_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
BINARY = r"(?i)\.(?:pdf|zip|tar|gz|mp4|mp3|png|jpe?g|gif|webp|csv|xlsx?)$"
#: Language tags that stand for no language, for the gate and for the report. Fixed values.
UNTRANSLATED, UNREPORTED = ("zxx", "qme", "und", "art"), ("en", "und", "qme", "qst", "zxx")
TOKEN = r"[\p{L}\p{N}_']+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def given(value: Column) -> Column:
    """Null for an empty string, as a missing value."""
    return F.nullif(value, F.lit(""))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def canonical_url(url: Column) -> Column:
    """A URL by which equal pages are found: host folded, PDF of a paper as its abstract page, tracking and fragment dropped."""
    host, path = url_host(url), F.regexp_replace(url_path(url), r";[^/]*$", "")
    paper = (host == "arxiv.org") & path.startswith("/pdf/")
    path = F.when(paper, F.concat(F.lit("/abs/"), F.regexp_replace(path, r"^/pdf/|\.pdf$", ""))).otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING))
    query = F.array_join(pairs, "&")
    scheme = F.coalesce(given(F.lower(F.regexp_extract(url, _URL, 1))), F.lit("https"))
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_binary(url: Column) -> Column:
    """Whether the path of a URL names a file that is no page."""
    return url_path(url).rlike(BINARY)


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def handle(screen_name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("@"), given(screen_name)), F.lit("@unknown"))


def card_text(domain: Column, title: Column, description: Column) -> Column:
    """Domain, title and description of a link card in one line; null if it has neither of the latter."""
    body = F.array_join(F.filter(F.array(title, description), lambda x: x.isNotNull() & (x != "")), " — ")
    return F.when(body != "", F.concat(F.coalesce(domain, F.lit("")), F.lit(": "), body))


def snippet(text: Column, most: int = 280) -> Column:
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)


def tokens(text: Column) -> Column:
    """The index terms of a text in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def is_foreign(text: Column, lang: Column) -> Column:
    """Whether a text is worth translating: tagged with a foreign language, or mostly not in Latin letters whatever its tag says."""
    tag = F.lower(F.coalesce(lang, F.lit("")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ɏ]", ""))
    by_tag = (tag != "") & ~tag.startswith("en") & ~tag.isin(*UNTRANSLATED)
    return by_tag | F.coalesce((letters >= 5) & (latin < letters * 0.7), F.lit(False))


def clean_caption(raw: Column) -> Column:
    """Without thinking aloud, stripped, repeated lines once."""
    lines = F.split(strip(F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")), r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]")
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.try_element_at(lines, i))), "\n")


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("bigint")
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60))


def duration(seconds: Column) -> Column:
    """12s, 3m 4s or 1h 2m."""
    s = F.floor(seconds).cast("bigint")
    minutes, hours = F.floor(s / 60).cast("bigint"), F.floor(s / 3600).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("%dh %dm", hours, minutes % 60))
    )


def byte_size(n: Column) -> Column:
    """Bytes in steps of 1,024 with one decimal."""
    out = None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        text = F.format_string(f"%.1f {unit}", n.cast("double") / 1024**power)
        test = n >= (1024**power if power else 0)
        out = text if out is None else out
        out = F.when(test, text) if power == 4 else out.when(test, text)
    return out


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def first_line(text: Column, most: int) -> Column:
    return F.left(F.split(text, "\n")[0], F.lit(most))


def as_document(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(given(title), F.lit("none")), F.lit(" | text: "), text)


def query_frame(text: str) -> str:
    return f"task: search result | query: {text}"


def as_query(text: Column) -> Column:
    return F.concat(F.lit(query_frame("")), text)


def is_number_row(line: Column) -> Column:
    """A table row without words."""
    return line.rlike(r"^\s*\|.*\|\s*$") & (F.regexp_replace(line, r"(?U)[\d\s|:.,%+\-—–]+", "") == "")


def once(made: Column) -> Column:
    """A column that is made once a row however often it is used later: the plan can't copy its expression past the generator."""
    return F.explode(F.array(made))


def prose(body: Column) -> Column:
    """Markup to text: headings with #, list items with *, tables as | rows, quotes with >, code and emphasis marked; links and images as their text; rows of numbers dropped.

    Marks that a text doesn't hold cost a search, not a replacement.
    """
    mark = "\u0001"  # stands before a heading's level until all tags are gone
    text = F.regexp_replace(body, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"<[hH]([1-6])\b[^>]*>", f"\n\n{mark}$1 ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|<tr\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[lL][iI]\b[^>]*>", "\n* ")
    low = F.lower(body)

    def marked(text: Column, name: str, *steps: tuple[str, str]) -> Column:
        made = text
        for pattern, put in steps:
            made = F.regexp_replace(made, pattern, put)
        return F.when(low.contains(name), made).otherwise(text)

    text = marked(text, "<pre", (r"(?i)<pre\b[^>]*>\s*(?:<code\b[^>]*>)?", "\n\n```\n"), (r"(?i)(?:</code\s*>)?\s*</pre\s*>", "\n```\n\n"))
    text = marked(text, "<code", (r"(?i)</?code\b[^>]*>", "`"))
    text = marked(text, "<blockquote", (r"(?i)<blockquote\b[^>]*>\s*(?:<p\b[^>]*>)?", "\n\n> "))
    text = marked(text, "</strong", (r"(?i)</?strong\b[^>]*>", "**"))
    text = marked(text, "</b>", (r"(?i)</?b>", "**"))
    text = marked(text, "</em", (r"(?i)</?em\b[^>]*>", "*"))
    text = marked(text, "</i>", (r"(?i)</?i>", "*"))
    cells = F.regexp_replace(text, r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    cells = F.regexp_replace(F.regexp_replace(cells, r"(?i)<t[dh]\b[^>]*>", "| "), r"(?i)</t[dh]\s*>", " |")
    text = F.when(body.rlike("(?i)<t[dh]"), cells).otherwise(text)
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|blockquote|pre|section|article|figure|hr)\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", "")
    for level in range(1, 7):
        text = F.replace(text, F.lit(f"{mark}{level}"), F.lit("#" * level))
    text = F.when(body.contains("<"), text).otherwise(body)
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~(x.contains("|") & is_number_row(x)))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)[^\S\n]+(?=\n)", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def created_at(text: Column) -> Column:
    """'Wed Oct 10 20:19:24 +0000 2018' as ISO text with its own offset; null if it is no such date."""
    shape = r"^\w{3} (\w{3}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2}) (\d{4})$"
    part = lambda i: F.regexp_extract(text, shape, i)
    months = F.create_map(*(F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")))
    made = F.concat(part(6), F.lit("-"), F.try_element_at(months, part(1)), F.lit("-"), part(2), F.lit("T"), part(3), part(4), F.lit(":"), part(5))
    return F.when(text.rlike(shape) & F.try_to_timestamp(F.left(made, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), made)
