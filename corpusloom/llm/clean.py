"""Column expressions that turn markup into visible text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|br|hr|blockquote|table|thead|tbody|tr|td|th|pre|section|article|main|nav|header|footer|figure|figcaption|html|body)\b[^<>]*>"
_INLINE = r"(?i)</?(?:a|b|i|u|s|em|strong|span|code|img|small|sup|sub|mark|font|kbd|abbr|time|cite|q)(?:\s[^<>]*)?/?>"
_HIDDEN = r"(?is)<(script|style|nav|footer|header)\b[^<>]*>.*?</\1\s*>"
_ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_MARK = r"\[\d{1,3}:\d\d(?::\d\d)?\]"


def unescaped(text: Column) -> Column:
    """The five named entities, apostrophes and hard spaces of HTML as characters."""
    out = text
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(text.contains("&"), out).otherwise(text)


def visible(body: Column, *, menus: bool = True) -> Column:
    """The text of a page, one line for each block: tags, transcript marks and (unless ``menus``) navigation removed."""
    out = body
    if not menus:
        out = F.when(body.rlike(r"(?i)<(?:nav|footer|header|script|style)\b"), F.regexp_replace(body, _HIDDEN, "\n")).otherwise(body)
    tags = F.regexp_replace(F.regexp_replace(out, _BLOCK, "\n"), _INLINE, "")
    out = F.when(out.contains("<"), tags).otherwise(out)
    out = F.when(out.contains("]"), F.regexp_replace(out, _MARK, "")).otherwise(out)
    return unescaped(out)
