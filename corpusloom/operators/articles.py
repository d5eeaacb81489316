"""The authoritative text of an article, and the rules for a page that came out short."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import text as tx

#: Words under which a page is thin, and share of the authoritative words under which a rendered article is truncated.
THIN, TRUNCATED = 60, 0.7


def _content_state(payload: Any) -> dict | None:
    """The first object under the name content_state, depth first and in order; an explicit stack takes any depth."""
    waiting = [payload]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            if isinstance(node.get("content_state"), dict):
                return node["content_state"]
            waiting.extend(reversed(node.values()))
        elif isinstance(node, list):
            waiting.extend(reversed(node))
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _blocks(payloads: pd.Series) -> pd.Series:
    def texts(payload: str | None) -> list[str]:
        try:
            state = _content_state(json.loads(payload or "null"))
        except ValueError:
            state = None
        blocks = (state or {}).get("blocks")
        return [str(b.get("text") or "") for b in blocks if isinstance(b, dict)] if isinstance(blocks, list) else []

    return payloads.map(texts)


def article_text(payload: Column) -> Column:
    """The text of an article's blocks, one line for each, from a response in JSON; empty where it has none or is no JSON."""
    return tx.strip(F.array_join(_blocks(payload), "\n"))


def checked(documents: DataFrame) -> DataFrame:
    """Documents (with ``truth``, the authoritative text or null) with body, word_count and error by the rules.

    A rendered article with less than 0.7 of the authoritative words gets the authoritative text and an error that says
    so, and stays readable; a page without such a text and under 60 words gets an error and keeps its body.
    """
    truth = tx.given(F.col("truth"))
    expected, words = tx.word_count(truth), F.coalesce("word_count", F.lit(0))
    short = truth.isNotNull() & (words < expected * TRUNCATED)
    thin = truth.isNull() & (words < THIN)
    said = F.when(short, F.format_string("rendered extraction was short; used authoritative text (%d words)", expected)).when(thin, F.format_string("thin extraction (%d words)", words))
    return documents.withColumns({"body": F.when(short, truth).otherwise(F.col("body")), "word_count": F.when(short, expected).otherwise(words), "error": F.coalesce(said, "error")}).drop("truth")
