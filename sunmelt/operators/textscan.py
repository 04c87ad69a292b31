"""Titles and keyword sentences over a table of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import text
from sunmelt.operators.filters import filter_keywords


def page_heads(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Title and abstract of each page, NULL where the page states none."""
    return pages.select(
        key,
        text.embedded_title(F.col(html)).alias("title"),
        text.embedded_abstract(F.col(html)).alias("abstract"),
    )


def keyword_sentences(
    pages: DataFrame, html: str = "html", key: str = "page_id",
    keywords: tuple[str, ...] = text.KEYWORDS,
) -> DataFrame:
    """Sentences of the page text that mention a keyword, with their place in the page."""
    body = text.sentences(text.markup_text(F.col(html)))
    found = pages.select(key, F.posexplode(body).alias("sentence_no", "sentence"))
    return filter_keywords(found, "sentence", keywords)
