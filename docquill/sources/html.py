"""Raw web pages: the text that a reader sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; white space collapsed. Entities stay as they are."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.when(html.contains("<"), F.regexp_replace(t, "<[^>]*>", " ")).otherwise(html)  # most cells of tables have no mark-up
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
