"""Results of checklist analyses: cleaning, fallbacks, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed states of a result (fixed values).
STATUSES = ("found", "missing", "risk", "conditions", "pending_clarification")


def clean_text(c: Column) -> Column:
    return F.when(~F.lower(c).isin("null", "none", ""), c)


def clean_results(raw: DataFrame) -> DataFrame:
    """``raw`` (status, score, excerpt and page as text) with valid states, scores from 0 to 1 and whole pages; what cannot be read is null."""
    score = F.col("score").try_cast("double")
    status = F.lower("status")
    return raw.withColumns({
        "status": F.when(status.isin(*STATUSES), status).otherwise("missing"),
        "score": F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))),
        "excerpt": clean_text(F.col("excerpt")), "page": F.col("page").try_cast("int"),
    })


def fallback(items: DataFrame, message: str) -> DataFrame:
    """A result to be clarified for every item (item_number, item_name)."""
    return items.select("item_number", "item_name", F.lit("pending_clarification").alias("status"), F.lit(message).alias("description"), F.lit(0.0).alias("confidence"))


def pages_label(pages: Column, shown: int = 3) -> Column:
    """The first pages and how many more there are."""
    first = F.array_join(F.slice(pages, 1, shown).cast("array<string>"), ", ")
    return F.concat(first, F.when(F.size(pages) > shown, F.concat(F.lit(" and "), (F.size(pages) - shown).cast("string"), F.lit(" more"))).otherwise(""))
