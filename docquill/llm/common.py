"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.plans.model import table  # noqa: F401  the queries' tables

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column if isinstance(column, Column) else F.col(f"`{column}`"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column's name matters."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n (null: -1)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(-1))
