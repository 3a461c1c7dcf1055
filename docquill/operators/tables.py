"""Tables in web markup as elements: Markdown text, a name by place, and a check of what is a table at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.operators.validation import repetition_score, table_is_valid
from docquill.sources.html import visible_text


def cells(table: Column) -> Column:
    """The rows of a table, each an array of its cells' visible texts; rows without a cell are left out."""
    of_row = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), visible_text)
    rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1)), of_row)
    return F.filter(rows, lambda r: F.size(r) > 0)


def markdown(rows: Column) -> Column:
    """A line for each row with bars around its cells, and a rule below the first one."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.transform(rows[0], lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(rows[0])), F.array(line(rule)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def table_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_id, text, n_rows, n_columns) of the valid tables of each page; ``table_id`` counts all tables of the page from ``table_1`` on.

    Nested tables are read as part of the outer one's first row. A table without a
    cell is none; null markup has no table.
    """

    @F.pandas_udf("double")
    def repetition(texts: pd.Series) -> pd.Series:
        return pd.Series([repetition_score(t) for t in texts], dtype=float)

    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"), F.lit(1))).alias("place", "markup"))
    once = lambda c: F.explode(F.array(c))  # a generator's row is worked out once; a projection would be repeated in each filter above it
    rows = found.select(id_col, F.concat(F.lit("table_"), (F.col("place") + 1).cast("string")).alias("table_id"), once(cells(F.col("markup"))).alias("rows")).where(F.size("rows") > 0)
    widest = F.array_max(F.transform("rows", F.size))
    t = rows.select(id_col, "table_id", once(F.struct(markdown(F.col("rows")).alias("text"), F.size("rows").alias("n_rows"), widest.alias("n_columns"))).alias("t")).select(id_col, "table_id", "t.*")
    t = t.where(table_is_valid(F.length("text"), F.col("n_columns"), F.lit(0.0), F.lit(False))).withColumn("repetition", repetition("text"))  # the costly check for those that pass the others
    return t.where(table_is_valid(F.length("text"), F.col("n_columns"), F.col("repetition"), F.lit(False))).drop("repetition")
