"""Ordered elements of documents: section inheritance and element tables from other sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.functions.text import is_major_section, numbered_title
from docquill.operators.segments import running


def inherit_sections(elements: DataFrame, big: DataFrame | None = None) -> DataFrame:
    """``elements`` (doc_id, seq, page, category, text, phase) with ``section``.

    Phase 0 is text, in page order; phase 1 tables, in list order; phase 2 page
    images, which read only. A major numbered heading becomes the section of its
    page and of the document. An element inherits its page's section as of then,
    else the document's, else none. ``big`` has the documents that are too large
    for a task (:mod:`segments`).
    """
    text, category = F.col("text"), F.col("category")
    title = numbered_title(text, category)
    major = F.when((F.col("phase") < 2) & is_major_section(text, category), title)
    place = F.when(F.col("phase") == 1, F.lit(0)).otherwise(F.col("page"))
    e = elements.withColumn("__major", major).withColumn("__place", place)
    e = running(e, ["doc_id", "page"], ["phase", "seq"], big, last={"__of_page": F.col("__major")})
    e = running(e, ["doc_id"], ["phase", "__place", "seq"], big, last={"__of_document": F.col("__major")})
    return e.withColumn("section", F.coalesce("__of_page", "__of_document")).drop("__major", "__place", "__of_page", "__of_document")


def scaled_box(box: Column, width: Column, height: Column, page_width: Column, page_height: Column, dpi: float = 200.0) -> Column:
    """A pixel box (x0, y0, x1, y1) in points: by the page's size where the layout's is known, else by the resolution."""
    x, y = F.coalesce(page_width / width, F.lit(72 / dpi)), F.coalesce(page_height / height, F.lit(72 / dpi))
    return F.array(*[box[i] * (x if i % 2 == 0 else y) for i in range(4)])


def normalize_ocr(raw: DataFrame) -> DataFrame:
    """OCR output (doc_id, seq, category, page, text, box, visual): a null page is 1, and of visual pages only tables stay; boxes become points."""
    kept = raw.where(~F.col("visual") | (F.col("category") == "Table"))
    return kept.withColumn("page", F.coalesce("page", F.lit(1))).withColumn("box", scaled_box(F.col("box"), F.lit(None), F.lit(None), F.lit(None), F.lit(None)))


def page_context(images: DataFrame, elements: DataFrame, first: int = 5) -> DataFrame:
    """(doc_id, page, context): the first texts of an image's page, one a line."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    few = elements.withColumn("rn", rank).where(F.col("rn") <= first)
    context = few.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("context"))
    return images.select("doc_id", "page").join(context, ["doc_id", "page"], "left")
