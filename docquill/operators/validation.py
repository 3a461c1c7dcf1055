"""Checks of tables, pages and uploads before they are processed."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a valid table (fixed values): characters, columns, repetition, confidence.
TABLE_CHARS, TABLE_COLUMNS, REPETITION, CONFIDENCE = 5000, 20, 0.7, 0.3


def _begins_another(known: list[str], word: str) -> bool:
    """Whether a longer one of the sorted words begins with ``word``."""
    at = bisect_left(known, word)
    return any(w != word and w.startswith(word) for w in known[at : at + 2])


def repeated_places(text: str, words: list[str], starts: list[int], sequence: int = 5, least: int = 3) -> int:
    """The places whose ``sequence`` words, with single spaces between them, occur ``least`` times in the text, without overlap; the last place is none.

    An occurrence may begin and end inside longer words, but the words between are
    whole; so places that share these are looked at together, and among them only
    those with words that end as the first word does and begin as the last one does.
    """
    n = len(words) - sequence + 1
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keys = np.zeros(n, np.int64)
    for k in range(1, sequence - 1):  # pairs of numbers in turn, each renumbered, so that the keys stay exact
        keys = np.unique(keys * len(number) + codes[k : k + n], return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(keys)[keys] >= least)  # the words between occur often enough
    single = lambda i: starts[i + 1] - starts[i] - len(words[i]) == 1 and text[starts[i + 1] - 1] == " "
    places: dict[int, list[int]] = {}
    for i in often.tolist():
        if all(map(single, range(i, i + sequence - 1))):
            places.setdefault(int(keys[i]), []).append(i)
    places = {k: v for k, v in places.items() if len(v) >= least}
    asked: dict[int, dict[tuple[str, str], int]] = {}
    for i in often.tolist():
        if i < n - 1 and (k := int(keys[i])) in places:
            of = asked.setdefault(k, {})
            ends = words[i], words[i + sequence - 1]
            of[ends] = of.get(ends, 0) + 1
    many = 0
    for k, of in asked.items():
        here = places[k]
        exact: dict[tuple[str, str], list[int]] = {}
        for i in here:
            exact.setdefault((words[i], words[i + sequence - 1]), []).append(i)
        firsts, lasts = sorted({f[::-1] for f, _ in exact}), sorted({z for _, z in exact})
        for (first, last), count in of.items():
            some = exact.get((first, last), [])
            if _begins_another(firsts, first[::-1]) or _begins_another(lasts, last):
                some = [i for i in here if words[i].endswith(first) and words[i + sequence - 1].startswith(last)]
            found, end = 0, -1
            for i in some:
                begin = starts[i] + len(words[i]) - len(first)
                if begin >= end:
                    found, end = found + 1, starts[i + sequence - 1] + len(last)
                    if found == least:
                        many += count
                        break
    return many


def repetition_score(text: str | None, sequence: int = 5) -> float:
    """0.7 of the share of repeated words and 0.3 of the places whose five words occur more than twice in the text, ten counting fully.

    Texts under 100 characters score 0. See :func:`repeated_places`.
    """
    found = [*re.finditer(r"\S+", text)] if text and len(text) >= 100 else []
    if not found:
        return 0.0
    words, starts = [m[0] for m in found], [m.start() for m in found]
    many = repeated_places(text, words, starts, sequence) if len(words) > sequence else 0
    return (1 - len(set(words)) / len(words)) * 0.7 + min(1.0, many / 10) * 0.3


def repetition_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of :func:`repetition_score` for every row; a batch where the rows are, without a shuffle. Null and short texts score 0."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([repetition_score(t) for t in texts], dtype=float)

    return df.select(id_col, score(text_col).alias("score"))


def table_confidence(chars: Column, columns: Column, repetition: Column, drawing: Column) -> Column:
    """Each failed check lowers the confidence by its factor."""
    factor = lambda bad, f: F.when(bad, f).otherwise(1.0)
    return factor(chars > TABLE_CHARS, 0.3) * factor(columns > TABLE_COLUMNS, 0.4) * factor(repetition > REPETITION, 0.2) * factor(drawing, 0.3)


def table_is_valid(chars: Column, columns: Column, repetition: Column, drawing: Column) -> Column:
    return ~((chars > TABLE_CHARS) | (columns > TABLE_COLUMNS) | (repetition > REPETITION) | drawing) & (table_confidence(chars, columns, repetition, drawing) >= CONFIDENCE)


def is_drawing_page(images: Column, blocks: Column, complexity: Column) -> Column:
    return ((images > 3) & (blocks < 10)) | (complexity.isin("complex", "very_complex") & (images > 0))


def page_complexity(meaningful: Column, items: Column, tables: Column, images: Column) -> Column:
    """The first that holds: images, vector drawing, tables, a diagram in pieces, text."""
    return (
        F.when(meaningful >= 2, "images").when(items >= 4000, "vector_drawing").when(tables > 0, "tables")
        .when((images >= 15) & (meaningful == 0) & (tables == 0), "diagram").otherwise("text_only")
    )


def is_fragmented(images: Column, small_of_first: Column) -> Column:
    return (images > 10) & (small_of_first >= 3)


def extraction_zoom(fragmented: Column, complexity: Column) -> Column:
    return F.when(fragmented, 3.0).when(complexity.isin("complex", "very_complex"), 2.0).otherwise(1.5)


def is_meaningful_image(width: Column, height: Column) -> Column:
    return (width >= 150) & (height >= 100) & (width * height >= 25_000)


def document_kind(text_percentage: Column, images: Column, pages: Column) -> Column:
    return (
        F.when(text_percentage < 10, "image_heavy_scan").when((text_percentage > 80) & (images < pages), "text_heavy")
        .when(images > pages * 2, "diagram_heavy").when(text_percentage > 50, "mixed_content").otherwise("low_text_content")
    )


def is_scanned(mean_chars: Column, threshold: float = 25.0) -> Column:
    return mean_chars < threshold


def scanned_confidence(mean_chars: Column, threshold: float = 25.0) -> Column:
    return F.when(mean_chars < threshold, F.greatest(F.lit(0.7), 1 - mean_chars / threshold)).otherwise(F.least(F.lit(0.9), mean_chars / (threshold * 10)))


def sample_pages(pages: Column) -> Column:
    """Pages to look at: all up to 10, 5 up to 50, else a tenth between 5 and 10."""
    return F.when(pages <= 10, pages).when(pages <= 50, 5).otherwise(F.least(F.lit(10), F.greatest(F.lit(5), F.floor(pages / 10).cast("int"))))


def processing_seconds(pages: Column, text: Column, complex_: Column, scanned: Column) -> Column:
    """A cautious estimate that ends on the next half minute; three tenths of the text pages are taken for scans."""
    moved = F.floor(text * F.lit(3) / F.lit(10))
    work = (text - moved) * 1.5 + complex_ * 6.0 + (scanned + moved) * 8.0
    total = work + 20 + pages * 0.5 + work * 0.2
    return F.greatest(F.lit(30), (F.floor(total / 30) + 1) * 30).cast("long")


def retry_delay(kind: Column, attempt: Column) -> Column:
    """Seconds to wait: doubling from 30 to 300 for rate limits, from 5 to 60 for time-outs and the network, else from 1 to 30."""
    twice = F.pow(F.lit(2.0), attempt)
    return F.when(kind == "rate_limit", F.least(F.lit(300.0), 30 * twice)).when(kind.isin("timeout", "network"), F.least(F.lit(60.0), 5 * twice)).otherwise(F.least(F.lit(30.0), twice)).cast("long")


def error_category(status: Column, message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(status == 429, "rate_limit").when((status >= 500) & (status < 600), "server_error").when(status >= 400, "http_error")
        .when(low.contains("rate") | low.contains("limit") | low.contains("throttle"), "rate_limit").when(low.contains("timeout"), "timeout").otherwise("unknown")
    )
