"""PDF files by Spark's binary source; the parser is a provider, as none is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, page int, block int, category string, text string, font_size double, bbox array<double>"

Parser = Callable[[bytes], Iterator[tuple[int, int, str, str, float, list[float]]]]


def read_pdf_blocks(spark: SparkSession, paths: str, parser: Parser) -> DataFrame:
    """Text blocks of all files: one file is read by one task; blank blocks are skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(path, *block) for block in parser(bytes(content)) if block[3].strip()]
                yield pd.DataFrame(rows, columns=["path", "page", "block", "category", "text", "font_size", "bbox"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, SCHEMA)
