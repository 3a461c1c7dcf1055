"""Words and their counts over a whole table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 400_000


def words_of(text: str) -> list[bytes]:
    """The words of the text, A-Z lower-cased. As bytes: other letters and other white space stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD_WORDS:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs`` (text); each task counts before the shuffle."""
    return docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
