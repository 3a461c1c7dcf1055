"""Substring deduplication by hashing lines, cut at the ends of their sentences.

Whole lines find passages that stand on lines of their own, but not a passage
inside a longer line. So a line is hashed in pieces that end where a sentence
does; a piece without such a mark for ``LONG`` words is cut after the words whose
own hashes say so. All cuts depend on the words next to them and not on what
comes before, so a passage that is copied into another line is cut up alike.

Pieces are normalised (lower case, one space between words) and hashed. Digests
are counted globally; those that repeat make a Bloom filter, and only the pieces
that it lets through are grouped, and of each group the occurrence with the smallest rank
(id, row, place) stays. In every document the other occurrences that follow each
other are a run. A repeated line is a run of all its pieces, a paragraph one of
all its lines. Runs of ``least_words`` words or more go, with their offsets in the
original text retained. The default spares a short formula that stands in many
texts; with one, every repeated line and sentence goes.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquill.llm.bloom import build_filter, filter_words, test_filter
from docquill.llm.common import WORD, id_and_text
from docquill.scratch import materialize, release

#: Words of a run that is removed; words of a piece that is cut by its words' hashes, at one word in ``CUT``.
LEAST_WORDS, LONG, CUT = 15, 40, 10

#: Pieces of an Arrow batch.
BATCH_PIECES = 100_000

#: A piece of a line: up to marks that end a sentence and are followed by white space, or to the end of the line. Possessive, so that no place is kept to come back to.
_PIECE = re.compile(r"(?:[^\n.!?…。।؟]++|[.!?…。।؟]+(?![\s.!?…。।؟\"'”’)\]]|$)|[.!?…。।؟]+[\"'”’)\]]+(?!\s|$))++(?:[.!?…。।؟]+[\"'”’)\]]*)?|[.!?…。।؟]+[\"'”’)\]]*")
#: Characters that are split into words at a time to see whether a piece is long.
_STRETCH = 1 << 16
_WORD = re.compile(WORD)


def _cut_long(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, int]]:
    held, n, first = io.StringIO(), 0, start  # one string, as a piece may have any number of words
    for m in _WORD.finditer(text, start, end):
        word = m[0].lower()
        first = first if n else m.start()
        held.write(f" {word}" if n else word)
        n += 1
        if zlib.crc32(word.encode("utf-8", "surrogatepass")) % CUT == 0 or m.end() == end:
            yield first, m.end(), held.getvalue(), n
            held, n = io.StringIO(), 0
    if n:
        yield first, end, held.getvalue(), n


def pieces(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised text, number of words) of each piece with a word, in order."""
    for m in _PIECE.finditer(text):
        part = m[0]
        long = len(part) > _STRETCH and any(len(part[i : i + _STRETCH].split()) > LONG + 1 for i in range(0, len(part), _STRETCH))
        words = [] if long else part.lower().split()
        if not words and not long:
            continue
        start = m.start() + len(part) - len(part.lstrip())
        end = m.start() + len(part.rstrip())
        if long or len(words) > LONG:
            yield from _cut_long(text, start, end)
        else:
            yield start, end, " ".join(words), len(words)


def _piece_batches(id_type: pa.DataType):
    names = ["doc_id", "row", "k", "start", "end", "words", "h"]
    kinds = (id_type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)
        for batch in batches:
            for doc, row, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row")], batch.column("text"), strict=True):
                for k, (start, end, norm, n) in enumerate(pieces(text.as_py())):
                    for column, value in zip(out, (doc, row, k, start, end, n, digest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)), strict=True):
                        column.append(value)
                    if len(out[0]) >= BATCH_PIECES:
                        yield whole()
                        out = [[] for _ in names]
        if out[0]:
            yield whole()

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per removed span: doc_id, row, start, end, n_words, n_pieces, first_doc_id, first_start.

    ``start`` and ``end`` are code points of the original text, the end
    exclusive; the first occurrence is that of the span's first piece. The
    smallest id keeps its text, null ids come last, and rows that share an id are
    ordered by their place in the table; of rows that repeat all but one lose
    their spans, and of a line that repeats in one text all but the first go.
    Null and empty texts have no pieces; texts of any length are read whole.
    Other columns are not looked at; an empty table gives an empty result.
    """
    return _spans(id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), least_words)


def _spans(read: DataFrame, least_words: int) -> DataFrame:
    """:func:`repeated_spans` of rows (doc_id, text, row)."""
    kind = read.schema["doc_id"].dataType
    found = materialize(read.mapInArrow(_piece_batches(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, row long, k int, start int, end int, words int, h long"), "pieces")
    # pass one moves bare digests; only pieces whose digest may be repeated move with their places
    repeated = materialize(found.groupBy("h").count().where("count > 1").select("h"), "repeated-digests")
    words = filter_words(repeated.count())
    suspects = test_filter(found, "h", materialize(build_filter(repeated, "h", words), "filter"), words, "maybe").where("maybe").drop("maybe")
    suspects = materialize(suspects, "suspects")
    release(read.sparkSession, found, repeated)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"), F.col("k").alias("k"), F.col("start").alias("start"))
    firsts = suspects.groupBy("h").agg(F.min(rank).alias("origin"), F.count("*").alias("copies")).where("copies > 1").select("h", "origin")
    firsts = materialize(firsts, "repeated")  # so that the join can split a piece that is everywhere
    again = suspects.join(firsts, "h").where((F.col("row") != F.col("origin.row")) | (F.col("k") != F.col("origin.k")))
    run = F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k"))  # the pieces of one text
    spans = again.withColumn("run", run).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("int").alias("n_words"), F.count("*").cast("int").alias("n_pieces"),
        F.min_by("origin", "k").alias("origin"),
    )
    spans = materialize(spans.where(F.col("n_words") >= least_words), "spans")
    release(read.sparkSession, suspects, firsts)
    return spans.select("doc_id", "row", "start", "end", "n_words", "n_pieces", F.col("origin.id").alias("first_doc_id"), F.col("origin.start").alias("first_start"))


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def without(text: str, spans) -> str:
        at, kept = 0, []
        for span in sorted(spans, key=lambda s: s["start"]):
            kept.append(text[at : span["start"]])
            at = max(at, span["end"])
        return "".join([*kept, text[at:]])

    for frame in frames:
        frame["text"] = [without(t, s) for t, s in zip(frame["text"], frame["removed"], strict=True)]
        yield frame


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the text without its removed spans, and ``removed``: the spans (start, end) in the original text.

    A row's spans are its own, whatever its id: rows that share an id, or have none,
    are rows of their own, and cases are treated as in :func:`repeated_spans`. The
    rows are written once, with their places in the table.
    """
    rows = materialize(id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows-of-repeats")
    by_row = _spans(rows, least_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    none = F.array().cast(by_row.schema["removed"].dataType)
    read = rows.join(by_row, "row", "left").withColumn("removed", F.coalesce("removed", none))
    return read.select("doc_id", "text", "removed").mapInPandas(_cut, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text string, removed array<struct<start:int,end:int>>")
