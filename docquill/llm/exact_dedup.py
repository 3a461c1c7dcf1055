"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every normalised text and counts how often each bit of a Bloom
filter is hit; a bit that is hit twice stays set. Pass two tests each hash
against the filter, which is broadcast: a hash that misses it is certainly
unique and passes straight through; the others, and only those, shuffle to be
grouped exactly. Copies are pre-aggregated in each task, so that one group with
a third of all rows does not land in one task.

A filter is bounded by ``max_bits``. Where that leaves less than ``LEAST_BITS``
bits a row, the hashes are divided by range into as many parts as it takes, each
with a filter of its own that is tested on its part only; so the share of unique
rows that pass straight through does not fall as the table grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.llm.bloom import BITS_PER_ROW, MAX_BITS, build_filter, filter_words, test_filter
from docquill.llm.common import SPACE, id_and_text, text_of
from docquill.scratch import materialize, release

#: Least bits of a filter for each row of its part: with eight, 95 unique rows of a hundred pass.
LEAST_BITS = 8


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text after each run of ASCII white space became one space."""
    return F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256)


def _tested(digests: DataFrame, bits_per_row: int, max_bits: int) -> DataFrame:
    """``digests`` (with ``h``) with ``maybe``: whether another row may have the same hash. Written; one filter is alive at a time."""
    rows = digests.count()
    parts = -(-rows * LEAST_BITS // max_bits) or 1
    words = filter_words(-(-rows // parts), bits_per_row, max_bits)
    if parts == 1:
        return materialize(test_filter(digests, "h", build_filter(digests, "h", words, least=2), words, "maybe"), "tested-digests")
    dealt = materialize(digests.withColumn("part", F.pmod(F.shiftrightunsigned("h", 54), F.lit(parts)).cast("int")), "digest-parts", by="part")
    tested = []
    for p in range(parts):  # each part is read from its own folder and has its own filter, which goes when the part is written
        part = dealt.where(F.col("part") == p).drop("part")
        sieve = materialize(build_filter(part, "h", words, least=2), "filter")
        tested.append(materialize(test_filter(part, "h", sieve, words, "maybe"), "tested-digests"))
        release(digests.sparkSession, sieve)
    release(digests.sparkSession, dealt)
    return reduce(DataFrame.unionByName, tested)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    read = id_and_text(docs, id_col, text_col).select("doc_id", text_sha256(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    return materialize(read.withColumn("h", F.xxhash64("text_sha256")), "digests")


def _groups(suspects: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    return suspects.groupBy("text_sha256").agg(first, F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space
    became one space; null counts as empty. Of equal texts the row with the
    smallest id stays, ids that are null come last, and of rows that also share
    the id exactly one stays. Texts of any length are hashed whole. Other columns
    are not looked at; an empty table gives an empty result.
    """
    digests = _digests(docs, id_col, text_col)
    tested = _tested(digests, bits_per_row, max_bits)
    release(docs.sparkSession, digests)
    alone = tested.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = tested.where("maybe").drop("maybe", "h")
    # written, so that both sides of the join are plain exchanges, and a hot hash can be split
    grouped = suspects.join(materialize(_groups(suspects), "groups"), "text_sha256").select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    The hashes that do repeat are found on narrow rows and make a second filter;
    rows whose hash misses it pass straight through, and only the others move
    with their texts, reduced to the first row of each group in each task before
    the shuffle. Ties, nulls and long texts are treated as in
    :func:`exact_duplicates`; rows that share id and text give one row; an empty
    table gives an empty one.
    """
    digests = _digests(docs, id_col, text_col)
    suspects = _tested(digests, bits_per_row, max_bits).where("maybe").drop("maybe")
    repeated = materialize(suspects.groupBy("text_sha256", "h").count().where("count > 1").select("h"), "repeated-hashes")
    words = filter_words(repeated.count(), bits_per_row, max_bits)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), text_sha256(text_of(text_col)).alias("sha"), F.xxhash64(F.col(f"`{text_col}`")).alias("written"))
    tested = test_filter(rows.withColumn("h", F.xxhash64("sha")), "h", materialize(build_filter(repeated, "h", words), "filter"), words, "maybe")
    release(docs.sparkSession, digests, repeated)
    first = tested.where("maybe").groupBy("sha").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "written")).alias("row"))
    return tested.where("NOT maybe").select("row.*").unionByName(first.select("row.*"))
