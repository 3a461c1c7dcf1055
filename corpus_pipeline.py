"""A corpus pipeline: quality, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage is written as Parquet and read again
before the next one starts, and the table before it is deleted then. Null texts
count as empty, texts of any length are read whole, an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.bpe import default_tokenizer
from docquill.llm.common import table
from docquill.llm.exact_dedup import drop_exact_duplicates
from docquill.llm.mixing import mix_sources
from docquill.llm.quality import keep_good
from docquill.llm.queries import bpe_digests
from docquill.llm.simhash import keep_one_each
from docquill.scratch import materialize, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is scored as an empty one."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, null ids last."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the smallest id stays, null ids last; rows that share an id are documents of their own."""
    return keep_one_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document; the columns are those of ``docs``, one named mix included."""
    whole = docs.select(F.struct("*").alias("row"), *[F.col(c).alias(c) for c in ("doc_id", "text", "source")])
    taken = mix_sources(whole).where("mix.copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies"))).alias("copy")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row for each copy."""
    return bpe_digests(docs, default_tokenizer())


STAGES = [("quality", quality), ("exact copies", exact), ("near copies", near), ("mixture", mixture), ("tokens", tokens)]

#: No SQL has the classifier, the fingerprints' links, the mix or the tokens; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        made = materialize(made, f"stage-{i}")
        if i:
            release(spark, docs)
        docs = made
