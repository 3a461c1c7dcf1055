"""Documents that are larger than a task should hold give what windows over the whole document give."""

import collections

import pytest
from pyspark.sql import functions as F

from docquill.operators import chunking, elements, segments
from docquill.plans import model
from tests.conftest import SF


def rows(df):
    return collections.Counter(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def documents(spark):
    """Documents of 1 to 300 elements, one of them with no id, with many headings, list items and short texts."""
    e = model.elements(spark, SF).where("doc_id < 60")
    one = e.withColumn("seq", F.col("doc_id") * 1000 + F.col("seq")).withColumn("page", F.floor(F.col("seq") / 40) + 1).withColumn("doc_id", F.lit(-1).cast("long"))
    none = one.where("seq < 9000").withColumn("doc_id", F.lit(None).cast("long"))
    short = F.when(F.col("seq") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    from docquill.scratch import materialize

    return materialize(e.unionByName(one).unionByName(none).withColumn("text", short), "elements")


@pytest.fixture(scope="module")
def big(documents):
    found = segments.giants(documents, ["doc_id"], 5)
    assert found is not None and found.where("doc_id = -1").count() == 1
    return found


def test_no_giants(documents):
    assert segments.giants(documents, ["doc_id"]) is None


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_running_values(documents, big, bits):
    last = {"title": F.when(F.col("category") == "Title", F.struct("n", "seq"))}
    args = (["doc_id"], ["seq"])
    assert rows(segments.running(documents, *args, big, "n", last, bits)) == rows(segments.running(documents, *args, None, "n", last))


@pytest.fixture(params=[1, 3])
def small_segments(request, monkeypatch):
    monkeypatch.setattr(segments.running, "__defaults__", (*segments.running.__defaults__[:-1], request.param))


def test_sections(documents, big, small_segments):
    e = documents.withColumn("phase", F.when(F.col("category") == "UncategorizedText", 1).otherwise(0))
    assert rows(elements.inherit_sections(e, big)) == rows(elements.inherit_sections(e))


def test_list_groups(documents, big, small_segments):
    kept = chunking.filter_noise(documents)
    assert rows(chunking.group_lists(kept, 3, big)) == rows(chunking.group_lists(kept, 3))


def test_merged_content(documents, big, small_segments):
    assert rows(chunking.merge_small(documents, big=big)) == rows(chunking.merge_small(documents))


@pytest.mark.parametrize("ceiling,most,bits", [(2000, 10, 4), (300, 3, 2), (100_000, 100, 5), (10, 1, 0), (5000, 16, 4)])
def test_batches(documents, big, ceiling, most, bits):
    t = documents.select("doc_id", "seq", (F.length("text") * 1.8).cast("long").alias("tokens"))
    assert rows(chunking.token_batches(t, "doc_id", ceiling, most, big, bits)) == rows(chunking.token_batches(t, "doc_id", ceiling, most))


def test_batches_of_all_elements_as_one_group(spark):
    """Every element of a table in one group, over many tasks."""
    e = model.elements(spark, "/root/testdata/sf0.01")
    t = e.select(F.lit(1).alias("g"), (F.col("doc_id") * 100_000 + F.col("seq")).alias("seq"), (F.length("text") * 1.8).cast("long").alias("tokens"))
    found = chunking.token_batches(t, "g", 5000, 20, segments.giants(t, ["g"], 1000), 8)
    assert rows(found) == rows(chunking.token_batches(t, "g", 5000, 20))


def test_a_large_document_is_many_segments(spark):
    n = 200_000
    one = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("seq"), (F.col("id") / 50).cast("long").alias("page"),
                                F.when(F.col("id") % 13 == 0, "NarrativeText").otherwise("ListItem").alias("category"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    table = segments.numbered(one, ["doc_id"], ["seq"], 12)
    parts = table.groupBy(F.shiftright("__at", 33).alias("task")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * n  # ranges, not one task a document
    assert table.groupBy("__segment").count().agg(F.max("count")).first()[0] <= 4096
    big = segments.giants(one, ["doc_id"], 100_000)
    grouped = chunking.group_lists(one, 10, big)
    assert grouped.where("category = 'List'").count() == -(-n // 13) and grouped.where("category = 'ListItem'").count() == sum(max(0, min(13, n - k) - 11) for k in range(0, n, 13))
