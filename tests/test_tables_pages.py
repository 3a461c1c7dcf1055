"""Keyed tables, deep pages and cascading deletes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docquill.operators import cascade as K
from docquill.operators import pages
from docquill.operators.pages import By
from docquill.sources.tables import fresh_name, has_named, named_path, read_keyed, upsert_named


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


# keyed tables


def test_two_runs_leave_one_row_a_key(spark):
    name, kinds = fresh_name("keyed"), "k long, v string, w long"
    upsert_named(spark.createDataFrame([(i, f"old {i}", i) for i in range(200)] + [(None, "none", 0)], kinds), name, ["k"])
    assert has_named(spark, name) and read_keyed(spark, name).count() == 201
    upsert_named(spark.createDataFrame([(i, f"new {i}", -i) for i in range(150, 250)] + [(None, "nil", 1)], kinds), name, ["k"])
    want = [(i, f"old {i}", i) for i in range(150)] + [(i, f"new {i}", -i) for i in range(150, 250)] + [(None, "nil", 1)]
    assert listed(read_keyed(spark, name)) == sorted(want, key=str)
    upsert_named(spark.createDataFrame([(7, "only v")], "k long, v string"), name, ["k"])  # the other column stays
    assert listed(read_keyed(spark, name).where("k = 7")) == [(7, "only v", 7)]


def test_only_folders_with_a_new_key_are_written(spark):
    name = fresh_name("keyed")
    upsert_named(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v")), name, ["k"])
    files = lambda: set(spark.read.parquet(named_path(spark, name, None)).inputFiles())
    before = files()
    upsert_named(spark.createDataFrame([(3, "b")], "k long, v string"), name, ["k"])
    folder = lambda f: f.rsplit("/", 2)[1]
    assert len({folder(f) for f in files() ^ before}) == 1 and read_keyed(spark, name).where("v = 'b'").count() == 1 and read_keyed(spark, name).count() == 500


def test_of_rows_with_one_key_the_newest_stays(spark):
    name = fresh_name("keyed")
    upsert_named(spark.createDataFrame([(1, "a", 3), (1, "b", 5), (1, "c", 4), (2, "d", 1)], "k long, v string, at long"), name, ["k"], newest="at")
    assert listed(read_keyed(spark, name)) == [(1, "b", 5), (2, "d", 1)]


def test_a_failed_run_leaves_the_old_table(spark):
    name = fresh_name("keyed")
    upsert_named(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), name, ["k"])
    before = listed(read_keyed(spark, name))
    bad = spark.range(80, 120).select(F.col("id").alias("k"), F.when(F.col("id") == 119, F.raise_error(F.lit("no")).cast("string")).otherwise("b").alias("v"))
    with pytest.raises(Exception, match="no"):
        upsert_named(bad, name, ["k"])
    assert listed(read_keyed(spark, name)) == before


# pages


@pytest.fixture(scope="module")
def paged(spark):
    rng = random.Random(2)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([None, *[day + datetime.timedelta(hours=rng.randrange(200)) for _ in range(9)], day]), rng.choice([None, *range(-5, 20)]), rng.choice(["", "a", "abcdefgh1", "abcdefgh2", "é", None]), i) for i in range(1200)]
    return spark.createDataFrame(rows, "t timestamp, n int, s string, i long").repartition(4)


ORDERS = [[By("t", True), By("n"), By("i")], [By("t"), By("n", True), By("i", True)], [By("s"), By("i")], [By("s", True), By("n"), By("i", True)], [By("i")], [By("n"), By("t", True), By("s"), By("i")]]


@pytest.mark.parametrize("k", range(len(ORDERS)))
def test_deep_pages(paged, monkeypatch, k):
    monkeypatch.setattr(pages, "SORTED", 40)
    monkeypatch.setattr(pages, "RANGES", 8)
    by = ORDERS[k]
    whole = [r.i for r in paged.orderBy(*[b.order() for b in by]).collect()]
    for offset in (0, 35, 600, 1195):
        page = pages.page_at(paged, by, 20, offset)
        assert [r.i for r in page.collect()] == whole[offset : offset + 20]
    token = pages.token_of(page, by)
    assert pages.page_after(paged, by, token, 5).count() == 0 and pages.page_at(paged, by, 20, 1200).count() == 0
    token = pages.token_of(pages.page_at(paged, by, 10, 300), by)
    assert [r.i for r in pages.page_after(paged, by, token, 20).collect()] == whole[310:330]
    assert pages.token_of(paged.limit(0), by) is None and [r.i for r in pages.page_after(paged, by, None, 3).collect()] == whole[:3]


def test_ties_in_all_columns(spark, monkeypatch):
    monkeypatch.setattr(pages, "SORTED", 10)
    rows = spark.range(300).select((F.col("id") % 3).alias("a"))
    assert [r.a for r in pages.page_at(rows, [By("a")], 8, 95).collect()] == [0] * 5 + [1] * 3


def test_only_a_range_is_sorted(spark):
    rows = spark.range(1_200_000).select(F.xxhash64("id").alias("a"), "id")
    some, rest = pages.row_range(rows, [By("a"), By("id")], 1_000_000)
    assert some.count() <= pages.SORTED and rest < some.count()
    first = pages.page_at(rows, [By("a"), By("id")], 1, 1_000_000).first()
    assert rows.where(F.col("a") < first.a).count() == 1_000_000


# cascades


def test_order_of_deletion():
    keys = [K.ForeignKey("b", "a", "a", "id"), K.ForeignKey("c", "b", "b", "id"), K.ForeignKey("c", "c", "c", "id"), K.ForeignKey("d", "e", "e", "id"), K.ForeignKey("e", "d", "d", "id"), K.ForeignKey("d", "a", "a", "id")]
    order = K.deletion_order(list("abcde"), keys)
    assert sorted(map(tuple, order)) == [("a",), ("b",), ("c",), ("d", "e")]
    at = {t: i for i, c in enumerate(order) for t in c}
    assert at["c"] < at["b"] < at["a"] and at["d"] < at["a"]


def test_cascades_follow_circles_and_null_references(spark):
    t = {
        "users": spark.createDataFrame([(1,), (2,)], "id long"),
        "runs": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, user long"),
        "notes": spark.createDataFrame([(i, i - 1 if i % 20 else None, 10 if i == 3 else None) for i in range(1, 40)], "id long, parent long, run long"),
        "logs": spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, run long"),
    }
    keys = [K.ForeignKey("runs", "user", "users", "id"), K.ForeignKey("notes", "parent", "notes", "id"), K.ForeignKey("notes", "run", "runs", "id"), K.ForeignKey("logs", "run", "runs", "id", "set null")]
    left = K.cascade(t, {n: ["id"] for n in t}, keys, {"users": t["users"].where("id = 1")})
    ids = {n: sorted(r.id for r in df.collect()) for n, df in left.items()}
    assert ids == {"users": [2], "runs": [11, 12], "notes": [1, 2, *range(20, 40)], "logs": [1, 2, 3]}
    assert {r.id: r.run for r in left["logs"].collect()} == {1: None, 2: 11, 3: None}
    untouched = K.cascade(t, {n: ["id"] for n in t}, keys, {"users": t["users"].limit(0)})
    assert {n: df.count() for n, df in untouched.items()} == {n: df.count() for n, df in t.items()}
