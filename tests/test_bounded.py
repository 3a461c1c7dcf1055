"""Steps that stay small when tables grow."""

import random

from pyspark.sql import functions as F

from docquill.operators import retrieval as R


def test_best_query_without_pairs(spark, monkeypatch):
    """The rows of all pairs' aggregate, ties and copies and odd vectors too, in one block of queries and in several; one row a chunk and block is shuffled."""
    rng = random.Random(3)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(60)] + [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[9]), (None, vectors[5])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    queries = chunks.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, R.best_of_chunk(R.score(chunks, queries)).collect()), key=str)
    for most in (4096, 5):
        monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
        assert sorted(map(tuple, R.best_query_of_each(chunks, queries).collect()), key=str) == want
    assert R.best_query_of_each(chunks, queries.limit(0)).count() == 0


def test_answers_are_read_a_few_at_a_time():
    """A batch of 1,000 long answers is never whole in Python strings: beside its result less than two answers' worth of what it holds is added at a time."""
    import tracemalloc

    import pyarrow as pa

    from docquill.functions import repair

    texts = ['{"a": "' + str(i) + "x" * 20_000 + '"}' for i in range(1000)] + [None, "", "no {"]
    column = pa.array(texts, pa.string())
    want = [repair.find_object(t) for t in texts]
    tracemalloc.start()  # Python's own memory, without Arrow's
    got = repair._found(repair.find_object, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want and peak < 5e6
    assert repair._found(repair.find_object, pa.array([], pa.string())).to_pylist() == []
    assert repair._found(repair.find_checklist, column, column).to_pylist() == [repair.find_checklist(t, t) for t in texts]


def test_cells_of_a_table_are_read_once(spark):
    """The plan has the reading of cells in one place, and the repetition is asked for after the other checks."""
    from docquill.operators.tables import table_elements

    pages = spark.createDataFrame([(1, "<table><tr><td>a  b</td><td>x<b>y</b></td></tr></table>"), (2, "<table><tr>" + "<td>a</td>" * 21 + "</tr></table>"), (3, None)], "id long, html string")
    out = table_elements(pages, "id", "html")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<t[dh]") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "table_1", "| a b | x y |\n| --- | --- |", 1, 2)]
