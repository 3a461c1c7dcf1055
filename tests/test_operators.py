"""Hand fixtures for the operators whose order or edge cases matter."""

import math

import pytest

from pyspark.sql import functions as F

from docquill import config
from docquill.functions import repair
from docquill.functions import text as T
from docquill.functions import vectors as V
from docquill.operators import boxes, checklist, chunking, clustering, elements, limiter, retrieval, validation


def one(df):
    return df.collect()[0][0]


def scalar(spark, text, column):
    return one(spark.createDataFrame([(text,)], "text string").select(column))


def els(spark, *rows):
    return spark.createDataFrame([(1, i, 1, c, t) for i, (c, t) in enumerate(rows)], "doc_id long, seq long, page long, category string, text string")


def test_list_grouping_takes_ten_items(spark):
    out = chunking.group_lists(els(spark, ("NarrativeText", "n"), *[("ListItem", f"i{k}") for k in range(12)])).orderBy("seq").collect()
    assert [r.category for r in out] == ["List", "ListItem", "ListItem"]
    assert out[0].text == "n\n\n" + "\n".join(f"i{k}" for k in range(10))


def test_list_items_without_narrative_stay(spark):
    out = chunking.group_lists(els(spark, ("ListItem", "a"), ("NarrativeText", "n"), ("ListItem", "b"), ("ListItem", "c"))).orderBy("seq").collect()
    assert [r.category for r in out] == ["ListItem", "List"]


def test_merge_small(spark):
    texts = ["a" * 40, "b" * 30, "c" * 150, "d" * 20]
    out = chunking.merge_small(els(spark, *[("NarrativeText", t) for t in texts])).orderBy("seq").collect()
    assert [(r.category, r.merged) for r in out] == [("MergedContent", 2), ("NarrativeText", 1), ("NarrativeText", 1)]
    assert out[0].text == "a" * 40 + "\n\n" + "b" * 30


@pytest.mark.parametrize("text,want", [("1.2 Foundation works", True), ("1.2.3 Foundation works", False), ("3. ab", False), ("2 Short", False), ("1.2 Foundation wor-", False)])
def test_major_section(spark, text, want):
    assert scalar(spark, text, T.is_major_section(F.col("text"), F.lit("NarrativeText"))) is want


def test_section_inheritance(spark):
    rows = [(0, 1, "1.2 Alpha section title", "Title"), (1, 1, "text", "NarrativeText"), (2, 2, "text", "NarrativeText"), (3, 2, "2.2 Beta section title", "Title"), (4, 2, "text", "NarrativeText")]
    e = spark.createDataFrame([(1, s, p, c, t, 0) for s, p, t, c in rows] + [(1, 9, 1, "Image", "", 2), (1, 10, 3, "Image", "", 2)], "doc_id long, seq long, page long, category string, text string, phase int")
    got = [r.section[:3] for r in elements.inherit_sections(e).orderBy("seq").collect()]
    assert got == ["1.2", "1.2", "1.2", "2.2", "2.2", "1.2", "2.2"]


def test_cosine(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        v.where("size(a) = 1").select(V.cosine_strict(F.col("a"), F.col("b"))).collect()


def test_token_batches(spark):
    t = spark.createDataFrame([("g", 1, 54_000), ("g", 2, 54_000), ("g", 3, 1)], "g string, seq long, tokens long")
    assert [r.batch for r in chunking.token_batches(t, "g").orderBy("seq").collect()] == [0, 1, 1]


def test_retry_delay(spark):
    rows = [("rate_limit", a) for a in range(5)] + [("timeout", a) for a in range(5)] + [("other", a) for a in range(6)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, a int").select(validation.retry_delay(F.col("k"), F.col("a"))).collect()]
    assert got == [30, 60, 120, 240, 300, 5, 10, 20, 40, 60, 1, 2, 4, 8, 16, 30]


def test_cluster_count(spark):
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (3, 79, 100, 199, 500)], "n int").select(clustering.cluster_count(F.col("n"))).collect()] == [4, 4, 5, 9, 10]


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 10.0, 10.0]), (1, 1, 1, [0.5, 0.0, 10.0, 10.0]), (1, 1, 2, [0.0, 0.0, 20.0, 20.0]), (1, 2, 0, None), (1, 2, 1, [5.0, 5.0, 5.0, 9.0])], "doc_id long, page long, seq long, box array<double>")
    assert [tuple(r.box) for r in boxes.drop_repeated_boxes(b).collect()] == [(0.0, 0.0, 20.0, 20.0)]


@pytest.mark.parametrize("text,want", [("12", True), ("1,5", True), ("AB", True), ("7B", True), ("XIV", True), ("ab", False), ("-", False), ("", False)])
def test_meaningful_small(spark, text, want):
    assert scalar(spark, text, T.is_meaningful_small(F.col("text"))) is want


@pytest.mark.parametrize("name,want", [("Ærø – Übersicht ½ ﬁn.pdf", "r_Ubersicht_12_fin.pdf"), ("ｆｕｌｌ ｗｉｄｔｈ.txt", "full_width.txt"), ("日本.pdf", "file.pdf"), ("a__b--c d.pdf", "a_b-c_d.pdf"), ("", "unnamed_file")])
def test_file_names(spark, name, want):
    assert scalar(spark, name, T.sanitized_filename(F.col("text"))) == want


def test_document_kind(spark):
    rows = [(5, 0, 10), (90, 5, 10), (60, 30, 10), (60, 15, 10), (30, 5, 10)]
    got = [r[0] for r in spark.createDataFrame(rows, "t int, i int, p int").select(validation.document_kind(F.col("t"), F.col("i"), F.col("p"))).collect()]
    assert got == ["image_heavy_scan", "text_heavy", "diagram_heavy", "mixed_content", "low_text_content"]


def test_answer_quality(spark):
    m = one(spark.createDataFrame([([0.9, 0.6, 0.3],)], "s array<double>").select(retrieval.answer_quality(F.col("s"))))
    assert math.isclose(m.relevance, 0.6) and math.isclose(m.completeness, 0.6) and math.isclose(m.score, 0.582) and m.level == "acceptable"


def test_limiter(spark):
    r = spark.createDataFrame([("a", 1, 0, 30), ("a", 2, 10, 30), ("a", 3, 20, 20), ("a", 4, 3601, 1)], "caller string, id long, t long, n long")
    assert [x.admitted for x in limiter.admit(r).orderBy("id").collect()] == [True, False, True, True]


def test_result_clean(spark):
    r = one(checklist.clean_results(spark.createDataFrame([("Found", "1.7", "none", "x")], "status string, score string, excerpt string, page string")).select(F.struct("status", "score", "excerpt", "page")))
    assert (r.status, r.score, r.excerpt, r.page) == ("found", 1.0, None, None)


@pytest.mark.parametrize("answer,want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": "}"}} ok', '{"a": {"b": "}"}}'), ("", None), (None, None), ("{", None)])
def test_find_object(answer, want):
    assert repair.find_object(answer) == want


def test_find_array():
    assert repair.find_array('[{"a": 1}, {"a": 2}, {"a"') == '[{"a": 1}, {"a": 2}]'
    assert repair.find_array("nothing") is None


def test_deep_merge():
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.effective({"embedding": {"dimensions": 1024}, "wiki": {"k": 1}}, "wiki", {"embedding": {"dimensions": 5}}) == {"embedding": {"dimensions": 1024}, "k": 1}


def test_split_text():
    text = "\n\n".join("word " * 150 for _ in range(5))
    pieces = chunking.split_text(text)
    assert all(len(p) <= 1000 for p in pieces) and len(pieces) > 3
    assert "".join(pieces).replace("\n", "").replace(" ", "").startswith("word")
    cut = chunking.split_text("x" * 2500)
    assert [len(p) for p in cut] == [1000, 1000, 900]
    assert chunking.split_text("short") == ["short"]
    # levels are not mixed: what a later separator cut shares nothing with its neighbours
    mixed = chunking.split_text("a " * 300 + "\n\n" + "b " * 900 + "\n\n" + "c " * 100)
    assert [sorted(set(p) - {" ", "\n"}) for p in mixed] == [["a"], ["b"], ["b"], ["c"]] or [p[0] for p in mixed] == ["a", "b", "b", "b", "c"]
    # small parts of one level: the last ones that fit into the overlap come again
    parts = [f"{k}" * 300 for k in range(1, 6)]
    assert chunking.split_text("\n\n".join(parts)) == ["\n\n".join(parts[:3]), "\n\n".join(parts[3:])]
    parts = [f"{k}" * 150 for k in range(1, 9)]
    assert chunking.split_text("\n\n".join(parts)) == ["\n\n".join(parts[:6]), "\n\n".join(parts[5:])]


def test_prefix_dedup_keeps_best(spark):
    h = spark.createDataFrame([(1, "x" * 100 + "a", 0.9), (2, "x" * 100 + "b", 0.8)], "chunk_id long, content string, similarity double")
    assert [r.chunk_id for r in retrieval.first_of_prefix(h, 100, retrieval.best_first()).collect()] == [1]


def test_empty_allowed_means_no_rows(spark):
    c = spark.createDataFrame([(1, 1, "t", [1.0, 0.0])], "chunk_id long, doc_id long, content string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    assert retrieval.search(c, q, c.select("doc_id").limit(0)).count() == 0
    assert retrieval.search(c, q).count() == 1


def test_streaming_windows_match_batch(spark, tmp_path):
    from docquill.streaming.windows import by_window

    e = spark.range(100).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int), 0)").alias("ts"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    e.write.parquet(str(tmp_path / "in"))
    s = by_window(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, by_window(e).collect()))


def test_pdf_blocks_by_a_provider(spark, tmp_path):
    from docquill.sources.pdf import read_pdf_blocks

    (tmp_path / "a.pdf").write_bytes(b"one\n\ntwo")

    def parser(content):
        for i, line in enumerate(content.decode().split("\n")):
            yield 1, i, "NarrativeText", line, 12.0, [0.0, 0.0, 1.0, 1.0]

    assert [r.text for r in read_pdf_blocks(spark, str(tmp_path), parser).orderBy("block").collect()] == ["one", "two"]




# records, texts and sinks


def test_repetition_of_the_last_words():
    from docquill.operators.validation import repetition_score

    def described(text):
        words = text.split()
        if len(text) < 100 or not words:
            return 0.0
        windows = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
        many = sum(windows.count(w) > 2 for w in windows[:-1])
        return (1 - len(set(words)) / len(words)) * 0.7 + min(1.0, many / 10) * 0.3

    five = "one two three four five "
    text = five + "alpha beta gamma delta epsilon " + five + "zeta eta theta iota kappa " + five.strip()
    assert math.isclose(repetition_score(text), described(text))
    assert repetition_score(text) < repetition_score(text + " end")  # the last five words are no place of their own
    assert repetition_score(None) == repetition_score("") == repetition_score("a b " * 20) == 0.0
    for t in ("a " * 200, "a b c d e f " * 40, "x" * 300, " ".join(map(str, range(300)))):
        assert math.isclose(repetition_score(t), described(t))


def test_extracted_text(spark):
    from docquill.functions import records as R

    rows = [("cap", "t", "o", None, None, None, None), (None, "", "o", "n", ["i"], "h", None), (None, None, "o", "n", ["i"], "h", None), (None, None, None, "n", ["i", "j"], "h", None), (None, None, None, None, ["i", "j"], "h", None),
            (None, None, None, "n", [], "h", None), (None, None, None, None, None, "h", None), ("", None, None, "", [], "", "full_page_with_images"), (None, None, None, None, None, None, "other")]
    df = spark.createDataFrame(rows, "c string, t string, o string, n string, i array<string>, h string, k string")
    assert [r[0] for r in df.select(R.extracted_text(*[F.col(x) for x in "ctonihk"])).collect()] == ["cap", "", "o", "n\n\ni\nj", "i\nj", "n", "h", "[IMAGE PAGE]", ""]


def test_records(spark):
    from docquill.functions import records as R

    one_row = spark.range(1)
    value = lambda c: one_row.select(c).collect()[0][0]
    assert value(R.found_url(F.lit('{"x": 1, "url": "u", "signedUrl": "s"}'))) == "s" and value(R.found_url(F.lit("http://a"))) == "http://a" and value(R.found_url(F.lit("{}"))) is None
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert value(R.merged_map(m, F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    assert value(R.array_length(F.lit("[1, 2]"))) == 2 and value(R.array_length(F.lit("{}"))) == 0 and value(R.array_length(F.lit(None).cast("string"))) == 0
    kept = value(R.kept_keys(F.create_map(F.lit("bbox"), F.lit("b"), F.lit("raw"), F.lit("r"), F.lit("font_name"), F.lit(None).cast("string"))))
    assert kept == {"bbox": "b", "font_name": None}
    analysis = value(R.page_analysis(F.create_map(F.lit("complexity"), F.lit("simple"), F.lit("other"), F.lit("x"))))
    assert list(analysis.asDict()) == list(R.PAGE_KEYS) and analysis.complexity == "simple" and analysis.image_count is None
    long = value(R.compact_list(F.sequence(F.lit(1), F.lit(9))))
    assert (long["count"], long.first_items, long.last_item, long.summary) == (9, [1, 2], 9, "9 items (showing 2 first + 1 last)")
    short = value(R.compact_list(F.sequence(F.lit(1), F.lit(5))))
    assert (short["count"], short.first_items, short.last_item, short.summary) == (5, [1, 2, 3, 4, 5], None, None)
    assert value(R.sample_list(F.array(*map(F.lit, "abcd")))) == ["a", "b", "... and 2 more items"] and value(R.compact_text(F.lit("x" * 1001))) == "x" * 100 + "... [truncated 1001 chars]"
    chunks = value(R.compact_chunks(F.array(F.lit("abc"), F.lit("d"), F.lit(None).cast("string"))))
    assert (chunks["count"], chunks.total_size_chars, chunks.avg_size_chars) == (3, 4, 1)
    assert value(R.current_step(("a", "b"), {"a": F.lit(True), "b": F.lit(None).cast("boolean")})) == "b" and value(R.current_step(("a",), {"a": F.lit(True)})) == "completed"
    assert R.page_limit(500, -3) == (100, 0) and R.page_limit(80, 7, 50) == (50, 7)
    assert [value(R.estimated_seconds(s, F.lit(250))) for s in ("metadata", "enrichment", "chunking", "embedding", "clustering", "markdown", "retrieval", "generation")] == [25, 3000, 25, 27, 60, 1310, 7500, 128]


def test_contents_with_section_titles(spark):
    c = lambda category, text, kind="text": F.struct(F.lit(category).alias("c"), F.lit(text).alias("t"), F.lit(kind).alias("k"))
    rows = spark.range(1).select(F.explode(F.array(c("Table", "x"), c("Other", "x", "full_page_image"), c("NarrativeText", "x"), c("UncategorizedText", "see Tabel 1"), c("UncategorizedText", "x"), c("Formula", "x"), c("List", ""))).alias("r")).select("r.*")
    got = [r[0] for r in rows.select(chunking.composed(F.col("c"), F.col("t"), F.col("k"), F.lit("1.2 Works"))).collect()]
    assert got == ["Context: 1.2 Works\n\nType: Table\n\nSummary: x", "Context: 1.2 Works\n\nType: Image\n\nSummary: x", "Section: 1.2 Works\n\nx", "Context: 1.2 Works\n\nType: Reference\n\nContent: see Tabel 1", "Section: 1.2 Works\n\nx", "x", "Section: 1.2 Works\n\n[Empty list]"]
    assert [r[0] for r in rows.select(chunking.composed(F.col("c"), F.col("t"), F.col("k"))).collect()][2:4] == ["x", "Type: Reference\n\nContent: see Tabel 1"]
    assert one(rows.where("c = 'Table'").select(chunking.composed(F.col("c"), F.col("t"), F.col("k"), None, False))) == "x"


def test_chunks_with_section_titles(spark):
    rows = [(0, "Title", "1.2 Alpha section title"), (1, "NarrativeText", "word " * 60), (2, "NarrativeText", "long " * 400)]
    e = spark.createDataFrame([(1, s, 1, c, t, 0) for s, c, t in rows], "doc_id long, seq long, page long, category string, text string, phase int")
    got = chunking.chunk_elements(e, section_titles=True).orderBy("seq", "piece").collect()
    title = "Section: 1.2 Alpha section title"
    assert got[0].content == title + "\n\n" + ("word " * 60) and got[1].content == title and got[1].total == len(got) - 1 > 2 and got[2].content.startswith("long long")


def test_search_falls_back(spark):
    v = [(i, i % 3, f"text {i}", [float(i), 1.0]) for i in range(1, 40)]
    chunks = spark.createDataFrame(v, "chunk_id long, doc_id long, content string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert [r.chunk_id for r in retrieval.search(chunks, q, ids(0), 3).collect()] == [39]  # of the three nearest one is allowed
    assert [r.chunk_id for r in retrieval.search(chunks.where("doc_id <> 0 OR chunk_id < 30"), q, ids(0), 3).collect()] == [27, 24, 21]  # none: filter first
    assert retrieval.search(chunks, q, ids(), 3).count() == 0 and [r.chunk_id for r in retrieval.search(chunks, q, None, 3).collect()] == [39, 38, 37]


def test_whole_contents_and_excerpts(spark):
    h = spark.createDataFrame([(1, k, k % 2, f"f{k % 2}", 4, 0.9 - k / 100, "x" * 30_000) for k in range(1, 26)], "page_id long, rank int, doc_id long, filename string, page int, similarity double, content string").withColumn("chunk_id", F.col("rank"))
    assert len(retrieval.context(h, 2, None, "page_id").collect()[0].context) == 2 * 30_000 + len("[1, 1] \n[0, 2] ")
    r = retrieval.page_excerpts(h).collect()[0]
    assert r.excerpts.count("Excerpt ") == 12 and r.excerpts.startswith("Excerpt 1:\nSource: [f1, page 4]\nRelevance: 0.890\nContent: " + "x" * 600 + "...\n") and r.footnotes == "[1] f1\n[2] f0"


def test_tables_as_markdown(spark):
    from docquill.operators.tables import table_elements

    html = "<table><tr><th>A</th><th> b <b>c</b></th></tr><tr></tr>\n<tr><td>1</td><td>2</td></tr></table><table></table><TABLE class='x'><tr><td>" + "</td><td>".join("abcdefghijklmnopqrstu") + "</td></tr></TABLE><table><tr><td>z</td></tr></table>"
    got = table_elements(spark.createDataFrame([(1, html, 0), (2, None, 0), (3, "", 0)], "page_id long, html string, rows int"), "page_id", "html").orderBy("table_id").collect()
    assert [(r.page_id, r.table_id, r.text, r.n_rows, r.n_columns) for r in got] == [(1, "table_1", "| A | b c |\n| --- | --- |\n| 1 | 2 |", 2, 2), (1, "table_4", "| z |\n| --- |", 1, 1)]


def test_rewrites_fall_back(spark):
    from docquill.sources import providers as P

    class Silent(P.TextProvider):
        name = "silent"

        def complete(self, prompts):
            return [None if "hyde" in p else "new" for p in prompts]

    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    got = {r.kind: r.text for r in P.rewritten(P.query_variants(q, P.REWRITES), [Silent()]).collect()}
    assert got == {"original": "q", "semantic": "new", "hyde": "q", "formal": "new"}


def test_named_tables_and_scratch(spark, tmp_path):
    from docquill import scratch
    from docquill.sources import tables

    df = spark.range(3)
    tables.append_named(df, "t", str(tmp_path))
    tables.append_named(df, "t", str(tmp_path))
    assert tables.read_named(spark, "t", str(tmp_path)).count() == 6
    tables.replace_named(df, "t", str(tmp_path))
    assert tables.read_named(spark, "t", str(tmp_path)).count() == 3
    kept = scratch.materialize(df, "kept")
    path = kept.inputFiles()[0]
    assert spark.sparkContext.applicationId in path and scratch._RUN in path  # a folder of its own: the end of another job leaves it alone
    parts = scratch.materialize(df.withColumn("part", F.col("id") % 2), "parts", by="part")
    assert sorted(tuple(r) for r in parts.where("part = 0").collect()) == [(0, 0), (2, 0)]
    scratch.release(spark, kept, parts)
    with pytest.raises(Exception):
        kept.count()


def test_only_own_tables_are_released(spark, tmp_path):
    from docquill.scratch import materialize, release

    spark.range(3).write.parquet(str(tmp_path / "theirs"))
    with pytest.raises(ValueError, match="not a table"):
        release(spark, spark.read.parquet(str(tmp_path / "theirs")))
    assert spark.read.parquet(str(tmp_path / "theirs")).count() == 3
    release(spark, materialize(spark.range(3), "mine"), materialize(spark.range(4).withColumn("b", F.col("id") % 2), "mine", by="b"))
