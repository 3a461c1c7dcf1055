"""Patterns in pages: whole words by a join, the others by automata, all as a search in any place finds them."""

from docquill.operators import wiki as W


def test_mentioned_in_any_place(spark):
    pages = [(1, "Se doc_12.pdf, og MYDOC_7.PDF-kopi. Arbejdsmiljø (\u201csikkerhed\u201d) x_y."), (1, "a file name.txt; İndeks \u00e6ble-\ngrød"), (2, "doc_7.pdf"), (2, ""), (3, None)]
    asked = ["doc_12.pdf", "doc_7.pdf", "doc_1.pdf", "oc_1", "arbejdsmiljø", "miljø", "sikkerhed", "kopi", "file name.txt", "name.txt", "_y", "x_y.", "-\ngrød", "grød", "z", "", ".", "\u201d)", "kopi arbejdsmiljø"]
    p = spark.createDataFrame(pages, "wiki_id int, content string")
    q = spark.createDataFrame([(w, a) for w in (1, 2, 3, 4) for a in asked], "wiki_id int, pattern string")
    want = {(w, a) for w in (1, 2, 3, 4) for a in asked if a and any(v == w and c and a in c.lower() for v, c in pages)}
    for sizes in ((W.PAGE_CHARS, W.PATTERNS), (20, 3)):
        got = [tuple(r) for r in W.mentioned(p, q, *sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_whole_words_are_not_searched_for(spark, monkeypatch):
    """What every block of patterns reads is left to the patterns that are no word of a page."""
    seen = []
    search = W.searched
    monkeypatch.setattr(W, "searched", lambda texts, patterns, *rest: seen.append({r.pattern for r in patterns.collect()}) or search(texts, patterns, *rest))
    p = spark.createDataFrame([(1, "Alpha beta, doc_1.pdf.")], "wiki_id int, content string")
    q = spark.createDataFrame([(1, x) for x in ("alpha", "beta", "doc_1.pdf", "lph", "missing")], "wiki_id int, pattern string")
    assert {r.pattern for r in W.mentioned(p, q).collect()} == {"alpha", "beta", "doc_1.pdf", "lph"} and seen == [{"lph", "missing"}]
