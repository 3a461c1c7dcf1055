"""Queries that SQL cannot express, against plain Python over the whole smallest tables."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest

from docquill import plans
from docquill.operators import clustering
from docquill.sources.providers import HashEmbeddingDouble
from tests.conftest import SF


def read(sql, folder=SF):
    return duckdb.sql(sql.replace("@", folder + "/")).fetchall()


def collect(spark, name, folder=SF):
    return plans.queries()[name](spark, folder).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bbox_dedup(spark):
    pages = collections.defaultdict(list)
    for order, line, part, supp, quantity in read("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::double from '@lineitem.parquet'"):
        x, y = quantity, line * 10.0
        pages[order, part % 2].append((line * 1000000 + part, [x, y, x + part % 40 + 1.0, y + supp % 30 + 1.0]))
    want = set()
    for key, boxes in pages.items():
        kept = []
        for seq, b in sorted(boxes):
            area = (b[2] - b[0]) * (b[3] - b[1])
            for i, (_, k) in enumerate(kept):
                if max(abs(p - q) for p, q in zip(b, k)) <= 1:
                    break
                other = (k[2] - k[0]) * (k[3] - k[1])
                shared = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
                if shared >= 0.8 * min(area, other):
                    if area > other:
                        kept[i] = (seq, b)
                    break
            else:
                kept.append((seq, b))
        want |= {(*key, i, seq, *b) for i, (seq, b) in enumerate(kept)}
    assert {tuple(r) for r in collect(spark, "bbox_dedup")} == want


def test_rate_limit(spark):
    callers = collections.defaultdict(list)
    for i, user, t in read("select event_id, user_id, epoch(date_trunc('second', ts))::bigint from '@events.parquet'"):
        callers[user].append((t, i, i % 20 + 1))
    want = {}
    for requests in callers.values():
        admitted = []
        for t, i, n in sorted(requests):
            held = sum(m for u, m in admitted if u >= t - 3600)
            want[i] = held + n <= 50
            if want[i]:
                admitted.append((t, n))
    assert {r.id: r.admitted for r in collect(spark, "rate_limit")} == want


def split(text, separators=("\n\n", "\n", " ", ""), size=1000, overlap=200):
    """The recursive splitter by letters at its last level, as it is described."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    mark = separators[at]
    parts = list(text) if not mark else [p for i, x in enumerate(text.split(mark)) if (p := (mark if i else "") + x)]
    out, small = [], []

    def flush():
        window = []
        for p in [*small, None]:
            if p is None or (window and sum(map(len, window)) + len(p) > size):
                if window and "".join(window).strip():
                    out.append("".join(window).strip())
                while p is not None and window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            if p is not None:
                window.append(p)
        small.clear()

    for p in parts:
        if len(p) < size:
            small.append(p)
        else:
            flush()
            out.extend(split(p, separators[at + 1 :]))
    flush()
    return out


def pieces(text):
    found = split(text) if len(text) > 1500 else [text]
    return found if len(found) > 1 else [text]


def test_recursive_split(spark):
    got = collections.defaultdict(dict)
    for r in collect(spark, "recursive_split"):
        got[r.doc_id][r.piece] = (r.total, r.chars, r.sha)
    for i, text in read("select doc_id, text from '@documents.parquet'"):
        want = pieces(text)
        assert got[i] == {k: (len(want), len(p), sha(p)) for k, p in enumerate(want)}


def test_chunk_documents(spark):
    kinds = {0: "Title", 1: "ListItem", 2: "ListItem", 3: "ListItem", 4: "UncategorizedText", 5: "Header"}
    refers = lambda t: any(w in t.lower() for w in ("tabel", "table", "figur", "figure"))
    compose = lambda c, t: f"Type: Reference\n\nContent: {t}" if c == "UncategorizedText" and refers(t) else t
    want = set()
    for i, text in read("select doc_id, text from '@documents.parquet'"):
        elements = [(s, s // 8 + 1, kinds.get((i * 31 + s * 7) % 10, "NarrativeText"), line) for s, line in enumerate(text.split("\n"))]
        kept = [e for e in elements if e[2] not in ("Header", "Title") and not (e[2] == "UncategorizedText" and len(e[3].strip()) < 20)]
        grouped, at = [], 0
        while at < len(kept):
            s, page, kind, line = kept[at]
            items = []
            while kind == "NarrativeText" and len(items) < 10 and at + 1 + len(items) < len(kept) and kept[at + 1 + len(items)][2] == "ListItem":
                items.append(kept[at + 1 + len(items)][3])
            grouped.append((s, page, "List", line + "\n\n" + "\n".join(items)) if items else (s, page, kind, line))
            at += 1 + len(items)
        merged, island = [], []
        for e in [*grouped, None]:
            if e is not None and len(compose(e[2], e[3])) < 100:
                island.append(e)
                continue
            if len(island) > 1:
                merged.append((island[0][0], island[0][1], "MergedContent", "\n\n".join(t for x in island if (t := x[3].strip()))))
            else:
                merged += island
            island = []
            merged += [e] if e is not None else []
        for s, page, kind, line in merged:
            if line.strip():
                parts = pieces(compose(kind, line))
                want |= {(i, s, k, len(parts), page, kind, sha(f"{i}|{s}|{k}"), sha(p)) for k, p in enumerate(parts)}
    assert {tuple(r) for r in collect(spark, "chunk_documents")} == want


def cost(x, labels):
    return sum(((x[labels == k] - x[labels == k].mean(axis=0)) ** 2).sum() for k in np.unique(labels))


def test_kmeans(spark):
    rows = dict(read("select vec_id, embedding from '@embeddings.parquet'"))
    got = {r.chunk_id: r.cluster for r in collect(spark, "kmeans")}
    assert set(got) == set(rows) and len(set(got.values())) == 10
    x = np.array([rows[i] for i in sorted(rows)], float)
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(10):
        centres = x[rng.choice(len(x), 10, replace=False)]
        for _ in range(20):
            near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(10)])
        best = min(best, cost(x, near))
    assert cost(x, np.array([got[i] for i in sorted(rows)])) <= 1.03 * best


def test_few_chunks_are_on_their_own(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "chunk_id long, embedding array<double>")
    assert sorted(r.cluster for r in clustering.clusters(df).collect()) == [0, 1, 2]


def test_clusters_of_odd_rows(spark):
    rows = [(i, [float(i % 4) * 10, float(i % 2) * 10 + i / 1000]) for i in range(100)] + [(200, None), (201, [1.0]), (202, [1.0, None]), (203, [float("nan"), 0.0])]
    got = {r.chunk_id: r.cluster for r in clustering.clusters(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), most=4).collect()}
    assert [got[i] for i in (200, 201, 202, 203)] == [None] * 4 and len({got[i] for i in range(100)}) == 4
    assert all(got[i] == got[i % 4] for i in range(100))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)], "chunk_id long, embedding array<double>")
    assert {r.cluster for r in clustering.clusters(same).collect()} == {0}
    none = spark.createDataFrame([(i, None) for i in range(90)], "chunk_id long, embedding array<double>")
    assert {r.cluster for r in clustering.clusters(none).collect()} == {None}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_ann_recall_on_the_embeddings(spark, folder):
    rows = dict(read("select vec_id, embedding from '@embeddings.parquet'", folder))
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in collect(spark, "ann_index", folder):
        got[r.query_id].add(r.chunk_id)
    queries = [k for k, i in enumerate(ids) if i % 50 == 0]
    found = sum(len(got[ids[k]] & set(ids[np.argsort(-(x @ x[k]), kind="stable")[:10]].tolist())) for k in queries)
    assert set(got) == {ids[k] for k in queries} and found >= 0.9 * 10 * len(queries)


def test_embed_chunks(spark):
    double, texts = HashEmbeddingDouble(32), dict(read("select doc_id, text from '@documents.parquet'"))
    for r in collect(spark, "embed_chunks"):
        assert r.dims == 32 and abs(r.first - double.embed([texts[r.chunk_id]])[0][0]) < 1e-4
