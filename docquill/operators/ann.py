"""An approximate index of vectors: inverted lists by k-means cells, product-quantised residuals, exact similarity of the best.

The index is a table of its own name in the shared folder, written once: one
folder a cell, a code of some bytes and the vector for each row, and a row with
the cells' centres and the code books. A search reads the codes of the cells
near its queries only (the other folders are not opened), adds up each row's
similarity from tables of the query, keeps the best in each task, and scores the
best of all exactly. Every row is indexed; centres and books are fitted on a
sample of about ``SAMPLE`` rows by hash.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docquill.operators.retrieval import PAIRS, PER_QUERY, BestRows, _fields, _Queries, _query_blocks, _unit, _unit_column, nearest_of_each, six_digits
from docquill.sources.tables import named_path, read_named, replace_named

#: Rows that the index is fitted on, components of a code's part, codes of a part, passes of a fit, bounds of the number of cells.
SAMPLE, PART, CODES, PASSES, LEAST_CELLS, MOST_CELLS = 20_000, 4, 64, 12, 16, 4096
#: Share of the cells that a query looks into, and exact similarities for each result; recall at these is in the README.
PROBES, RERANK = 0.6, 10


def fitted(x: np.ndarray, k: int, seed: int = 7, passes: int = PASSES) -> np.ndarray:
    """``k`` centres (fewer rows: as many) of the rows of a sample, by Lloyd's passes; an empty one keeps its place."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(passes):
        near = nearest_centre(x, centres)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        if len(first):
            centres[near[order][first]] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, PART): rows cut in parts, with zeros at the end."""
    return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)


@dataclass
class Model:
    centres: np.ndarray  # (cells, dimensions)
    books: np.ndarray  # (parts, codes, PART)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and a byte for each part of what it differs by from the cell's centre."""
        cell = nearest_centre(x, self.centres)
        rest = padded(x - self.centres[cell], len(self.books))
        return cell, np.stack([nearest_centre(rest[:, i], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): what each code adds to the similarity with a query."""
        return np.einsum("qpd,pcd->qpc", padded(q, len(self.books)), self.books)


@dataclass
class Index:
    spark: SparkSession
    name: str
    root: str | None
    model: Model
    schema: T.StructType

    def rows(self) -> DataFrame:
        return read_named(self.spark, f"{self.name}/rows", self.root, self.schema)


def index_name(rows: DataFrame, label: str) -> str:
    """A name for the index of a table's files: by their paths, sizes and times, so that changed files have another index."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("long").alias("at")).distinct()
    digest = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "file_path", "file_size", "at"))), ";").cast("binary"), 256)).first()[0]
    return f"{label}-index-{digest[:16]}"


def exists(spark: SparkSession, name: str, root: str | None = None) -> bool:
    """Whether the index was written to its end: the model is written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{named_path(spark, name, root)}/model/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_index(chunks: DataFrame, name: str, cells: int | None = None, root: str | None = None) -> None:
    """Index ``chunks`` (chunk_id, embedding, and columns to filter by) below ``name``, which is written anew.

    A vector that is null, zero, not finite or of another length than most is
    indexed as zeros, which is similar to nothing. A cell of any size fills as many
    files as it needs. An empty table gives an index without rows.
    """
    spark = chunks.sparkSession
    n = chunks.count()
    draw = chunks.where(F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * min(1.0, SAMPLE / max(n, 1)))))
    sample = [r.embedding for r in draw.select("embedding").collect()]  # about SAMPLE rows
    lengths = [len(v) for v in sample if v is not None]
    size = max(set(lengths), key=lengths.count) if lengths else PART
    x = _unit(sample, size) if sample else np.zeros((1, size))
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, round(1.5 * math.sqrt(n))))
    centres = fitted(x, cells)
    rest = padded(x - centres[nearest_centre(x, centres)], -(-size // PART))
    books = [fitted(rest[:, i], CODES) for i in range(rest.shape[1])]
    model = Model(centres, np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), constant_values=1e9) for b in books]))  # codes beyond a small sample are far from all
    shared, kept = spark.sparkContext.broadcast(model), chunks.columns

    def run(batches):
        for batch in batches:
            cell, codes = shared.value.coded(_unit_column(batch.column("embedding"), size))
            offsets = pa.py_buffer((np.arange(len(cell) + 1) * codes.shape[1]).astype(np.int32))
            coded = pa.Array.from_buffers(pa.binary(), len(cell), [None, offsets, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([*batch.columns, coded, pa.array(cell, pa.int32())], [*kept, "codes", "cell"])

    rows = chunks.mapInArrow(run, _fields(chunks, "codes binary", "cell int"))
    replace_named(rows.hint("rebalance", "cell"), f"{name}/rows", root, by="cell")
    fields = [int(size), len(centres), len(books), centres.ravel().tolist(), model.books.ravel().tolist(), rows.schema.json()]
    replace_named(spark.createDataFrame([fields], "size int, cells int, parts int, centres array<double>, books array<double>, schema string"), f"{name}/model", root)


def open_index(spark: SparkSession, name: str, root: str | None = None) -> Index:
    m = read_named(spark, f"{name}/model", root).first()
    return Index(spark, name, root, Model(np.array(m.centres).reshape(m.cells, m.size), np.array(m.books).reshape(m.parts, CODES, PART)), T.StructType.fromJson(json.loads(m.schema)))


def search(index: Index, queries: DataFrame, k: int = PER_QUERY, probes: float = PROBES, rerank: int = RERANK, where: Column | None = None) -> DataFrame:
    """(chunk_id, query_id, similarity, rank): approximately the ``k`` nearest chunks of each query (query_id, query).

    A query looks into the share ``probes`` of the cells and scores ``rerank *
    k`` rows exactly. ``where`` filters rows before they are ranked. Queries go in
    blocks, as in an exact search.
    """
    kind = queries.schema["query_id"].dataType
    found = [_search_block(index, some, kind, k, max(1, math.ceil(probes * len(index.model.centres))), rerank * k, where) for some in _query_blocks(queries)]
    return reduce(DataFrame.unionByName, found)


def _search_block(index: Index, some: list, kind, k: int, probes: int, rerank: int, where: Column | None) -> DataFrame:
    spark, model, id_type = index.spark, index.model, to_arrow_type(kind)
    size = model.centres.shape[1]
    q = _unit([r.query for r in some], size)
    to_centres = q @ model.centres.T
    looks = np.zeros(to_centres.shape, bool)
    np.put_along_axis(looks, np.argsort(-to_centres, axis=1, kind="stable")[:, :probes], True, axis=1)
    ids = [r.query_id for r in some]
    shared = spark.sparkContext.broadcast((ids, np.where(looks, to_centres, -np.inf), model.tables(q)))
    rows = index.rows().where(F.col("cell").isin(np.flatnonzero(looks.any(axis=0)).tolist()))
    rows = rows if where is None else rows.where(where)

    def codes_of(batches):
        names, near, tables = shared.value
        best = BestRows(len(names), rerank, np.finfo(float).min)  # cells that a query does not look into are below
        step = max(1, PAIRS // max(1, len(names)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                similarity = near[:, part.column("cell").to_numpy()]
                for i in range(codes.shape[1]):
                    similarity += tables[:, i, codes[:, i]]
                best.add(part.select(["chunk_id", "cell"]), similarity.T)
        yield from best.batches(["chunk_id", "cell"], names, id_type)

    chunk = rows.schema["chunk_id"].dataType.simpleString()
    id_name = kind.simpleString()
    listed = rows.select("chunk_id", "cell", "codes").mapInArrow(codes_of, f"chunk_id {chunk}, cell int, query_id {id_name}, similarity double")
    few = nearest_of_each(listed, rerank, None).select("chunk_id", "cell", "query_id")
    exact = rows.select("chunk_id", "cell", "embedding").join(F.broadcast(few) if rerank * len(ids) <= 500_000 else few, ["chunk_id", "cell"])
    known = spark.sparkContext.broadcast((_Queries(some), {v: i for i, v in enumerate(ids)}))

    def exact_of(batches):
        queries, place = known.value
        for batch in batches:
            at = np.array([place[v] for v in batch.column("query_id").to_pylist()], np.int64)
            similarity = np.zeros(len(at))
            for n, (of, unit) in queries.by_size.items():
                here = np.flatnonzero(np.isin(at, of))
                x = _unit_column(batch.column("embedding").take(pa.array(here)), n)
                similarity[here] = (x * unit[np.searchsorted(of, at[here])]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("query_id"), pa.array(six_digits(similarity))], ["chunk_id", "query_id", "similarity"])

    scored = exact.select("chunk_id", "query_id", "embedding").mapInArrow(exact_of, f"chunk_id {chunk}, query_id {id_name}, similarity double")
    return nearest_of_each(scored, k, None)
