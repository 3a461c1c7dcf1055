"""Vector retrieval: exact nearest neighbours of one or many queries, with the filters and dedups of each pipeline.

Queries are few and of a checked number, so they go to all tasks in blocks;
chunks are scored where they are, a batch at a time by one matrix product, and
only the best of each task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquill.functions.vectors import cosine

#: Results of a search, most of the SQL function, results of a checklist query, its least similarity (fixed values).
TOP, MOST, PER_QUERY, LEAST = 15, 200, 10, 0.15
#: Most queries that are broadcast; more go in blocks.
BROADCAST_QUERIES = 4096

#: Least similarity of each level by language (fixed values).
LEVELS = {"danish": (("excellent", 0.70), ("good", 0.55), ("acceptable", 0.35)), "english": (("excellent", 0.75), ("good", 0.60), ("acceptable", 0.40))}
MINIMUM = {"danish": 0.20, "english": 0.25}


def best_first() -> list[Column]:
    """An ascending order by similarity from the highest, then by chunk."""
    return [-F.col("similarity"), F.col("chunk_id")]


def quality_category(similarity: Column, language: str = "english") -> Column:
    level = F.lit("poor")
    for name, least in reversed(LEVELS[language]):
        level = F.when(similarity >= least, name).otherwise(level)
    return level


def above_minimum(hits: DataFrame, language: str) -> DataFrame:
    return hits.where(F.col("similarity") >= MINIMUM[language])


def _query_blocks(queries: DataFrame) -> list[list]:
    """The queries (query_id, query) in lists of at most about ``BROADCAST_QUERIES``; one list, read by one job, where they fit."""
    q = queries.select("query_id", "query")
    few = q.limit(BROADCAST_QUERIES + 1).collect()
    if len(few) <= BROADCAST_QUERIES:
        return [few]
    blocks = -(-queries.count() // BROADCAST_QUERIES)
    return [q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect() for i in range(blocks)]


def _unit(vectors: list, size: int) -> np.ndarray:
    """A row of length one for each vector; zeros for one that is null, zero, incomplete, not finite or of another size."""
    rows = np.array([v if v is not None and len(v) == size else np.zeros(size) for v in vectors], float).reshape(len(vectors), size)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    fine = np.isfinite(length) & (length > 0)
    return np.where(fine, rows, 0.0) / np.where(fine, length, 1.0)


def _unit_column(column: pa.Array, size: int) -> np.ndarray:
    """:func:`_unit` of an array column, without a step for each vector where all are whole."""
    values = column.flatten()
    if column.null_count or values.null_count or len(values) != size * len(column) or not (pc.list_value_length(column).to_numpy(zero_copy_only=False) == size).all():
        return _unit(column.to_pylist(), size)
    rows = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    fine = np.isfinite(length) & (length > 0)
    return np.where(fine, rows, 0.0) / np.where(fine, length, 1.0)


def six_digits(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero, so that ties are ties everywhere."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


class _Queries:
    """Queries by the size of their vectors; a chunk of another size scores zero, as a null one does."""

    def __init__(self, rows: list) -> None:
        self.ids = [r.query_id for r in rows]
        sizes = [0 if r.query is None else len(r.query) for r in rows]
        self.by_size = {n: (np.array([i for i, m in enumerate(sizes) if m == n]), _unit([r.query for r, m in zip(rows, sizes, strict=True) if m == n], n)) for n in set(sizes) - {0}}

    def similarities(self, column: pa.Array) -> np.ndarray:
        """(chunks, queries)"""
        out = np.zeros((len(column), len(self.ids)))
        for size, (at, q) in self.by_size.items():
            out[:, at] = _unit_column(column, size) @ q.T
        return six_digits(out)


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


#: Pairs that a task scores at a time; pairs among which equal similarities are put together.
PAIRS, TOGETHER = 1 << 20, 1 << 23


def _equal_together(similarities: Iterator[np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """A whole number for each of ``size`` similarities of six digits: its millionths, and below them its place in so many bits.

    Equal similarities are beside each other, by place; all are in the order of
    places where more than a third differ, as a file is no smaller then.
    """
    bits, key, n = size.bit_length(), np.arange(size), 0
    for some in similarities:
        key[n : n + some.size] += np.rint(some.ravel() * 1e6).astype(np.int64) << bits
        n += some.size
    equal = np.sort(key)
    differ = sum(np.count_nonzero(np.diff(equal[i : i + PAIRS + 1] >> bits)) for i in range(0, size, PAIRS))
    return equal if 3 * differ < size else key, bits


def score(chunks: DataFrame, queries: DataFrame, together: int = 0) -> DataFrame:
    """Each chunk, without its ``embedding``, with each query (query_id, query): similarity, the cosine rounded to six digits.

    Zero where a vector is null, zero, not finite, has a null or another length. Up
    to ``BROADCAST_QUERIES`` queries go to all tasks at once; more go in blocks of
    about that size, a pass each. Where all pairs are to be stored, ``together`` is
    a number of pairs of a task among which equal similarities go beside each
    other: the same rows, which files hold in fewer bytes.
    """
    rest = chunks.drop("embedding")
    kind, kept = queries.schema["query_id"].dataType, rest.columns
    id_type = to_arrow_type(kind)

    def scored(some: list) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast(_Queries(some))

        def run(batches):
            q = shared.value
            ids, n = pa.array(q.ids, id_type), max(1, len(q.ids))
            few, step = max(1, PAIRS // n), max(1, max(PAIRS, together) // n)

            def rows(part: pa.RecordBatch, at: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
                of_chunk, of_query = np.divmod(at, n)
                columns = [part.column(c).take(pa.array(of_chunk)) for c in kept]
                return pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(of_query)), pa.array(similarity)], [*kept, "query_id", "similarity"])

            for part in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
                if not together:
                    similarity = q.similarities(part.column("embedding")).ravel()
                    yield rows(part, np.arange(similarity.size), similarity)
                    continue
                blocks = (q.similarities(part.column("embedding").slice(i, few)) for i in range(0, part.num_rows, few))
                keys, bits = _equal_together(blocks, part.num_rows * len(q.ids))
                for key in (keys[i : i + PAIRS] for i in range(0, len(keys), PAIRS)):
                    yield rows(part, key & (1 << bits) - 1, (key >> bits) / 1e6)

        return chunks.select(*kept, "embedding").mapInArrow(run, _fields(rest, f"query_id {kind.simpleString()}", "similarity double"))

    return reduce(DataFrame.unionByName, [scored(some) for some in _query_blocks(queries)])


#: Steps of a similarity, which has six digits, from -1 to 1; bits of a whole number; pairs that are sorted together, and that a task deals to such ranges.
STEPS, KEY_BITS, SORTED_PAIRS, TASK_PAIRS = 2_000_001, 63, 1 << 22, 1 << 26


def _by_places(values: np.ndarray) -> list[bytes]:
    """Whole numbers from zero on: the lowest byte of each, then the next of each and so on up to the highest in use, each of these compressed."""
    places = values.astype("<i8").view(np.uint8).reshape(-1, 8).T[: (int(values.max()).bit_length() + 7) // 8]
    return [pa.compress(np.ascontiguousarray(p), codec="zstd", asbytes=True) for p in places]


def _from_places(places: list[bytes], n: int) -> np.ndarray:
    """The ``n`` whole numbers of :func:`_by_places`."""
    values = np.zeros((n, 8), np.uint8)
    for i, p in enumerate(places):
        values[:, i] = np.frombuffer(pa.decompress(p, n, codec="zstd"), np.uint8)
    return values.view("<i8").ravel()


def in_order(chunks: DataFrame, queries: DataFrame, known: Column, sorted_pairs: int = SORTED_PAIRS) -> DataFrame:
    """(query_id, chunk_id, similarity) of :func:`score`, from the highest similarity on, then by query and chunk; zero where ``known``, of the chunk, is not true.

    Where the ids are whole numbers in a range that leaves room, one whole number
    stands for a pair, and pairs are sorted in ranges of about ``sorted_pairs``.
    Tasks hold chunks that are neighbours by id, score some millions of pairs and
    deal them to the ranges: for each range its pairs in the order of queries and
    chunks, as distances from one to the next and how far their similarities are
    below the range's highest. These are small numbers, two to three bytes a pair
    when compressed, and next to none where all pairs of a chunk are zero. The
    bounds of the ranges, and those between the tasks' chunks, are of some chunks'
    pairs; they say which task has a pair only. Other ids are sorted by Spark, pair
    by pair.
    """
    c = chunks.select("chunk_id", "embedding", F.coalesce(known, F.lit(False)).alias("known"))
    kinds = {"query_id": queries.schema["query_id"].dataType, "chunk_id": chunks.schema["chunk_id"].dataType}
    whole = all(k.typeName() in ("byte", "short", "integer", "long") for k in kinds.values())
    ends = [df.agg(F.min(n), F.max(n), F.count("*"), F.count(n)).first() if whole else None for n, df in (("query_id", queries), ("chunk_id", chunks))]
    width = [(e[1] - e[0]).bit_length() if whole and e[3] else 0 for e in ends]
    if not whole or any(e[2] != e[3] for e in ends) or max(width[0], ends[0][2].bit_length()) + width[1] + STEPS.bit_length() > KEY_BITS:
        similarity = F.when(F.col("known"), F.col("similarity")).otherwise(0.0).alias("similarity")
        return score(c, queries).select("query_id", "chunk_id", similarity).orderBy(F.desc("similarity"), "query_id", "chunk_id")
    (q0, c0), (q_bits, c_bits), pairs = (e[0] or 0 for e in ends), width, ends[0][2] * ends[1][2]
    top = (STEPS - 1) // 2

    def below(q: _Queries, part: pa.RecordBatch) -> np.ndarray:
        """(chunks, queries): steps of the similarity below one."""
        step = top - np.rint(q.similarities(part.column("embedding")) * top).astype(np.int32)
        step[~part.column("known").to_numpy(zero_copy_only=False)] = top
        return step

    def key(step: np.ndarray, query: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        return ((step.astype(np.int64) << q_bits) + (query - q0) << c_bits) + (chunk - c0)

    def ids_of(part: pa.RecordBatch) -> np.ndarray:
        return part.column("chunk_id").to_numpy().astype(np.int64)

    spark = chunks.sparkSession
    blocks = [sorted(some, key=lambda r: r.query_id) for some in _query_blocks(queries) if some]
    ids = spark.sparkContext.broadcast([np.array([r.query_id for r in some], np.int64) for some in blocks])
    shared = [spark.sparkContext.broadcast(_Queries(some)) for some in blocks]
    ranges = -(-pairs // sorted_pairs) or 1
    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        some = c.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, ends[1][2] // 1024))) == 0).limit(4096).toArrow()  # about 1,024 chunks
        every = max(1, len(blocks) * 16) | 1
        parts = some.to_batches(max_chunksize=256)
        found = [key(below(b.value, part), of, ids_of(part)[:, None]).ravel()[::every] for b, of in zip(shared, ids.value, strict=True) for part in parts]
        found = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        bounds = found[np.arange(1, ranges) * len(found) // ranges] if len(found) else bounds
        tasks = max(-(-ends[1][2] * max(map(len, blocks)) // TASK_PAIRS), min(ranges, spark.sparkContext.defaultParallelism))
        near = np.sort(np.concatenate([np.zeros(0, np.int64), *map(ids_of, parts)]))
        cuts = np.unique(near[np.arange(1, tasks) * len(near) // tasks]).tolist() if len(near) else []
        slice_of = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda cut: cut <= F.col("chunk_id")))
        c = c.repartitionById(len(cuts) + 1, slice_of).sortWithinPartitions("chunk_id")
    highest = np.append(0, bounds >> q_bits + c_bits)  # of each range, in steps below one

    def dealt(block: int) -> DataFrame:
        mine = shared[block]

        def cells(q: _Queries, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            """Of each range the pairs of some chunks, by query and chunk."""
            chunk = np.concatenate([i for i, _ in held])
            by_id = np.argsort(chunk, kind="stable")
            chunk, step = chunk[by_id], np.concatenate([s for _, s in held])[by_id].T.ravel()
            query, span = np.array(q.ids, np.int64), int(chunk[-1] - chunk[0]) + 1
            cut = np.bincount(highest[1:], minlength=STEPS)
            of = (np.cumsum(cut) - cut).astype(np.uint16 if ranges <= 1 << 16 else np.int32)[step]
            split = np.flatnonzero((cut > 0)[step])  # bounds are between pairs of this similarity
            at_query, at_chunk = np.divmod(split, len(chunk))
            of[split] = np.searchsorted(bounds, key(step[split], query[at_query], chunk[at_chunk]), side="right")
            order = np.argsort(of, kind="stable")
            place, down = (np.arange(len(query))[:, None] * span + (chunk - chunk[0])).ravel()[order], step[order]
            rows, begin = [], 0
            for i, n in enumerate(np.bincount(of).tolist()):
                if n:
                    some = slice(begin, begin := begin + n)
                    deep = down[some] - highest[i]
                    steps = int(deep.max()) + 1
                    rows.append((i, block, n, int(chunk[0]), span, steps, _by_places(np.diff(place[some], prepend=0) * steps + deep)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "block", "pairs", "first", "span", "steps", "places"])

        def run(batches):
            q, held, n = mine.value, [], 0
            few = max(1, PAIRS // len(q.ids))
            for part in (batch.slice(i, few) for batch in batches for i in range(0, batch.num_rows, few)):
                held.append((ids_of(part), below(q, part)))
                n += held[-1][1].size
                if n >= sorted_pairs:
                    yield cells(q, held)
                    held, n = [], 0
            if n:
                yield cells(q, held)

        return c.mapInArrow(run, "range int, block int, pairs int, first long, span long, steps long, places array<binary>")

    def keys(row: dict) -> np.ndarray:
        apart, deep = np.divmod(_from_places(row["places"], row["pairs"]), row["steps"])
        at_query, at_chunk = np.divmod(np.cumsum(apart), row["span"])
        return key(deep + highest[row["range"]], ids.value[row["block"]][at_query], at_chunk + row["first"])

    def ordered(batches):
        rows = np.concatenate([np.zeros(0, np.int64), *[keys(row) for b in batches for row in b.to_pylist()]])
        rows.sort()
        for some in (rows[i : i + (1 << 16)] for i in range(0, len(rows), 1 << 16)):
            of = some >> c_bits
            columns = {"query_id": (of & (1 << q_bits) - 1) + q0, "chunk_id": (some & (1 << c_bits) - 1) + c0}
            columns = [pa.array(v).cast(to_arrow_type(kinds[n])) for n, v in columns.items()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((top - (of >> q_bits)) / top)], [*kinds, "similarity"])

    shape = ", ".join([*[f"{n} {k.simpleString()}" for n, k in kinds.items()], "similarity double"])
    if not blocks:
        return spark.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, map(dealt, range(len(blocks)))).repartitionById(ranges, F.col("range")).mapInArrow(ordered, shape)


class BestRows:
    """The best ``k`` rows of each query in a task, by similarity and then by chunk; only the first of those that are equal in ``unlike``."""

    def __init__(self, queries: int, k: int, least: float, unlike: str | None = None) -> None:
        self.k, self.unlike, self.bound, self.held = k, unlike, np.full(queries, least), None

    def add(self, part: pa.RecordBatch, similarity: np.ndarray) -> None:
        """``similarity`` is (rows, queries)."""
        at, of = np.nonzero(similarity >= self.bound)
        if not len(at):
            return
        new = part.take(pa.array(at)).to_pandas(types_mapper=pd.ArrowDtype).assign(query=of, similarity=similarity[at, of])
        whole = new if self.held is None else pd.concat([self.held, new], ignore_index=True)
        whole = whole.sort_values(["query", "similarity", "chunk_id"], ascending=[True, False, True], kind="stable")
        whole = whole.drop_duplicates(["query", self.unlike]) if self.unlike else whole
        place = whole.groupby("query").cumcount()
        self.held = whole[place < self.k]
        last = self.held[place[self.held.index] == self.k - 1]
        self.bound[last["query"].to_numpy()] = last["similarity"].to_numpy()

    def batches(self, columns: list[str], ids: list, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            known = pd.Series(pd.array([ids[i] for i in self.held["query"]], dtype=pd.ArrowDtype(id_type)), index=self.held.index)
            yield from pa.Table.from_pandas(self.held.assign(query_id=known)[[*columns, "query_id", "similarity"]], preserve_index=False).to_batches()


def best_of_each(chunks: DataFrame, queries: DataFrame, k: int = PER_QUERY, least: float | None = LEAST, unlike: str | None = None) -> DataFrame:
    """The ``k`` best chunks of each query with their ``rank``, at or above ``least``: a bounded list of each query in each task, then among the tasks' lists.

    Rows are those of :func:`score`; ties go to the smaller chunk_id. With
    ``unlike`` only the best of the chunks that are equal in that column counts.
    """
    rest = chunks.drop("embedding")
    kind, kept = queries.schema["query_id"].dataType, rest.columns
    id_type = to_arrow_type(kind)

    def listed(some: list) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast(_Queries(some))

        def run(batches):
            q = shared.value
            best = BestRows(len(q.ids), k, -np.inf if least is None else least, unlike)
            step = max(1, PAIRS // max(1, len(q.ids)))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    best.add(part.select(kept), q.similarities(part.column("embedding")))
            yield from best.batches(kept, q.ids, id_type)

        return chunks.select(*kept, "embedding").mapInArrow(run, _fields(rest, f"query_id {kind.simpleString()}", "similarity double"))

    found = reduce(DataFrame.unionByName, [listed(some) for some in _query_blocks(queries)])
    best = [F.desc("similarity"), F.asc("chunk_id")]
    if unlike:
        first = F.row_number().over(Window.partitionBy("query_id", unlike).orderBy(*best))  # at most one row a task
        found = found.withColumn("rank", first).where("rank = 1")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` nearest chunks of one query, ties by chunk_id; a bounded list in each task."""
    return best_of_each(chunks, queries, min(k, MOST), None).drop("rank").orderBy(F.desc("similarity"), "chunk_id").limit(min(k, MOST))


def nearest_of_each(scored: DataFrame, k: int = PER_QUERY, least: float | None = LEAST, group: list[str] | None = None) -> DataFrame:
    """The ``k`` best hits of each query (or ``group``) with their ``rank``, at or above ``least``; first within parts, then among the parts' best."""
    kept = scored if least is None else scored.where(F.col("similarity") >= least)
    by, group = [F.desc("similarity"), F.asc("chunk_id")], group or ["query_id"]
    part = Window.partitionBy(*group, "__part").orderBy(*by)
    local = kept.withColumn("__part", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return local.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("rank") <= k)


def first_of_prefix(hits: DataFrame, length: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Of hits whose content begins alike, the one with the smallest ``order``; an aggregate, so copies are reduced in each task."""
    prefix = F.substring(F.coalesce("content", F.lit("")), 1, length).alias("__prefix")
    first = F.min_by(F.struct(*hits.columns), F.struct(*order))
    return hits.groupBy(*(within or []), prefix).agg(first.alias("__first")).select("__first.*")


def best_of_chunk(hits: DataFrame) -> DataFrame:
    """For each chunk the highest similarity of any query (then the smallest query)."""
    return hits.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"), F.min_by("query_id", F.struct(-F.col("similarity"), F.col("query_id"))).alias("query_id"))


def best_query_of_each(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`best_of_chunk` of :func:`score`: (chunk_id, similarity, query_id), the best query of each chunk (then the smallest). The best of a block of queries is taken where the chunk is, so that no pairs are made."""
    kinds = chunks.schema["chunk_id"].dataType, queries.schema["query_id"].dataType
    id_type = to_arrow_type(kinds[1])

    def best(some: list) -> DataFrame:
        some = sorted(some, key=lambda r: (r.query_id is not None, r.query_id))  # of equal ones argmax takes the first; nulls first, as Spark compares them
        shared = chunks.sparkSession.sparkContext.broadcast(_Queries(some))

        def run(batches):
            q = shared.value
            ids = pa.array(q.ids, id_type)
            step = max(1, PAIRS // max(1, len(q.ids)))
            for batch in batches if q.ids else ():
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    similarity = q.similarities(part.column("embedding"))
                    first = similarity.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.array(similarity[np.arange(len(first)), first]), ids.take(pa.array(first))], ["chunk_id", "similarity", "query_id"])

        return chunks.select("chunk_id", "embedding").mapInArrow(run, f"chunk_id {kinds[0].simpleString()}, similarity double, query_id {kinds[1].simpleString()}")

    return best_of_chunk(reduce(DataFrame.unionByName, [best(some) for some in _query_blocks(queries)]))


def search(chunks: DataFrame, queries: DataFrame, allowed: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """The pipeline of one query: nearest ``k``, then the document filter, similarity not below zero; if nothing is left, filter first. Then dedup by 100 characters.

    ``allowed`` (doc_id): null means no filter, an empty table no rows. Both
    rankings come from one pass: the best ``k`` of the allowed and of the other
    documents hold the best ``k`` of all.
    """
    if allowed is None:
        hits = nearest(chunks, queries, k).withColumn("similarity", F.greatest("similarity", F.lit(0.0)))
        return first_of_prefix(hits, 100, best_first()).orderBy(F.desc("similarity"), "chunk_id").limit(k)
    ids = allowed.select(F.col("doc_id").alias("allowed_id")).distinct()
    marked = chunks.select("chunk_id", "doc_id", "embedding").join(ids, F.col("doc_id") == F.col("allowed_id"), "left").withColumn("allowed", F.col("allowed_id").isNotNull()).drop("allowed_id")
    best = nearest_of_each(score(marked, queries), min(k, MOST), None, ["query_id", "allowed"])
    of_query = Window.partitionBy("query_id")  # at most two times ``k`` rows
    best = best.withColumn("all_rank", F.row_number().over(of_query.orderBy(F.desc("similarity"), "chunk_id"))).where("allowed")
    left = F.count_if(F.col("all_rank") <= k).over(of_query)
    hits = best.withColumn("left", left).where((F.col("left") == 0) | (F.col("all_rank") <= k))
    hits = hits.withColumn("similarity", F.when(F.col("left") > 0, F.greatest("similarity", F.lit(0.0))).otherwise(F.col("similarity")))
    whole = hits.select("query_id", "chunk_id", "similarity").join(chunks.drop("embedding"), "chunk_id")
    return first_of_prefix(whole, 100, best_first()).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def ranked_similarity(similarity: Column, rank: Column) -> Column:
    """The similarity, or one that falls with the rank where it is unknown; never below zero."""
    return F.greatest(F.coalesce(similarity, F.greatest(F.lit(0.1), 1 - 0.05 * rank)), F.lit(0.0))


def numbered_citations(hits: DataFrame, top: int = 20) -> DataFrame:
    """Hits (page_id, rank, doc_id) up to ``top`` with ``citation``: documents numbered by first appearance on the page."""
    few = hits.where(F.col("rank") <= top)
    first = few.withColumn("first", F.min("rank").over(Window.partitionBy("page_id", "doc_id")))
    return first.withColumn("citation", F.dense_rank().over(Window.partitionBy("page_id").orderBy("first"))).drop("first")


def context(hits: DataFrame, most: int, chars: int | None, group: str = "query_id") -> DataFrame:
    """(group, context): the first ``most`` hits as ``[document, chunk]`` and their content, or its first ``chars``, in rank order."""
    content = F.coalesce("content", F.lit(""))
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(", "), F.col("chunk_id").cast("string"), F.lit("] "), content if chars is None else F.substring(content, 1, chars))
    few = hits.where(F.col("rank") <= most).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return few.select(group, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


#: The head of a hit in an answer's context (fixed value).
SOURCE_HEAD = ("Dokumenter fra ", ", side ", ":\n")


def answer_context(hits: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, context): the hits (rank, filename, page, content) whole, in rank order, each below its document and page."""
    before, between, after = map(F.lit, SOURCE_HEAD)
    block = F.concat(before, F.coalesce("filename", F.lit("unknown")), between, F.coalesce(F.col("page").cast("string"), F.lit("N/A")), after, F.coalesce("content", F.lit("")), F.lit("\n"))
    blocks = hits.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("text")))).alias("blocks"))
    return blocks.select(group, F.array_join(F.transform("blocks", lambda x: x["text"]), "\n").alias("context"))


def page_excerpts(hits: DataFrame, top: int = 20, shown: int = 12, chars: int = 600) -> DataFrame:
    """(page_id, excerpts, footnotes) of hits (page_id, rank, doc_id, filename, page, similarity, content): the first ``shown`` as excerpts, the documents of the first ``top`` as numbered footnotes."""
    few = numbered_citations(hits, top)
    thousandths = F.floor((F.round(F.greatest("similarity", F.lit(0.0)) * 1_000_000).cast("long") + 500) / 1000)  # in whole numbers, so that halves go up everywhere
    excerpt = F.concat(
        F.lit("Excerpt "), F.col("rank").cast("string"), F.lit(":\nSource: ["), F.col("filename"), F.lit(", page "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")), F.lit("]\nRelevance: "),
        F.format_string("%d.%03d", F.floor(thousandths / 1000), thousandths % 1000), F.lit("\nContent: "), F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit("..."),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["text"]), "\n")
    note = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.col("filename"))
    return few.groupBy("page_id").agg(
        joined(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", excerpt.alias("text"))))).alias("excerpts"),
        joined(F.collect_set(F.struct("citation", note.alias("text")))).alias("footnotes"),
    )


def answer_quality(similarities: Column) -> Column:
    """Struct of relevance, completeness, score and level from an array of similarities, best first."""
    n = F.size(similarities)
    mean = F.when(n > 0, F.aggregate(similarities, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    complete = F.least(n / 5, F.lit(1.0))
    score_ = 0.4 * mean + 0.3 * complete + 0.3 * 0.9 * mean
    return F.struct(mean.alias("relevance"), complete.alias("completeness"), score_.alias("score"), F.when(score_ > 0.6, "good").when(score_ > 0.4, "acceptable").otherwise("low").alias("level"))


def answer_confidence(similarities: Column) -> Column:
    """The mean of the best three, at most one."""
    top = F.slice(similarities, 1, 3)
    return F.when(F.size(top) > 0, F.least(F.lit(1.0), F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top))).otherwise(0.0)
